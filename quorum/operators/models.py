"""Model registry, training / scoring, class weights, random search, cross-
validated evaluation and final models, all on Spark ML (M1, M2, M4-M6, M9-M11).

Estimators are Spark ML's (distributed fitting); scores are P(class 1) taken
from the probability vector with ``vector_to_array`` (no Python UDF). Folds
come from W1 and the per-fold sweep of every model is ONE A3 job.
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.config import EvalConfig
from quorum.functions.metrics import log_loss_expr
from quorum.operators import evaluation as E
from quorum.operators.folds import stratified_kfold
from quorum.operators.forest import BaggedForest, fit_bagged
from quorum.operators.neighbours import knn_lists, smote
from quorum.session import cut_lineage, written
from quorum.sources.tables import contract_problems

# Model names accepted by the registry (others are ignored).
MODEL_NAMES = ["XGBoost", "RandomForest", "LogisticRegression", "SVM", "KNN", "MLP"]


@dataclass
class ModelSpec:
    name: str
    params: dict = field(default_factory=dict)
    seed: int = 42


def create_models(config: dict) -> dict[str, ModelSpec]:
    """M1: enabled models with their parameters; unknown names are ignored."""
    enabled = config.get("models", {}).get("enabled", [])
    params = config.get("model_params", {})
    seed = config.get("data", {}).get("random_state", 42)
    return {n: ModelSpec(n, dict(params.get(n, {})), seed) for n in enabled if n in MODEL_NAMES}


MAX_DEPTH = 30  # of a tree in Spark


class InvalidParameter(ValueError):
    """A parameter value that the model can't take."""


def _max_depth(v):
    """Depth of a tree; None (no limit) becomes Spark's own limit, anything beyond that is an error."""
    if v is None:
        return MAX_DEPTH
    if int(v) > MAX_DEPTH:
        raise InvalidParameter(f"max_depth {v} is beyond Spark's limit of {MAX_DEPTH}")
    return int(v)


def _strength(spec: ModelSpec, n_rows: int | None) -> float:
    """``regParam`` for the inverse strength C of a summed loss: Spark averages the loss over the rows, so 1 / (C n)."""
    c = float(spec.params.get("C", 1.0))
    if c <= 0:
        raise InvalidParameter(f"C must be positive, got {c}")
    return 1.0 / (c * n_rows) if n_rows else 0.0


def build_estimator(spec: ModelSpec, n_features: int, weight_col: str | None = None,
                    features_col: str = "features", label_col: str = "label", n_rows: int | None = None):
    """Map a model spec onto a Spark ML estimator (see README for the parameter map).

    ``n_rows`` of the training frame is needed by LogisticRegression and SVM.
    """
    p, s = spec.params, spec.seed
    common = {"featuresCol": features_col, "labelCol": label_col}
    if spec.name == "XGBoost":
        est = GBTClassifier(**common, maxIter=int(p.get("n_estimators", 100)), maxDepth=_max_depth(p.get("max_depth", 3)),
                            stepSize=float(p.get("learning_rate", 0.1)), subsamplingRate=float(p.get("subsample", 1.0)),
                            featureSubsetStrategy=str(p.get("colsample_bytree", "all")),
                            minInfoGain=float(p.get("gamma", 0.0)),
                            minInstancesPerNode=max(1, int(p.get("min_child_weight", 1))), seed=s)
    elif spec.name == "RandomForest":
        est = RandomForestClassifier(**common, numTrees=int(p.get("n_estimators", 100)),
                                     maxDepth=_max_depth(p.get("max_depth", 5)),
                                     minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                                     featureSubsetStrategy=str(p.get("max_features", "sqrt")),
                                     bootstrap=bool(p.get("bootstrap", True)), seed=s)
    elif spec.name == "LogisticRegression":
        est = LogisticRegression(**common, maxIter=int(p.get("max_iter", 100)), regParam=_strength(spec, n_rows))
    elif spec.name == "SVM":
        est = LinearSVC(**common, maxIter=int(p.get("max_iter", 100)), regParam=_strength(spec, n_rows))
    elif spec.name == "MLP":
        hidden = list(p.get("hidden_layer_sizes", [16]))
        est = MultilayerPerceptronClassifier(**common, layers=[n_features, *hidden, 2],
                                             maxIter=int(p.get("max_iter", 100)), seed=s)
    else:
        raise InvalidParameter(f"'{spec.name}' has no Spark estimator")
    if weight_col and "weightCol" in [x.name for x in est.params]:
        est.setWeightCol(weight_col)
    return est


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def is_assembled(df: DataFrame) -> bool:
    """The rows hold the vector of their features already; a model fitted on them scores such rows only."""
    return "features" in df.columns and isinstance(df.schema["features"].dataType, VectorUDT)


def class_weights(df: DataFrame, label_col: str = "label", positive_weight: float | str = "balanced",
                  weight_col: str = "weight") -> DataFrame:
    """M4: weight per row; a number for the positive class, or 'balanced' = n / (2 n_class)."""
    if positive_weight != "balanced":
        w = F.when(F.col(label_col) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))
        return df.withColumn(weight_col, w)
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    # one row per class: a bounded broadcast
    wts = counts.select(label_col, (F.sum("_nc").over(Window.partitionBy()) / (F.lit(2) * F.col("_nc")))
                        .alias(weight_col))
    return df.join(F.broadcast(wts), label_col)


def _positive_prob(df: DataFrame, prob_col: str = "probability") -> DataFrame:
    return df.withColumn("score", vector_to_array(F.col(prob_col)).getItem(1))


@dataclass
class KnnModel:
    """A nearest-neighbour vote: the training rows and k. ``save`` and ``load`` use Parquet."""

    train: DataFrame
    features: list[str]
    k: int
    id_col: str = "id"

    def transform(self, df: DataFrame) -> DataFrame:
        out = knn_scores(self.train, df, self.features, self.k, self.id_col)
        return out.withColumn("prediction", (F.coalesce("score", F.lit(0.0)) >= 0.5).cast("double"))

    def save(self, path: str) -> None:
        self.train.select(F.col(self.id_col).cast("string").alias(self.id_col), F.col("label").cast("int").alias("label"),
                          *[F.col(c).cast("double").alias(c) for c in self.features]).write.mode("overwrite").parquet(f"{path}/train")
        self.train.sparkSession.createDataFrame([(self.k, self.id_col, self.features)], "k int, id_col string, features array<string>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/knn")

    @classmethod
    def load(cls, spark, path: str) -> KnnModel:
        r = spark.read.parquet(f"{path}/knn").first()
        return cls(spark.read.parquet(f"{path}/train"), list(r["features"]), r["k"], r["id_col"])


def save_model(model, path: str) -> None:
    """Persist a fitted model of any kind."""
    if isinstance(model, (KnnModel, BaggedForest)):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(spark, path: str):
    """A model saved by ``save_model``; ValueError if there is none."""
    for load in (PipelineModel.load, lambda p: KnnModel.load(spark, p), lambda p: BaggedForest.load(spark, p)):
        try:
            return load(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise ValueError(f"there is no stored model at {path}")


def estimator_stages(spec: ModelSpec, features: Sequence[str], weight_col: str | None, n_rows: int | None) -> list:
    """Stages after the assembler. The SVM's margin goes through a logistic stage (Platt scaling), which gives a probability."""
    est = build_estimator(spec, len(features), weight_col, n_rows=n_rows)
    if spec.name != "SVM":
        return [est]
    margin = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1])
    platt = LogisticRegression(featuresCol="margin", labelCol="label", predictionCol="platt_prediction",
                               rawPredictionCol="platt_raw", probabilityCol="probability")
    return [est, margin, platt]


def is_bagged(spec: ModelSpec) -> bool:
    """A forest that weighs classes in each bag or scores out of bag needs its bags as data; both need bags at all."""
    return spec.name == "RandomForest" and bool(spec.params.get("bootstrap", True)) and (
        spec.params.get("class_weight") == "balanced_subsample" or bool(spec.params.get("oob_score")))


def fit(spec: ModelSpec, train: DataFrame, features: Sequence[str], weight_col: str | None = None, id_col: str = "id"):
    """Fit a model of any kind: a pipeline of assembler and estimator, the neighbour vote, or a forest over explicit bags."""
    if spec.name == "KNN":
        return KnnModel(train, list(features), int(spec.params.get("n_neighbors", 5)), id_col)
    if is_bagged(spec):
        tree = build_estimator(spec, len(features))
        # a weight that the call asks for replaces the model's own
        return fit_bagged(train, features, tree, tree.getNumTrees(), spec.seed, balanced=weight_col is None
                          and spec.params.get("class_weight") == "balanced_subsample", weight_col=weight_col, id_col=id_col)
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    n_rows = train.count() if spec.name in ("LogisticRegression", "SVM") else None
    return Pipeline(stages=[*([] if is_assembled(train) else [asm]), *estimator_stages(spec, features, weight_col, n_rows)]).fit(train)


def score(model, df: DataFrame) -> DataFrame:
    """P(class 1) as ``score`` and the 0/1 ``prediction``."""
    out = model.transform(df)
    return out if isinstance(model, (KnnModel, BaggedForest)) else _positive_prob(out)


def knn_scores(train: DataFrame, test: DataFrame, features: Sequence[str], k: int = 5,
               id_col: str = "id", label_col: str = "label") -> DataFrame:
    """KNN model: P(1) = share of positives among the k nearest training rows.

    Labels go along with the neighbours, so that no row is joined to its k labels afterwards. An id of several training rows
    stands for all of their labels.
    """
    vec = lambda d, *more: d.select(F.col(id_col).cast("string").alias(id_col),
                                    F.array(*[F.col(c).cast("double") for c in features]).alias("v"), *more)
    rid, y = F.col(id_col).cast("string"), F.when(F.col(id_col).isNotNull(), F.col(label_col).cast("double"))
    repeated = train.filter(F.col(id_col).isNotNull()).groupBy(rid.alias("_rid")).agg(F.count(F.lit(1)).alias("_rows"))
    if repeated.filter("_rows > 1").isEmpty():
        votes = train.withColumn("_sum", y).withColumn("_n", y.isNotNull().cast("long"))
    else:
        labels = train.groupBy(rid.alias("_rid")).agg(F.sum(y).alias("_sum"), F.count(y).alias("_n"))
        votes = train.withColumn("_rid", rid).join(labels, "_rid", "left")
    lists = knn_lists(vec(test), vec(votes, "_sum", "_n"), k, id_col, "v", kept=["_sum", "_n"])
    total = F.aggregate("best", F.lit(0.0), lambda acc, b: acc + F.coalesce(b["_sum"], F.lit(0.0)))
    n = F.aggregate("best", F.lit(0).cast("long"), lambda acc, b: acc + F.coalesce(b["_n"], F.lit(0).cast("long")))
    probs = lists.select(F.col("qid").alias("_qid"), total.alias("_total"), n.alias("_votes")) \
        .select("_qid", F.when(F.col("_votes") > 0, F.col("_total") / F.col("_votes")).alias("score"))
    return test.join(probs, test[id_col].cast("string") == probs["_qid"], "left").drop("_qid")


def oversample(train: DataFrame, features: Sequence[str], id_col: str, cfg_ratio: float, seed: int,
               label_col: str = "label") -> DataFrame:
    """M3 applied to a training frame: append SMOTE rows over the feature columns."""
    vec = train.select(F.col(id_col).cast("string").alias(id_col), F.col(label_col).cast("int").alias(label_col),
                       F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    synth = smote(vec, id_col, label_col, "_v", ratio=cfg_ratio, seed=seed)
    synth_rows = synth.select(id_col, label_col, *[F.col("_v")[i].alias(c) for i, c in enumerate(features)])
    base = train.select(F.col(id_col).cast("string").alias(id_col), F.col(label_col).cast("int").alias(label_col),
                        *[F.col(c).cast("double").alias(c) for c in features])
    return base.unionByName(synth_rows)


def train_and_score(spec: ModelSpec, train: DataFrame, splits: dict[str, DataFrame], features: Sequence[str],
                    id_col: str = "id", use_smote: bool = False, smote_ratio: float = 0.5, seed: int = 42,
                    positive_weight: float | str | None = None) -> dict[str, DataFrame]:
    """M2: optional oversampling of the training part only, class weights (M4), fit, P(1) on each named split."""
    tr = prepare_training(spec, train, features, id_col, use_smote, smote_ratio, seed, positive_weight)
    model = fit(spec, tr, features, "weight" if "weight" in tr.columns else None, id_col)
    return {n: score(model, d).select(id_col, "label", "score") for n, d in splits.items()}


def positive_weight_of(spec: ModelSpec) -> float | str | None:
    """The class weight of all training rows that a model's parameters ask for: a number for the positive class, 'balanced', or none.

    'balanced_subsample' weighs each bag of a forest by itself (``fit``); without bags it is 'balanced'.
    """
    if spec.params.get("scale_pos_weight") is not None:
        return float(spec.params["scale_pos_weight"])
    asked = spec.params.get("class_weight")
    if asked not in (None, "balanced", "balanced_subsample"):
        raise InvalidParameter(f"class_weight {asked!r}: give 'balanced', 'balanced_subsample' or nothing")
    return "balanced" if asked and not (asked == "balanced_subsample" and is_bagged(spec)) else None


def prepare_training(spec: ModelSpec, train: DataFrame, features: Sequence[str], id_col: str, use_smote: bool,
                     smote_ratio: float, seed: int, positive_weight: float | str | None = None) -> DataFrame:
    """The training frame: oversampled if asked for, with ``weight`` if the call or the model's parameters weigh classes."""
    tr = oversample(train, features, id_col, smote_ratio, seed) if use_smote else train
    weight = positive_weight if positive_weight is not None else positive_weight_of(spec)
    return class_weights(tr, "label", weight) if weight is not None else tr


def cv_evaluate(folded: DataFrame, specs: dict[str, ModelSpec], features: Sequence[str], cfg: EvalConfig,
                id_col: str = "id", use_smote: bool = False, smote_ratio: float = 0.5,
                parallelism: int = 4, search: dict | None = None,
                positive_weight: float | str | None = None, stored: bool = False) -> dict[str, DataFrame]:
    """M6: per model and fold (optionally tune on the training folds), fit on the other
    folds, score the held-out fold; then ONE sweep over all (model, fold), best
    thresholds, exact fold merge. Returns results, fold_results, sweep_avg and
    out-of-fold predictions (model_name, kind, id, score).

    ``search`` = {"spaces": {...}, "n_trials": int, "inner_folds": int} enables M5 inside
    each fold; the model's own name selects its space (the name, not the fold).
    ``positive_weight`` overrides the class weights of the models' parameters.
    The folded frame is written to the shared folder once, for all fits and scores, unless it is ``stored`` already; without
    oversampling it holds the assembled feature vectors too. So is the
    oversampled training frame of each fold: it doesn't depend on the model, and a fit reads its frame several times.
    """
    data = folded.select(id_col, "label", "fold", *features)
    if not stored:
        # a fit reads its rows several times and each model scores its part: vectors that a model takes are assembled here once
        vectors = not use_smote and "features" not in data.columns and any(s.name != "KNN" and not is_bagged(s) for s in specs.values())
        data = written(assemble(data, features) if vectors else data, "folded")
    parallelism = max(1, parallelism)

    def balanced(k):
        return written(oversample(data.filter(F.col("fold") != k), features, id_col, smote_ratio, cfg.seed), "oversampled")

    folds = range(1, cfg.n_splits + 1)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        oversampled = dict(zip(folds, pool.map(balanced, folds))) if use_smote else {}

    def one(task):
        name, k = task
        tr = data.filter(F.col("fold") != k)
        te = data.filter(F.col("fold") == k)
        spec = specs[name]
        if search:
            inner_k = int(search.get("inner_folds", 3))
            inner = stratified_kfold(tr.drop("fold"), id_col, "label", inner_k, cfg.seed)
            spec, _ = hyperparam_search(spec, inner, features, search.get("spaces", {}),
                                        int(search.get("n_trials", 25)), cfg.seed, n_folds=inner_k, id_col=id_col)
        s = train_and_score(spec, oversampled.get(k, tr), {"test": te}, features, id_col, positive_weight=positive_weight)["test"]
        return s.select(F.lit(name).alias("model_name"), F.lit(k).alias("fold"), id_col, "label", "score")

    tasks = [(name, k) for name in specs for k in folds]
    # (model, fold) fits are independent Spark jobs: submit them concurrently from the driver
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        scored = list(pool.map(one, tasks))
    # the scores feed the sweep, the merges and the stored predictions; each reads few of their columns
    oof = written(reduce(DataFrame.unionByName, [s.withColumn(id_col, F.col(id_col).cast("string"))
                                                 .withColumn("label", F.col("label").cast("int")) for s in scored]), "scored")
    sweep = E.threshold_sweep(oof, ["model_name", "fold"], grid=cfg.grid, costs=cfg.costs)
    best = E.best_thresholds(sweep, ["model_name", "fold"])
    preds = oof.select(F.concat(F.lit("kfold_avg_"), "model_name").alias("model_name"), F.lit("oof").alias("kind"),
                       F.col(id_col).cast("string").alias("id"), "score")
    return {"results": E.average_fold_results(best, cfg.costs), "fold_results": E.fold_results(best),
            "sweep_avg": E.average_fold_sweep(sweep), "predictions": preds}


def resolve_space(spaces: dict, model_name: str) -> dict:
    """M5 search space of one model: the 'shared' entries overlaid by the model's own entries."""
    return {**spaces.get("shared", {}), **spaces.get(model_name, {})}


def sample_trials(space: dict, n_trials: int, seed: int) -> list[dict]:
    """Seeded random trials: lists are categorical choices, (lo, hi) tuples are int / float ranges.

    With only categorical entries and a grid no larger than ``n_trials`` every
    combination is tried once.
    """
    wrong = [k for k, v in space.items() if not (isinstance(v, list) and v or isinstance(v, tuple) and len(v) == 2)]
    if wrong:
        raise ValueError(f"search space of {', '.join(sorted(wrong))}: give a list of choices or a (low, high) pair")
    rng = random.Random(seed)
    keys = sorted(space)
    if all(isinstance(space[k], list) for k in keys):
        grid = [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]
        return grid if len(grid) <= n_trials else rng.sample(grid, n_trials)
    out = []
    for _ in range(n_trials):
        t = {}
        for k in keys:
            v = space[k]
            if isinstance(v, list):
                t[k] = rng.choice(v)
            elif isinstance(v[0], int) and isinstance(v[1], int):
                t[k] = rng.randint(v[0], v[1])
            else:
                t[k] = rng.uniform(float(v[0]), float(v[1]))
        out.append(t)
    return out


def hyperparam_search(spec: ModelSpec, folded: DataFrame, features: Sequence[str], space: dict,
                      n_trials: int = 25, seed: int = 42, parallelism: int = 4,
                      n_folds: int = 5, id_col: str = "id") -> tuple[ModelSpec, DataFrame]:
    """M5: seeded random trials over the parameter space, each scored by the mean log loss (A23) of
    its out-of-fold scores over the W1 folds. A combination that the model can't take scores
    -10; any other failure is raised, as is a search without one valid trial. An empty space
    keeps the defaults. ``space`` may be a per-model dict or hold 'shared' / model keys.
    Returns (best spec, trials frame)."""
    if "shared" in space or spec.name in space:
        space = resolve_space(space, spec.name)
    if not space:
        return spec, folded.sparkSession.createDataFrame([], "params string, neg_log_loss double")
    trials = sample_trials(space, n_trials, seed)
    spark = folded.sparkSession
    data = cut_lineage(folded.select(id_col, "label", F.col("fold").cast("int").alias("fold"), *features))

    def trial(t):
        cand = ModelSpec(spec.name, {**spec.params, **t}, spec.seed)
        try:
            if cand.name != "KNN":
                # parameters that Spark refuses fail here, without a job
                build_estimator(cand, len(features), n_rows=1)._transfer_params_to_java()
        except (InvalidParameter, IllegalArgumentException, Py4JJavaError, TypeError, ValueError):
            return json.dumps(t, sort_keys=True), -10.0
        losses = []
        for k in range(1, n_folds + 1):
            s = train_and_score(cand, data.filter(F.col("fold") != k), {"test": data.filter(F.col("fold") == k)}, features, id_col)
            losses.append(s["test"].agg(F.avg(log_loss_expr("label", "score"))).first()[0])
        known = [x for x in losses if x is not None]
        if not known:
            raise ValueError("no fold holds a row to score")
        return json.dumps(t, sort_keys=True), -sum(known) / len(known)

    # trials are independent: run them as concurrent Spark jobs
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(trial, trials))
    best = max(rows, key=lambda r: r[1])
    if best[1] <= -10.0:
        raise InvalidParameter(f"no combination of the search space is valid for {spec.name}")
    out = spark.createDataFrame(rows, "params string, neg_log_loss double")
    return ModelSpec(spec.name, {**spec.params, **json.loads(best[0])}, spec.seed), out


def final_model(spec: ModelSpec, df: DataFrame, features: Sequence[str], cfg: EvalConfig, id_col: str = "id",
                path: str | None = None, use_smote: bool = False, smote_ratio: float = 0.5,
                positive_weight: float | str | None = None) -> tuple[object, DataFrame]:
    """M9: fit on all rows (no oversampling by default, as for production models; the
    k-fold final-model variant sets ``use_smote``), sweep on the training rows, optional
    save (S9) of any kind of model; returns (model, result rows for both optimal thresholds)."""
    train = prepare_training(spec, df, features, id_col, use_smote, smote_ratio, cfg.seed, positive_weight)
    model = fit(spec, train, features, "weight" if "weight" in train.columns else None, id_col)
    scored = score(model, df).select(F.lit(spec.name).alias("model_name"), F.lit(0).alias("fold"), "label", "score")
    sweep = E.threshold_sweep(scored, ["model_name", "fold"], grid=cfg.grid, costs=cfg.costs)
    best = E.best_thresholds(sweep, ["model_name", "fold"])
    res = E.fold_results(best).withColumn("split", F.lit("Full")).withColumn(
        "model_name", F.concat(F.col("model_name"), F.lit("_production")))
    if path:
        save_model(model, path)
    return model, res


def batch_predict(path: str, df: DataFrame, contract: DataFrame | None = None) -> DataFrame:
    """Load a stored model of any kind, check the feature contract, return class and P(1)."""
    if contract is not None and (problems := contract_problems(contract, df)):
        raise ValueError(f"the input does not fit the model's features: {problems}")
    out = score(load_model(df.sparkSession, path), df)
    return out.select(*[c for c in df.columns], F.col("prediction").cast("int").alias("prediction"), "score")
