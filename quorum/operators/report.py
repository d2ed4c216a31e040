"""Result-table slicing and reports (M12-M15, P8, P14-P18, P21-P23, W3, W4,
O1-O5, U1-U4, A22-A24, J6, J7, J9).

All inputs are the normalised result tables:
  results(model_name, split, threshold_type, threshold, precision, recall,
          f1_score, accuracy, cost, tp, fp, tn, fn, is_base_model, cost_total)
  sweep(model_name, split, threshold, tp, fp, tn, fn, cost, precision, ...)
  importance(feature, importance[, position])
Every operator is a DataFrame expression; arrays are only built per model
over a bounded number of items (grid points, result rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.config import KFOLD_PREFIX
from quorum.functions.metrics import nan_to_null
from quorum.functions.labels import display_label, normalise_model_name

METRICS = ["accuracy", "precision", "recall", "f1_score"]
THRESHOLD_TYPES = ("cost", "accuracy")


def union_runs(*frames: DataFrame) -> DataFrame:
    """Concatenate result sets; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def filter_results(results: DataFrame, split: str | None = None, threshold_type: str = "All",
                   models: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Filter by split, threshold type ('All' = no filter) and model list (empty = no filter).

    ``strict=True`` raises when nothing matches, listing the available values
    (one small distinct query over the result table).
    """
    out = _filter(results, split, threshold_type, models)
    if strict and out.isEmpty():
        avail = results.agg(F.array_sort(F.collect_set("split")).alias("splits"),
                            F.array_sort(F.collect_set("threshold_type")).alias("types"),
                            F.array_sort(F.collect_set("model_name")).alias("models")).collect()[0]
        raise ValueError(f"No results for split={split}, threshold_type={threshold_type}, models={list(models)}. "
                         f"Available splits: {avail['splits']}, types: {avail['types']}, models: {avail['models']}")
    return out


def _filter(results: DataFrame, split, threshold_type, models) -> DataFrame:
    out = results
    if split is not None:
        out = out.filter(F.col("split") == split)
    if threshold_type != "All":
        out = out.filter(F.col("threshold_type") == threshold_type)
    if models:
        out = out.filter(F.col("model_name").isin(list(models)))
    return out


def with_display_label(results: DataFrame) -> DataFrame:
    """Add ``label`` = "{model} (τ=x.xx)" or the plain name when threshold is NULL."""
    return results.withColumn("label", display_label("model_name", "threshold"))


def melt_metrics(results: DataFrame, ids: Sequence[str] = ("model_name", "split", "threshold_type")) -> DataFrame:
    """Wide -> long over accuracy, precision, recall, f1_score."""
    return results.select(*ids, *METRICS).unpivot(list(ids), METRICS, "metric", "score")


def confusion_view(results: DataFrame) -> DataFrame:
    """Confusion columns plus total_samples."""
    return results.select("model_name", "split", "threshold_type", "tp", "fp", "tn", "fn",
                          (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("total_samples"))


def confusion_layout(results: DataFrame) -> DataFrame:
    """2x2 matrix [[tn, fp], [fn, tp]] as long cells (actual, predicted, n)."""
    cells = F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")),
    )
    return results.select("model_name", "split", "threshold_type", F.inline(cells))


def radar_projection(results: DataFrame) -> DataFrame:
    """Ordered metric vector per result row."""
    return results.select("model_name", "split", "threshold_type", F.array(*METRICS).alias("metrics"))


def sweep_projection(sweep: DataFrame, data_type: str = "costs", model: str | None = None,
                     predictions: DataFrame | None = None) -> DataFrame:
    """Ordered series of thresholds / costs / accuracies / f1_scores of every model, or of ``model``.

    A model without a sweep is an error that names the models there are. The
    data type 'probabilities' gives the (model_name, id, score) rows of ``predictions``,
    which are as many as the table's and so stay rows.
    """
    if model is not None:
        if sweep.filter(F.col("model_name") == model).isEmpty():
            known = [r[0] for r in sweep.select("model_name").distinct().orderBy("model_name").collect()]
            raise ValueError(f"no sweep of {model}; there are sweeps of {', '.join(known)}")
        sweep = sweep.filter(F.col("model_name") == model)
        predictions = predictions.filter(F.col("model_name") == model) if predictions is not None else None
    if data_type == "probabilities":
        if predictions is None:
            raise ValueError("the data type 'probabilities' needs the predictions")
        return predictions.select("model_name", "id", nan_to_null("score").alias("score"))
    fields = {"thresholds": "threshold", "costs": "cost", "accuracies": "accuracy", "f1_scores": "f1_score",
              "precisions": "precision", "recalls": "recall"}
    if data_type not in fields:
        raise ValueError(f"unknown data type {data_type}; there are {', '.join(sorted([*fields, 'probabilities']))}")
    pts = F.array_sort(F.collect_list(F.struct("threshold", F.col(fields[data_type]).alias("v"))))
    return sweep.groupBy("model_name").agg(pts.alias("_p")).select(
        "model_name", F.lit(data_type).alias("data_type"),
        F.col("_p.threshold").alias("thresholds"), F.col("_p.v").alias("values"))


def pick_sweep_split(sweep: DataFrame, split_col: str = "split") -> DataFrame:
    """M13 store form: per model keep the 'Full' sweep, else the 'oof' one, else the first split by name."""
    pref = F.when(F.col(split_col) == "Full", 0).when(F.col(split_col) == "oof", 1).otherwise(2)
    splits = sweep.select("model_name", split_col).distinct()
    w = Window.partitionBy("model_name").orderBy(pref, F.col(split_col))
    chosen = splits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return sweep.join(F.broadcast(chosen), ["model_name", split_col])  # one row per model: bounded


def sweep_series(sweep: DataFrame) -> DataFrame:
    """Aligned ordered series per metric + the cost- and accuracy-optimal thresholds
    (when the sweep holds several splits, the store form picks one per model first)."""
    if "split" in sweep.columns:
        sweep = pick_sweep_split(sweep)
    pts = F.array_sort(F.collect_list(F.struct("threshold", "precision", "recall", "f1_score", "accuracy", "cost")))
    best_cost = F.min_by("threshold", F.struct("cost", "threshold"))
    best_acc = F.max_by("threshold", F.struct(F.col("tp") + F.col("tn"), -F.col("threshold")))
    agg = sweep.groupBy("model_name").agg(pts.alias("_p"), best_cost.alias("cost_optimal_threshold"),
                                          best_acc.alias("accuracy_optimal_threshold"))
    return agg.select("model_name", *[F.col(f"_p.{f}").alias(f) for f in
                                      ["threshold", "precision", "recall", "f1_score", "accuracy", "cost"]],
                      "cost_optimal_threshold", "accuracy_optimal_threshold")


def sweep_compare(sweep: DataFrame, models: Sequence[str] = ()) -> DataFrame:
    """Cost, accuracy, f1 versus threshold for several models (long form)."""
    s = sweep.filter(F.col("model_name").isin(list(models))) if models else sweep
    return s.select("model_name", "threshold", "cost", "accuracy", "f1_score").unpivot(
        ["model_name", "threshold"], ["cost", "accuracy", "f1_score"], "metric", "value")


def first_match(results: DataFrame, split: str, threshold_type: str) -> DataFrame:
    """Per model the (split, type) row, else a base / combined row of that split."""
    split = split[:1].upper() + split[1:].lower()
    pref = F.when(F.col("threshold_type") == threshold_type, 0).when(F.col("is_base_model"), 1)
    cand = results.filter((F.col("split") == split) & pref.isNotNull()).withColumn("_pref", pref)
    w = Window.partitionBy("model_name").orderBy("_pref", "threshold_type")
    return cand.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_pref")


def model_comparison(results: DataFrame, threshold_type: str, split: str = "Test",
                     strict: bool = False) -> DataFrame:
    """One row per model at (threshold_type, split) with fallback; NULL metric -> 0.0.

    Raises for a type other than 'cost' / 'accuracy'; with ``strict=True`` an
    empty comparison raises "No results for split=..., threshold_type=...".
    """
    if threshold_type not in THRESHOLD_TYPES:
        raise ValueError(f"unknown threshold_type {threshold_type!r}, known: {', '.join(map(repr, THRESHOLD_TYPES))}")
    m = first_match(results, split, threshold_type)
    if strict and m.isEmpty():
        # fixed value: this message
        raise RuntimeError(f"No results for split={split[:1].upper() + split[1:].lower()}, "
                           f"threshold_type={threshold_type}")
    return m.select("model_name", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                                    for c in ["precision", "recall", "f1_score", "accuracy", "cost"]],
                    "threshold", F.lit(split[:1].upper() + split[1:].lower()).alias("split_name"),
                    F.lit(threshold_type).alias("threshold_type"))


def performance_report(results: DataFrame, meta_models: Sequence[str],
                       splits: Sequence[str] = ("Train", "Test", "Full"),
                       thr_types: Sequence[str] = THRESHOLD_TYPES) -> DataFrame:
    """Sections 'meta' (configured models, compared on normalised names),
    'base' (threshold_type 'base') and 'kfold' (k-fold averaged runs), rounded."""
    norm = normalise_model_name("model_name")
    metas = [m.replace(KFOLD_PREFIX, "") for m in meta_models]
    in_splits = F.col("split").isin(list(splits))
    sections = {
        "meta": norm.isin(metas) & in_splits & F.col("threshold_type").isin(list(thr_types)),
        "base": ~norm.isin(metas) & in_splits & (F.col("threshold_type") == "base"),
        "kfold": F.col("model_name").startswith(KFOLD_PREFIX),
    }
    # a row may stand in several sections; one pass finds all of them
    out = results.withColumn("section", F.explode(F.array_compact(F.array(
        *[F.when(cond, F.lit(name)) for name, cond in sections.items()]))))
    return out.select("section", "model_name", "split", "threshold_type",
                      *[F.round(c, 1).alias(c) for c in ["accuracy", "precision", "recall"]],
                      F.round("threshold", 3).alias("threshold"), "cost", "tp", "fp", "tn", "fn")


def except_models(results: DataFrame, meta_models: Sequence[str]) -> DataFrame:
    """Models in the results minus meta models, compared on normalised names."""
    spark = results.sparkSession
    metas = spark.createDataFrame([(m.replace(KFOLD_PREFIX, ""),) for m in meta_models], "norm string")
    names = results.select("model_name").distinct().withColumn("norm", normalise_model_name("model_name"))
    return names.join(F.broadcast(metas), "norm", "left_anti").select("model_name")


def group_by_model(results: DataFrame) -> DataFrame:
    """Result records collected per model (bounded: a few rows per model), deterministic order."""
    fields = ["split", "threshold_type", "threshold", "accuracy", "cost", "tp", "fp", "tn", "fn"]
    recs = F.array_sort(F.collect_list(F.struct(*fields)))
    return results.groupBy("model_name").agg(recs.alias("_r")).select(
        "model_name", F.size("_r").cast("long").alias("n_records"), *[F.col(f"_r.{f}").alias(f"{f}s") for f in fields])


def store_summary(datasets: dict[str, DataFrame]) -> DataFrame:
    """Row count and sorted distinct model names of each stored dataset. Rows are counted by name first, so that
    names are collected from one row each."""
    parts = [df.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))
             .agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"),
                  F.array_sort(F.collect_set("model_name")).alias("models")).withColumn("dataset", F.lit(name))
             for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, parts).select("dataset", "rows", "models")


def metrics_scores_join(results: DataFrame, predictions: DataFrame) -> DataFrame:
    """Attach each model's prediction series (summarised) to its metric rows (left join)."""
    per_model = predictions.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n_predictions"), F.count_distinct("kind").alias("n_kinds"))
    return results.join(per_model, "model_name", "left")


# --- importance tables -------------------------------------------------------------------------

def importance_rank(imp: DataFrame) -> DataFrame:
    """W3 + O1: 1-based rank by importance descending (ties by position, then name)."""
    order = [F.desc("importance")] + ([F.asc("position")] if "position" in imp.columns else []) + [F.asc("feature")]
    return imp.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def importance_outer(tables: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of importance tables on feature; missing -> 0.0."""
    frames = [t.select("feature", F.col("importance").alias(name)) for name, t in tables.items()]
    joined = reduce(lambda a, b: a.join(b, "feature", "full_outer"), frames)
    return joined.select("feature", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in tables])


def importance_diff(tables: dict[str, DataFrame]) -> DataFrame:
    """O2: exactly two models: Difference = a - b, ordered by |difference| descending."""
    if len(tables) != 2:
        raise ValueError("importance_diff needs exactly two models")
    a, b = list(tables)
    j = importance_outer(tables)
    return j.withColumn("difference", F.col(a) - F.col(b)).orderBy(F.desc(F.abs("difference")), "feature")


def topk_features(tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """O3: top-k features per model side by side ('N/A' when a model has fewer)."""
    ranked = [importance_rank(t).filter(F.col("rank") <= k).select("rank", F.col("feature").alias(name))
              for name, t in tables.items()]
    spine = ranked[0].sparkSession.range(1, k + 1).select(F.col("id").alias("rank"))
    out = reduce(lambda acc, r: acc.join(r, "rank", "left"), ranked, spine)
    return out.select("rank", *[F.coalesce(F.col(n), F.lit("N/A")).alias(n) for n in tables])
