"""Evaluation plans composed from the operators (M6-M8, M16 building blocks).

Every plan is lazy and returns DataFrames; several result families are
computed from one shared long frame so Spark can reuse exchanges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.config import KFOLD_PREFIX, EvalConfig
from quorum.operators import evaluation as E
from quorum.operators import prep as PR
from quorum.operators.folds import check_unique_ids, stratified_kfold
from quorum.operators.models import cv_evaluate, final_model
from quorum.operators.prep import encode_decision, encode_target
from quorum.operators.report import performance_report, union_runs
from quorum.operators.rules import combined_runs, ruled_ids, ruled_long, ruled_predictions
from quorum.session import cut_lineage, written
from quorum.sources.tables import run_datasets


def long_scores(df: DataFrame, id_col: str, score_cols: Sequence[str], keep: Sequence[str] = ("label", "fold"),
                model_col: str = "model_name", score_col: str = "score") -> DataFrame:
    """Unpivot score columns into (id, keep..., model_name, score); missing columns are skipped."""
    present = [c for c in score_cols if c in df.columns]
    if not present:
        raise ValueError(f"None of the score columns {list(score_cols)} exist")
    wide = df.select(id_col, *keep, *[F.col(c).cast("double").alias(c) for c in present])
    return wide.unpivot([id_col, *keep], present, model_col, score_col)


def folded(df: DataFrame, cfg: EvalConfig, id_col: str, target: str) -> DataFrame:
    """P2 then W1: add integer ``label`` and ``fold``."""
    labelled = encode_target(df, target, cfg.good_tag, cfg.bad_tag)
    return stratified_kfold(labelled, id_col, "label", cfg.n_splits, cfg.seed, cfg.fold_bucket_hex,
                            mode=cfg.fold_mode)


def score_column_sweeps(df: DataFrame, cfg: EvalConfig, id_col: str, target: str,
                        score_cols: Sequence[str]) -> DataFrame:
    """A3 per (score column, fold)."""
    return folded_sweeps(folded(df, cfg, id_col, target), cfg, id_col, score_cols)


def folded_sweeps(rows: DataFrame, cfg: EvalConfig, id_col: str, score_cols: Sequence[str]) -> DataFrame:
    """A3 per (score column, fold) of rows that have ``label`` and ``fold``."""
    return E.threshold_sweep(long_scores(rows, id_col, score_cols), ["model_name", "fold"], grid=cfg.grid, costs=cfg.costs)


class ScoreColumnEval:
    """M7 result families of a sweep, built lazily on first access (each is one DataFrame plan)."""

    def __init__(self, sweep: DataFrame, cfg: EvalConfig):
        self.cfg = cfg
        self.sweep = sweep
        self._best = None

    def stored(self) -> ScoreColumnEval:
        """The families read from the sweep's few rows, written once: for callers of several, each of which would rank all rows."""
        return ScoreColumnEval(cut_lineage(self.sweep), self.cfg)

    @property
    def best(self) -> DataFrame:
        if self._best is None:
            self._best = E.best_thresholds(self.sweep, ["model_name", "fold"])
        return self._best

    @property
    def results(self) -> DataFrame:
        return E.average_fold_results(self.best, self.cfg.costs)

    @property
    def fold_results(self) -> DataFrame:
        return E.fold_results(self.best)

    @property
    def sweep_avg(self) -> DataFrame:
        return E.average_fold_sweep(self.sweep)

    def __getitem__(self, key: str) -> DataFrame:
        return getattr(self, key)


def score_column_eval(df: DataFrame, cfg: EvalConfig, id_col: str, target: str,
                      score_cols: Sequence[str]) -> ScoreColumnEval:
    """M7: fold sweeps -> per-fold best -> k-fold average, for score columns already in the table."""
    return ScoreColumnEval(score_column_sweeps(df, cfg, id_col, target, score_cols), cfg)


def decision_long(df: DataFrame, cfg: EvalConfig, id_col: str, target: str,
                  decision_cols: Sequence[str]) -> DataFrame:
    """P2 + P3 + P4 + unpivot: (id, label, model_name, pred)."""
    labelled = encode_target(df, target, cfg.good_tag, cfg.bad_tag)
    enc = labelled.select(id_col, "label", *[encode_decision(c, cfg.good_tag, cfg.bad_tag).alias(c)
                                              for c in decision_cols])
    return enc.unpivot([id_col, "label"], list(decision_cols), "model_name", "pred")


def decision_column_eval(df: DataFrame, cfg: EvalConfig, id_col: str, target: str,
                         decision_cols: Sequence[str]) -> DataFrame:
    """M8: one aggregate over all decision columns; split 'Full', type 'base', cost / n_splits."""
    for c in decision_cols:
        if c not in df.columns:
            raise ValueError(f"there is no decision column {c}")
    long = decision_long(df, cfg, id_col, target, decision_cols)
    counts = E.confusion_counts(long, ["model_name"], "label", "pred")
    return E.decision_results(counts, cfg.costs, cfg.n_splits, "base")


def base_predictions(df: DataFrame, cfg: EvalConfig, id_col: str, score_cols: Sequence[str],
                     decision_cols: Sequence[str]) -> DataFrame:
    """predictions(model_name, kind, id, score) for the table's own columns.

    Score columns are evaluated out of fold; since every row sits in exactly
    one test fold, the scattered out-of-fold series (J2) is the column itself,
    named ``kfold_avg_{col}`` with kind 'oof'. Decision columns become 0/1
    series of kind 'Full'.

    All series come from one scan, and the rows of an id follow each other, so
    that aggregates by id merge them before their shuffle and files compress them.
    """
    series = [(f"{KFOLD_PREFIX}{c}", "oof", F.col(c).cast("double")) for c in score_cols if c in df.columns]
    series += [(c, "Full", encode_decision(c, cfg.good_tag, cfg.bad_tag).cast("double")) for c in decision_cols]
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(model).alias("model_name"), F.lit(kind).alias("kind"), F.col(id_col).alias("id"), score.alias("score"))
        for model, kind, score in series])))


def labels_of(df: DataFrame, cfg: EvalConfig, id_col: str, target: str) -> DataFrame:
    return encode_target(df, target, cfg.good_tag, cfg.bad_tag).select(F.col(id_col).alias("id"), "label")


def apply_rules(store, run_id: str, rules, cfg: EvalConfig, model_thresholds: dict | None = None) -> DataFrame:
    """Evaluate the enabled rules over a stored run and put their results into its
    metrics, confusion counts, summary and predictions; return the combined results.

    Rules in one call see only runs stored before the call. A rule applied again
    replaces what it stored before. The rules are evaluated once, into a file of one row
    an id that both results are read from before anything is stored, and all four datasets
    change in one commit. Every prediction of an id counts with every label of it.
    """
    enabled = [r for r in rules if r.enabled and r.columns]
    names = [r.name for r in enabled]
    if not enabled:
        return store.load("model_metrics", run_id).limit(0).drop("run_id")
    others = ~F.col("model_name").isin(names)
    preds = store.load("predictions", run_id).drop("run_id").filter(others)
    labels = store.load("labels", run_id).drop("run_id")
    every = F.collect_list("label").over(Window.partitionBy("id"))  # in the order that the rules' join left the rows in
    ruled = written(ruled_ids(preds, labels, enabled, model_thresholds).withColumn("labels", every), "ruled")
    counted = ruled_long(ruled.withColumn("label", F.explode("labels")), names)
    results = cut_lineage(E.decision_results(E.confusion_counts(counted, ["model_name"], "label", "pred"), cfg.costs,
                                             cfg.n_splits, "combined"))
    store.replace_models(run_id, run_datasets(results) | {"predictions": ruled_predictions(ruled_long(ruled, names))}, names)
    return store.load("model_metrics", run_id).filter(~others).drop("run_id")


def run_end_to_end(df: DataFrame, cfg: EvalConfig, id_col: str, target: str, specs: dict,
                 score_cols=(), decision_cols=(), rules=(), excludes=(), variance_threshold: float | None = None,
                 correlation_threshold: float | None = None, use_smote: bool = False, smote_ratio: float = 0.5,
                 search: dict | None = None, final_models: bool = False, model_path: str | None = None,
                 validate_ids: bool = True) -> dict:
    """Prepare -> folds -> model CV (M6, with M5 inside the folds if ``search`` is given)
    -> score columns (M7) -> decisions (M8) -> rules (B9) -> one results table (U1), the
    averaged sweeps, predictions, labels and the performance report (M14). ``final_models``
    also fits every model on all rows (M9) and saves it under ``model_path``."""
    if not (specs or [c for c in score_cols if c in df.columns] or decision_cols):
        raise ValueError("give at least one model, score column or decision column")
    if validate_ids:
        check_unique_ids(df, id_col)
    labelled = encode_target(df, target, cfg.good_tag, cfg.bad_tag)
    feats = PR.project_features(labelled, target, [id_col, "label", *excludes], list(decision_cols))
    cats = PR.split_dtypes(feats)[1]
    frame = PR.one_hot_drop_first(labelled, cats)[0] if cats else labelled
    numeric = set(PR.split_dtypes(frame)[0])
    skip = {id_col, "label", target, *excludes, *decision_cols}
    features = [c for c in frame.columns if c in numeric and c not in skip]
    if variance_threshold is not None:
        features = PR.kept_features(PR.variance_filter(frame, features, variance_threshold), features)
    if correlation_threshold is not None:
        rep = PR.correlation_filter(frame, features, correlation_threshold)
        kept = {r["feature"] for r in rep.filter("kept").collect()}
        features = [c for c in features if c in kept]
    folded_df = stratified_kfold(frame, id_col, "label", cfg.n_splits, cfg.seed, cfg.fold_bucket_hex,
                                 mode=cfg.fold_mode)
    scores = [c for c in score_cols if c in df.columns]
    # the models and the score columns have the same folds, so the rows are ranked and written once for both
    shared = bool(specs) and all(c in frame.columns and c not in (id_col, "label", "fold") for c in scores)
    if specs:
        folded_df = written(folded_df.select(id_col, "label", "fold", *dict.fromkeys([*features, *(scores if shared else [])])), "folded")
    parts, preds, sweeps, models = [], [], [], {}
    if specs:
        cv = cv_evaluate(folded_df, specs, features, cfg, id_col, use_smote, smote_ratio, search=search, stored=True)
        parts.append(cv["results"])
        sweeps.append(cv["sweep_avg"])
        preds.append(cv["predictions"])
        if final_models:
            for name, spec in specs.items():
                models[name], rows = final_model(spec, folded_df, features, cfg, id_col,
                                                 f"{model_path}/{name}" if model_path else None)
                parts.append(rows)
    if score_cols:
        evaluated = ScoreColumnEval(folded_sweeps(folded_df, cfg, id_col, score_cols), cfg) if shared \
            else score_column_eval(df, cfg, id_col, target, score_cols)
        parts.append(evaluated["results"])
        sweeps.append(evaluated["sweep_avg"])
    if decision_cols:
        parts.append(decision_column_eval(df, cfg, id_col, target, decision_cols))
    if score_cols or decision_cols:
        preds.append(base_predictions(df, cfg, id_col, score_cols, decision_cols))
    predictions = preds[0]
    for p in preds[1:]:
        predictions = predictions.unionByName(p)
    labels = labels_of(df, cfg, id_col, target)
    if rules:
        res, comb = combined_runs(predictions, labels, rules, cfg.costs, cfg.n_splits)
        parts.append(res)
        predictions = predictions.unionByName(comb)
    results = cut_lineage(union_runs(*parts))  # stored and reported
    return {"results": results, "predictions": predictions, "labels": labels, "features": features, "models": models,
            "sweep_avg": union_runs(*sweeps) if sweeps else None,
            "report": performance_report(results, [f"{KFOLD_PREFIX}{n}" for n in specs])}
