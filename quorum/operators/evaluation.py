"""Confusion counts, metrics, threshold sweeps and fold merging.

The sweep never crosses rows with thresholds. Each score is mapped to the
number of grid values it reaches (a codegen'd comparison tree); rows are
counted per (group, bucket, label) with map-side partial aggregation, so the
shuffle carries at most groups x (G + 1) rows whatever the table size or key
skew. Per-threshold counts are then suffix sums over that tiny table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.config import KFOLD_PREFIX, Costs, default_grid
from quorum.functions import metrics as M

SWEEP_COLUMNS = ["threshold", "tp", "fp", "tn", "fn", "cost", "total_mistakes",
                 "precision", "recall", "f1_score", "accuracy"]


def confusion_counts(df: DataFrame, group_cols: Sequence[str], label_col: str = "label",
                     pred_col: str = "pred") -> DataFrame:
    """A1: tp, fp, tn, fn per group (zero-safe for one-class input)."""
    y, p = F.col(label_col), F.col(pred_col)
    return df.groupBy(*group_cols).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def with_metrics(counts: DataFrame, costs: Costs, cost_divisor: int | None = None) -> DataFrame:
    """A2 (+A8): append precision/recall/f1/accuracy in percent, cost and cost_total."""
    total = M.cost("fp", "fn", costs)
    return counts.select("*", *M.metric_columns(costs, cost_divisor), total.alias("cost_total"))


def threshold_sweep(long_df: DataFrame, group_cols: Sequence[str], score_col: str = "score",
                    label_col: str = "label", grid: Sequence[float] | None = None,
                    costs: Costs = Costs()) -> DataFrame:
    """A3: confusion counts and metrics at every grid threshold, per group.

    ``score >= t`` predicts 1; NULL / NaN scores predict 0 at every threshold.
    Output: group_cols + SWEEP_COLUMNS, one row per (group, threshold).
    """
    group_cols = list(group_cols)
    g = sorted(set(float(t) for t in (grid if grid is not None else default_grid())))
    n_grid = len(g)
    bucket = M.grid_bucket(M.nan_to_null(score_col), g)
    counts = (long_df.select(*group_cols, bucket.alias("_bucket"), F.col(label_col).cast("long").alias("_y"))
              .groupBy(*group_cols, "_bucket")
              .agg(F.sum("_y").alias("_pos"), F.count(F.lit(1)).alias("_n")))
    per_group = counts.groupBy(*group_cols).agg(
        F.collect_list(F.struct("_bucket", "_pos", "_n")).alias("_cells"),
        F.sum("_pos").alias("_P"), F.sum("_n").alias("_N"))

    def reached(i: Column, field: str) -> Column:
        # rows whose bucket > i, i.e. score >= grid[i]
        return F.aggregate(F.filter("_cells", lambda c: c["_bucket"] > i),
                           F.lit(0).cast("long"), lambda acc, c: acc + c[field])

    points = F.transform(
        F.sequence(F.lit(0), F.lit(n_grid - 1)),
        lambda i: F.struct(i.alias("_i"), reached(i, "_pos").alias("_tp"), reached(i, "_n").alias("_pred")))
    grid_arr = F.array(*[F.lit(t) for t in g])
    exploded = per_group.select(*group_cols, "_P", "_N", F.inline(points))
    swept = exploded.select(
        *group_cols,
        F.element_at(grid_arr, F.col("_i") + 1).alias("threshold"),
        F.col("_tp").alias("tp"),
        (F.col("_pred") - F.col("_tp")).alias("fp"),
        ((F.col("_N") - F.col("_P")) - (F.col("_pred") - F.col("_tp"))).alias("tn"),
        (F.col("_P") - F.col("_tp")).alias("fn"),
    )
    return swept.select(
        *group_cols, "threshold", "tp", "fp", "tn", "fn",
        M.cost("fp", "fn", costs).alias("cost"),
        (F.col("fp") + F.col("fn")).alias("total_mistakes"),
        M.precision("tp", "fp").alias("precision"),
        M.recall("tp", "fn").alias("recall"),
        M.f1_score("tp", "fp", "fn").alias("f1_score"),
        M.accuracy("tp", "fp", "tn", "fn").alias("accuracy"),
    )


_BEST_FIELDS = ["threshold", "precision", "recall", "f1_score", "accuracy", "cost", "tp", "fp", "tn", "fn"]


def best_thresholds(sweep: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """A4: cost-optimal (ties -> lowest threshold) and accuracy-optimal rows per group.

    Accuracy is compared as the integer tp + tn (the row count is fixed per
    group), which avoids float ties.
    """
    group_cols = list(group_cols)
    rec = F.struct(*_BEST_FIELDS)
    best = sweep.groupBy(*group_cols).agg(
        F.min_by(rec, F.struct(F.col("cost"), F.col("threshold"))).alias("_c"),
        F.max_by(rec, F.struct(F.col("tp") + F.col("tn"), -F.col("threshold"))).alias("_a"),
    )
    both = F.array(
        F.struct(F.lit("cost").alias("threshold_type"), *[F.col(f"_c.{f}").alias(f) for f in _BEST_FIELDS]),
        F.struct(F.lit("accuracy").alias("threshold_type"), *[F.col(f"_a.{f}").alias(f) for f in _BEST_FIELDS]),
    )
    return best.select(*group_cols, F.inline(both))


def fold_results(best: DataFrame, model_col: str = "model_name", fold_col: str = "fold") -> DataFrame:
    """A4 rows in the ``results`` layout with split 'Fold{k}'."""
    return best.select(
        F.col(model_col).alias("model_name"),
        F.concat(F.lit("Fold"), F.col(fold_col).cast("string")).alias("split"),
        "threshold_type", "threshold", "precision", "recall", "f1_score", "accuracy", "cost",
        "tp", "fp", "tn", "fn", F.lit(False).alias("is_base_model"), F.col("cost").alias("cost_total"),
    )


def _ordered_mean(value: str, order: str) -> Column:
    """Mean of ``value`` summed sequentially in ``order`` (bit-identical to a fold-ordered loop)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x["v"])
    return total / F.size(items)


def average_fold_results(best: DataFrame, costs: Costs, model_col: str = "model_name",
                         fold_col: str = "fold") -> DataFrame:
    """A5: sum counts and cost over folds, recompute ratios, threshold = mean of fold thresholds."""
    summed = best.groupBy(model_col, "threshold_type").agg(
        _ordered_mean("threshold", fold_col).alias("threshold"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        F.sum("tn").alias("tn"), F.sum("fn").alias("fn"),
        F.sum("cost").alias("cost"),
    )
    return summed.select(
        F.concat(F.lit(KFOLD_PREFIX), F.col(model_col)).alias("model_name"),
        F.lit("Full").alias("split"), "threshold_type", "threshold",
        M.precision("tp", "fp").alias("precision"), M.recall("tp", "fn").alias("recall"),
        M.f1_score("tp", "fp", "fn").alias("f1_score"),
        M.accuracy("tp", "fp", "tn", "fn").alias("accuracy"),
        "cost", "tp", "fp", "tn", "fn", F.lit(False).alias("is_base_model"),
        F.col("cost").alias("cost_total"),
    )


def average_fold_sweep(sweep: DataFrame, model_col: str = "model_name") -> DataFrame:
    """Per (model, threshold) over the union of fold thresholds: sum counts and
    cost and recompute ratios; when a count is missing in any fold, average every
    metric instead (the fallback branch)."""
    complete = F.count_if(F.col("tp").isNull() | F.col("fp").isNull() | F.col("tn").isNull()
                          | F.col("fn").isNull()) == 0
    agg = sweep.groupBy(model_col, "threshold").agg(
        complete.alias("_complete"),
        F.sum("tp").cast("double").alias("_tp"), F.sum("fp").cast("double").alias("_fp"),
        F.sum("tn").cast("double").alias("_tn"), F.sum("fn").cast("double").alias("_fn"),
        F.sum("cost").cast("double").alias("_cost"),
        *[F.avg(c).alias(f"_avg_{c}") for c in ["cost", "accuracy", "precision", "recall", "f1_score",
                                                "tp", "fp", "tn", "fn"]],
    )
    ok = F.col("_complete")

    def pick(summed: Column, name: str) -> Column:
        return F.when(ok, summed).otherwise(F.col(f"_avg_{name}")).alias(name)

    return agg.select(
        F.concat(F.lit(KFOLD_PREFIX), F.col(model_col)).alias("model_name"),
        F.lit("Full").alias("split"), "threshold",
        pick(F.col("_tp"), "tp"), pick(F.col("_fp"), "fp"), pick(F.col("_tn"), "tn"), pick(F.col("_fn"), "fn"),
        pick(F.col("_cost"), "cost"),
        pick(M.precision("_tp", "_fp"), "precision"), pick(M.recall("_tp", "_fn"), "recall"),
        pick(M.f1_score("_tp", "_fp", "_fn"), "f1_score"),
        pick(M.accuracy("_tp", "_fp", "_tn", "_fn"), "accuracy"),
    )


def decision_results(counts: DataFrame, costs: Costs, n_splits: int, threshold_type: str,
                     model_col: str = "model_name", split: str = "Full") -> DataFrame:
    """A2 + A8 in the ``results`` layout for decision / combined runs (cost / n_splits)."""
    total = M.cost("fp", "fn", costs)
    return counts.select(
        F.col(model_col).alias("model_name"), F.lit(split).alias("split"),
        F.lit(threshold_type).alias("threshold_type"), F.lit(None).cast("double").alias("threshold"),
        M.precision("tp", "fp").alias("precision"), M.recall("tp", "fn").alias("recall"),
        M.f1_score("tp", "fp", "fn").alias("f1_score"),
        M.accuracy("tp", "fp", "tn", "fn").alias("accuracy"),
        (total / F.lit(int(n_splits))).alias("cost"),
        "tp", "fp", "tn", "fn", F.lit(True).alias("is_base_model"), total.alias("cost_total"),
    )


def fold_positions(df: DataFrame, id_col: str, seed: int, group_cols: Sequence[str] = ("fold",), bucket_hex: int | None = None,
                   within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``position``, the row's rank inside its fold in the canonical (md5) order, and ``_min_n``, the size of
    the shortest fold (of those that share the ``within`` columns).

    The ranking is two-phase (see folds.hash_rank), so no fold is sorted in one task.
    """
    from quorum.operators.folds import hash_rank

    return hash_rank(df, list(group_cols), id_col, seed, bucket_hex, rank_col="position", smallest=("_min_n", list(within)))


def positional_mean(scores: DataFrame, id_col: str, seed: int, model_col: str = "model_name",
                    fold_col: str = "fold", score_col: str = "score", bucket_hex: int | None = None) -> DataFrame:
    """Mean of the i-th score across folds, truncated to the shortest fold.

    Position i is the row's rank inside its fold (``fold_positions``). Where every model scores the same rows,
    they may be ranked before they are unpivoted, once for all models: ``scores`` then has these columns already.
    """
    ranked = scores
    if not {"position", "_min_n"} <= set(scores.columns):
        ranked = fold_positions(scores.select(model_col, fold_col, id_col, score_col), id_col, seed, [model_col, fold_col],
                                bucket_hex, [model_col])
    return (ranked.filter(F.col("position") <= F.col("_min_n"))
            .withColumn(score_col, M.nan_to_null(score_col))
            .groupBy(model_col, "position")
            .agg(_ordered_mean(score_col, fold_col).alias("mean_score")))
