"""ROC and precision-recall curves, their trapezoid areas and score
histograms (A19, A20, A21, W5).

Both curves need, for every distinct score s of a model, the number of
positives and negatives scored >= s (a descending cumulative count).
``suffix_totals`` computes it exactly without putting a model's whole score
range into one task: distinct scores are dealt into ranges of about
``RANGE_ROWS`` rows (any cut is fine, the result stays exact), range totals
give each range's offset, and the running sum only runs inside a range.

The ROC area is accumulated as an exact integer (decimal) numerator and
divided once, so it does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.functions import metrics as M
from quorum.session import cut_lineage

HIST_BINS = 50
RANGE_ROWS = 100_000  # distinct scores of a range


def suffix_totals(counts: DataFrame, group_cols: Sequence[str], order_col: str, value_cols: Sequence[str],
                  range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``cum_{v}`` = sum of v over rows of the same group with ``order_col >=`` this row's.

    ``counts`` must hold one row per (group, order value).
    """
    group_cols = list(group_cols)
    n_ranges = max(1, -(-counts.count() // range_rows))
    # written once: a range is a partition of this table, whichever task reads it later
    ranged = cut_lineage(counts.repartitionByRange(n_ranges, *group_cols, order_col).withColumn("_bk", F.spark_partition_id()))
    totals = ranged.groupBy(*group_cols, "_bk").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    higher = Window.partitionBy(*group_cols).orderBy(F.col("_bk").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, "_bk", *[F.coalesce(F.sum(f"_t_{v}").over(higher), F.lit(0))
                                                  .alias(f"_o_{v}") for v in value_cols])
    inside = Window.partitionBy(*group_cols, "_bk").orderBy(F.col(order_col).desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the offsets are joined on the partitioning of the running sums, which shuffles the rows once for both
    out = ranged.join(offsets, group_cols + ["_bk"])
    return out.select(*counts.columns, *[(F.col(f"_o_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}")
                                         for v in value_cols])


def score_label_counts(long: DataFrame, model_col: str = "model_name", score_col: str = "score",
                       label_col: str = "label") -> DataFrame:
    """(model, score, pos, neg) per distinct non-missing score, plus class totals P, N per model."""
    s = M.nan_to_null(score_col)
    base = long.select(F.col(model_col).alias("model_name"), s.alias("score"), F.col(label_col).cast("long").alias("_y")) \
        .filter(F.col("score").isNotNull())
    counts = base.groupBy("model_name", "score").agg(F.sum("_y").alias("pos"),
                                                      (F.count(F.lit(1)) - F.sum("_y")).alias("neg"))
    # the per-score table feeds four branches (bounds, offsets, running sums, totals); write it
    # once to the shared checkpoint folder instead of re-scanning the input for each branch
    counts = cut_lineage(counts)
    cum = suffix_totals(counts, ["model_name"], "score", ["pos", "neg"])
    totals = counts.groupBy("model_name").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.join(F.broadcast(totals), "model_name")


def roc_curve(long: DataFrame, **kw) -> DataFrame:
    """(model_name, score, fpr, tpr) at every distinct score, plus the origin (score NULL)."""
    c = score_label_counts(long, **kw)
    pts = c.select("model_name", "score", M.frac("cum_neg", "N").alias("fpr"), M.frac("cum_pos", "P").alias("tpr"))
    origin = c.select("model_name").distinct().select(
        "model_name", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def roc_curve_reduced(long: DataFrame, range_rows: int = RANGE_ROWS, **kw) -> DataFrame:
    """The points of ``roc_curve`` without those in the middle of two equal steps, which lie on a straight line.

    A point goes if the step from the next higher score to it equals the step
    from it to the next lower one, in both counts; the first and last points and
    the origin stay, so the polyline and its area are unchanged. The next lower
    score is found inside the point's range; the last point of a range takes the
    first of the next range, of which there is one row a range.
    """
    c = score_label_counts(long, **kw)
    n_ranges = max(1, -(-c.count() // range_rows))
    ranged = cut_lineage(c.repartitionByRange(n_ranges, "model_name", "score").withColumn("_bk", F.spark_partition_id()))
    head = F.struct("score", "pos", "neg")
    heads = ranged.groupBy("model_name", "_bk").agg(F.max(head).alias("_head"))
    by_head = Window.partitionBy("model_name").orderBy(F.col("_head.score").desc())
    borders = heads.select("model_name", "_bk", F.lead("_head").over(by_head).alias("_below"),
                           (F.row_number().over(by_head) == 1).alias("_top"))
    inside = Window.partitionBy("model_name", "_bk").orderBy(F.col("score").desc())
    rows = ranged.withColumn("_next", F.lead(head).over(inside)) \
        .withColumn("_first", F.row_number().over(inside) == 1).join(borders, ["model_name", "_bk"]) \
        .withColumn("_next", F.coalesce("_next", "_below"))
    straight = (F.col("_next.pos") == F.col("pos")) & (F.col("_next.neg") == F.col("neg")) & ~(F.col("_first") & F.col("_top"))
    kept = rows.filter(~F.coalesce(straight, F.lit(False)))
    origin = c.select("model_name").distinct().select(
        "model_name", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return kept.select("model_name", "score", M.frac("cum_neg", "N").alias("fpr"),
                       M.frac("cum_pos", "P").alias("tpr")).unionByName(origin)


def roc_auc(long: DataFrame, **kw) -> DataFrame:
    """Trapezoid area under the ROC curve, exact integer numerator."""
    c = score_label_counts(long, **kw)
    dec = "decimal(38,0)"
    area2 = F.col("neg").cast(dec) * (F.lit(2) * F.col("cum_pos") - F.col("pos")).cast(dec)
    agg = c.groupBy("model_name").agg(F.sum(area2).alias("_num"), F.first("P").alias("P"), F.first("N").alias("N"))
    den = F.lit(2.0) * F.col("P") * F.col("N")
    return agg.select("model_name", F.when(den > 0, F.col("_num").cast("double") / den).alias("roc_auc"))


def _pr_points(c: DataFrame) -> DataFrame:
    prec = M.frac("cum_pos", F.col("cum_pos") + F.col("cum_neg"))
    prev_pos = F.col("cum_pos") - F.col("pos")
    prev_all = prev_pos + F.col("cum_neg") - F.col("neg")
    prev_prec = F.when(prev_all > 0, prev_pos / prev_all).otherwise(F.lit(1.0))
    rec = F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).otherwise(F.lit(1.0))
    return c.select("model_name", "score", "pos", "P", prec.alias("precision"), rec.alias("recall"),
                    prev_prec.alias("_prev_precision"))


def pr_curve(long: DataFrame, **kw) -> DataFrame:
    """(model_name, score, precision, recall) per distinct score plus the end point (recall 0, precision 1)."""
    pts = _pr_points(score_label_counts(long, **kw))
    end = pts.select("model_name").distinct().select(
        "model_name", F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return pts.select("model_name", "score", "precision", "recall").unionByName(end)


def pr_auc(long: DataFrame, **kw) -> DataFrame:
    """Trapezoid area over recall, starting from (recall 0, precision 1)."""
    pts = _pr_points(score_label_counts(long, **kw))
    area = F.when(F.col("P") > 0, F.col("pos") / F.col("P")).otherwise(F.lit(0.0)) \
        * (F.col("precision") + F.col("_prev_precision")) / 2
    return pts.groupBy("model_name").agg(F.sum(area).alias("pr_auc"))


def score_histogram(long: DataFrame, bins: int = HIST_BINS, model_col: str = "model_name",
                    score_col: str = "score") -> DataFrame:
    """Counts per fixed-width bin of [0, 1]; scores outside are clamped to the end bins."""
    s = M.nan_to_null(score_col)
    b = F.least(F.greatest(F.floor(s * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return (long.filter(s.isNotNull()).groupBy(F.col(model_col).alias("model_name"), b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("bin_start", F.col("bin") / F.lit(float(bins))))
