"""Column expressions for confusion-based metrics and thresholds.

All arithmetic is done on integer counts first and divided last, in the same
operand order as the evaluated pipeline, so results are bit-identical with
an SQL engine evaluating the same formula.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorum.config import Costs

# Column order of the ``results`` table (one row per model / split / threshold type).
RESULT_COLUMNS = [
    "model_name", "split", "threshold_type", "threshold", "precision", "recall",
    "f1_score", "accuracy", "cost", "tp", "fp", "tn", "fn", "is_base_model",
]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL so a missing score never compares as 'greatest'."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


def number(df, c: str) -> Column:
    """A numeric column as double, with NaN read as missing where the type can hold it."""
    return nan_to_null(f"`{c}`") if df.schema[c].dataType.typeName() in ("float", "double") else F.col(f"`{c}`").cast("double")


def pct(num, den) -> Column:
    """``100 * num / den`` or 0.0 when the denominator is not positive."""
    num, den = col(num), col(den)
    return F.when(den > 0, F.lit(100) * num / den).otherwise(F.lit(0.0))


def frac(num, den) -> Column:
    num, den = col(num), col(den)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def precision(tp, fp) -> Column:
    return pct(tp, col(tp) + col(fp))


def recall(tp, fn) -> Column:
    return pct(tp, col(tp) + col(fn))


def f1_score(tp, fp, fn) -> Column:
    p = frac(tp, col(tp) + col(fp))
    r = frac(tp, col(tp) + col(fn))
    return F.when(p + r > 0, F.lit(100) * (F.lit(2) * p * r) / (p + r)).otherwise(F.lit(0.0))


def accuracy(tp, fp, tn, fn) -> Column:
    tp, fp, tn, fn = col(tp), col(fp), col(tn), col(fn)
    return pct(tp + tn, tp + tn + fp + fn)


def cost(fp, fn, costs: Costs) -> Column:
    return F.lit(float(costs.c_fp)) * col(fp) + F.lit(float(costs.c_fn)) * col(fn)


def metric_columns(costs: Costs, cost_divisor: int | None = None,
                   tp="tp", fp="fp", tn="tn", fn="fn") -> list[Column]:
    """precision, recall, f1_score, accuracy, cost (optionally / n_splits) and cost_total."""
    total = cost(fp, fn, costs)
    out = [
        precision(tp, fp).alias("precision"),
        recall(tp, fn).alias("recall"),
        f1_score(tp, fp, fn).alias("f1_score"),
        accuracy(tp, fp, tn, fn).alias("accuracy"),
    ]
    if cost_divisor:
        out.append((total / F.lit(int(cost_divisor))).alias("cost"))
    else:
        out.append(total.alias("cost"))
    return out


def grid_bucket(score, grid: Sequence[float]) -> Column:
    """Number of grid values ``<= score`` (NULL score -> 0).

    Built as a balanced tree of comparisons against the exact grid doubles,
    so it stays inside whole-stage codegen and costs O(log G) per row.
    ``score >= grid[i]`` is then simply ``bucket > i``.
    """
    s = col(score)
    g = [float(x) for x in grid]

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(s >= F.lit(g[mid]), build(mid + 1, hi)).otherwise(build(lo, mid))

    return build(0, len(g))


def apply_threshold(score, threshold) -> Column:
    """``score >= t`` -> 1, else 0; missing (NULL/NaN) score -> 0."""
    s = nan_to_null(score)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce((s >= t).cast("int"), F.lit(0))


def encode_tag(c, good_tag: str, bad_tag: str) -> Column:
    """Good -> 0, Bad -> 1, anything else (incl. NULL) -> NULL."""
    c = col(c)
    return F.when(c == F.lit(bad_tag), F.lit(1)).when(c == F.lit(good_tag), F.lit(0))


LOG_LOSS_EPS = 1e-15


def log_loss_expr(label, prob, eps: float = LOG_LOSS_EPS) -> Column:
    """Per-row negative log likelihood with p clipped to [eps, 1 - eps].

    A missing label or score (NULL, NaN) gives NULL, so averages skip the row.
    """
    y, s = col(label), nan_to_null(prob)
    p = F.greatest(F.least(s, F.lit(1 - eps)), F.lit(eps))
    return F.when(s.isNotNull(), -(y * F.log(p) + (F.lit(1) - y) * F.log(F.lit(1) - p)))
