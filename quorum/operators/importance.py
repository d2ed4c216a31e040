"""Feature-importance tables (feature, importance, position).

``univariate_importance`` scores each feature against the label in one
aggregate (|Pearson r| or |covariance|); ``model_importance`` (M11) reads a
fitted tree model's ``featureImportances`` and joins names by position. The
ranking, ordering, comparison and top-k operators live in ``report``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions.metrics import number


def _pair_corr(x: Column, y: Column) -> Column:
    """|Pearson r| over the rows where both are known; NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.abs(F.covar_pop(x, y) / F.when(den != 0, den))


def univariate_importance(df: DataFrame, features: Sequence[str], label_col: str = "label",
                          kind: str = "corr") -> DataFrame:
    """|corr(feature, label)| (kind='corr') or |covar_pop(feature, label)| (kind='covar')."""
    def score(c):
        if kind == "corr":
            return _pair_corr(number(df, c), number(df, label_col))
        return F.abs(F.covar_pop(number(df, c), number(df, label_col)))

    agg = df.agg(*[score(c).alias(c) for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("importance"),
                              F.lit(i).alias("position")) for i, c in enumerate(features)])
    return agg.select(F.inline(rows))


def model_importance(model, feature_names: Sequence[str], spark) -> DataFrame:
    """(feature, importance, position) of a fitted tree model; unnamed -> Feature_{i}."""
    vec = model.featureImportances.toArray().tolist()
    names = list(feature_names) + [f"Feature_{i}" for i in range(len(feature_names), len(vec))]
    return spark.createDataFrame([(names[i], float(v), i) for i, v in enumerate(vec)],
                                 "feature string, importance double, position int")
