"""Target / decision encoding, feature projection, one-hot encoding and
feature filters (P1-P6b, P12, P13, A17, A17b, A18, M17).

Validation is folded into the projection with ``raise_error`` so a bad tag
fails the job that reads it, with no extra scan. Statistics over many
columns are computed in one aggregate; only the per-column results (a few
numbers per feature) reach the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.functions.metrics import encode_tag, nan_to_null, number
from quorum.session import cut_lineage

#: Most levels that become columns of a wide one-hot frame.
MAX_WIDE_LEVELS = 20_000
#: Levels with more than one in HOT_SHARE of the cells are joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Parts by task number in which the tasks' correlation blocks are merged, level by level, before the last merge.
MERGE_PARTS = (1024, 32)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def encode_target(df: DataFrame, target: str, good_tag: str, bad_tag: str, label_col: str = "label") -> DataFrame:
    """Good -> 0, Bad -> 1; any other value (incl. NULL) fails the job."""
    enc = encode_tag(target, good_tag, bad_tag)
    # fixed value: the start of this message
    msg = F.concat(F.lit(f"Found unmapped values in {target}. Expected values: '{good_tag}' or '{bad_tag}'; got "),
                   F.coalesce(F.col(target).cast("string"), F.lit("NULL")))
    return df.withColumn(label_col, F.when(enc.isNotNull(), enc).otherwise(F.raise_error(msg)).cast("int"))


def encode_decision(c: str, good_tag: str, bad_tag: str) -> Column:
    """P3 + P4: ``== bad_tag`` -> 1 else 0, failing on any value outside the two tags."""
    v = F.col(c)
    ok = v.isin(good_tag, bad_tag)
    msg = F.concat(F.lit(f"decision column {c}: "), F.coalesce(v.cast("string"), F.lit("NULL")),
                   F.lit(f" is neither {good_tag} nor {bad_tag}"))
    return F.when(ok.isNotNull() & ok, (v == F.lit(bad_tag)).cast("int")).otherwise(F.raise_error(msg).cast("int"))


def invalid_decisions(df: DataFrame, cols: Sequence[str], good_tag: str, bad_tag: str) -> DataFrame:
    """P3 report form: distinct (column_name, value) pairs outside the two tags."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("_p")).select("_p.*")
    bad = F.col("value").isNull() | ~F.col("value").isin(good_tag, bad_tag)
    return long.filter(bad).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def project_features(df: DataFrame, target: str, excludes: Sequence[str] = (),
                     decisions: Sequence[str] = ()) -> DataFrame:
    """Drop target, configured excludes and decision columns; absent names are ignored."""
    return df.drop(*common_columns(df, [*excludes, target, *decisions]))


def common_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The ``names`` that ``df`` has, in its order of columns."""
    return [c for c in df.columns if c in set(names)]


def split_dtypes(df: DataFrame) -> tuple[list[str], list[str]]:
    """P5: (numeric, categorical incl. string and boolean) column names from the schema."""
    numeric, categorical = [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES):
            numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            categorical.append(f.name)
    return numeric, categorical


def _cells(df: DataFrame, cols: Sequence[str], *keep: Column) -> DataFrame:
    """(*keep, column_name, value): one row for each row and column, the value as text."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])).alias("_p")
    ).select(*[F.col(f"`{k}`") for k in df.select(*keep).columns], "_p.*")


def category_levels(df: DataFrame, cols: Sequence[str], limit: int = MAX_WIDE_LEVELS) -> dict[str, list]:
    """Sorted distinct non-null values of each column, computed as one distributed distinct.

    The values become column names of a wide frame, so more than ``limit`` of them are an
    error; ``one_hot_sparse`` encodes any number.
    """
    if not cols:
        return {}
    pairs = _cells(df, cols).filter(F.col("value").isNotNull()).distinct()
    out: dict[str, list] = {c: [] for c in cols}
    rows = pairs.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} levels in {', '.join(cols)}: one column a level is too wide, use one_hot_sparse")
    for r in rows:
        out[r["column_name"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def level_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, rows, level, index) of every distinct non-null value, as a table.

    ``level`` ranks a column's values in byte order from 0; level 0 is the one that is dropped, the others get
    ``index``, their place in the encoded vector, column after column in the order of ``cols``. Values are
    partitioned by range and numbered within their range, so no task and no driver holds a column's levels.
    """
    order = F.create_map(*[x for k, c in enumerate(cols) for x in (F.lit(c), F.lit(k))])
    levels = _cells(df, cols).filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    # the id holds the number of the range and the place in it; written once, so both stay as they are
    ranged = cut_lineage(levels.withColumn("_order", order[F.col("column_name")]).repartitionByRange("_order", "value")
                         .sortWithinPartitions("_order", "value").withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.select("*", part).join(sizes.select("_part", before.alias("_before")), "_part") \
        .withColumn("_rank", F.col("_before") + place)
    columns = ranked.groupBy("_order").agg(F.min("_rank").alias("_first"))  # one row a column
    columns = columns.withColumn("_nth", F.row_number().over(Window.orderBy("_order")))
    level = F.col("_rank") - F.col("_first")
    return ranked.join(columns, "_order").select(
        "column_name", "value", "rows", level.alias("level"), F.when(level > 0, F.col("_rank") - F.col("_nth")).alias("index"))


def one_hot_sparse(df: DataFrame, id_col: str, cols: Sequence[str], dictionary: DataFrame | None = None) -> DataFrame:
    """P6 for any number of levels: (id, size, indices) of every row, the places of its ones in the encoded vector.

    Levels come from ``dictionary`` (default: that of ``df``); NULL, the dropped level and values that the
    dictionary doesn't know have no place. Levels with more than one in ``HOT_SHARE`` of the cells are joined by
    broadcast, the others by shuffle, so no task gets a hot level's rows. Ids must be unique.
    """
    dictionary = cut_lineage(level_dictionary(df, cols) if dictionary is None else dictionary)
    sums = dictionary.agg(F.coalesce(F.max("index") + 1, F.lit(0)).alias("size"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    is_hot = F.col("rows") * HOT_SHARE > sums["rows"]
    keys = ["column_name", "value"]
    cells = _cells(df, cols, F.col(f"`{id_col}`").alias("_id"))
    hot = F.broadcast(dictionary.filter(is_hot).select(*keys, "index", F.lit(True).alias("_hot")))
    found = cells.join(hot, keys, "left")
    cold = found.filter("_hot is null and value is not null").select("_id", *keys) \
        .join(dictionary.filter(~is_hot).select(*keys, "index"), keys, "left")
    every = found.filter("_hot or value is null").select("_id", "index").unionByName(cold.select("_id", "index"))
    return every.groupBy("_id").agg(F.array_sort(F.collect_list("index")).alias("indices")) \
        .select(F.col("_id").alias(id_col), F.lit(sums["size"]).cast("long").alias("size"), "indices")


def one_hot_drop_first(df: DataFrame, cols: Sequence[str] | None = None,
                       encode_bool: bool = True) -> tuple[DataFrame, list[str]]:
    """Dummies for each categorical column, sorted levels, first dropped, NULL -> all 0.

    Non-categorical columns keep their order and come first, then
    ``{col}_{value}`` dummies, at most ``MAX_WIDE_LEVELS``. Returns (frame, dummy names).
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    if cols is None:
        cols = [c for c, t in fields.items()
                if isinstance(t, T.StringType) or (encode_bool and isinstance(t, T.BooleanType))]
    str_cols = [c for c in cols if not isinstance(fields[c], T.BooleanType)]
    levels = category_levels(df, str_cols)
    keep = [F.col(c) for c in df.columns if c not in cols]
    dummies, names = [], []
    for c in cols:
        if isinstance(fields[c], T.BooleanType):
            name = f"{c}_True"
            dummies.append(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(name))
            names.append(name)
            continue
        for v in levels[c][1:]:
            name = f"{c}_{v}"
            dummies.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(name))
            names.append(name)
    return df.select(*keep, *dummies), names


def one_hot_preview(df: DataFrame, target: str, excludes: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Only target + excludes removed (decision columns stay), booleans not expanded."""
    base = project_features(df, target, excludes)
    return one_hot_drop_first(base, None, encode_bool=False)


def column_variances(df: DataFrame, cols: Sequence[str], population: bool = True) -> DataFrame:
    """(feature, variance) for each column in one aggregate; NULL and NaN don't count."""
    fn = F.var_pop if population else F.var_samp
    row = df.agg(*[fn(number(df, c)).alias(c) for c in cols])
    return row.unpivot([], list(cols), "feature", "variance")


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.01,
                    population: bool = True) -> DataFrame:
    """A17 / A17b report: (feature, variance, kept) with kept = variance > threshold (strict)."""
    v = column_variances(df, cols, population)
    return v.withColumn("kept", F.coalesce(F.col("variance") > F.lit(float(threshold)), F.lit(False)))


def kept_features(report: DataFrame, cols: Sequence[str]) -> list[str]:
    """Driver list of kept features in original order (per-column report is tiny)."""
    kept = {r["feature"] for r in report.filter("kept").select("feature").collect()}
    return [c for c in cols if c in kept]


def _gram_blocks(n_cols: int, block: int):
    """Task side of ``correlation_pairs``: co-moments of the task's rows, one row per pair of column blocks."""
    edges = [(lo, min(lo + block, n_cols)) for lo in range(0, n_cols, block)]

    def run(batches):
        import pyarrow as pa
        shift = None
        for batch in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in batch.columns])
            known = ~np.isnan(x)
            if shift is None:
                shift = np.where(known, x, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
                n, sx, sxx, sxy = (np.zeros((n_cols, n_cols)) for _ in range(4))
                lo, hi = np.full(n_cols, np.inf), np.full(n_cols, -np.inf)
            lo = np.minimum(lo, np.where(known, x, np.inf).min(axis=0))
            hi = np.maximum(hi, np.where(known, x, -np.inf).max(axis=0))
            d, m = np.where(known, x - shift, 0.0), known.astype(np.float64)
            n += m.T @ m
            sx += d.T @ m
            sxx += (d * d).T @ m
            sxy += d.T @ d
        if shift is None:
            return
        for bi, (i0, i1) in enumerate(edges):
            for bj, (j0, j1) in enumerate(edges[bi:], bi):
                i, j = slice(i0, i1), slice(j0, j1)
                cells = [n[i, j], sx[i, j], sx[j, i].T, sxx[i, j], sxx[j, i].T, sxy[i, j]]
                lines = [shift[i], shift[j], lo[i], hi[i], lo[j], hi[j]]
                values = np.concatenate([*(c.ravel() for c in cells), *lines])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([values], pa.list_(pa.float64()))],
                    names=["bi", "bj", "cells"])
    return run


def _moments(values, h: int, w: int) -> tuple[list, list]:
    """A task's block as (n, means, co-moments about the means) and limits."""
    c = np.asarray(values, dtype=np.float64)
    n, sx, sy, sxx, syy, sxy = c[:6 * h * w].reshape(6, h, w)
    si, sj, *ends = np.split(c[6 * h * w:], np.cumsum([h, w, h, h, w]))
    k = np.maximum(n, 1)
    return [n, si[:, None] + sx / k, sj[None, :] + sy / k, sxx - sx * sx / k, syy - sy * sy / k, sxy - sx * sy / k], ends


def _joined(total: list, limits: list, part: list, ends: list) -> tuple[list, list]:
    """Two blocks' moments as one, by the pairwise update of means."""
    n = part[0]
    both = total[0] + n
    f = n / np.maximum(both, 1)
    dx, dy = np.where(n > 0, part[1] - total[1], 0.0), np.where(n > 0, part[2] - total[2], 0.0)
    g = total[0] * f
    total = [both, np.where(total[0] > 0, total[1] + dx * f, part[1]), np.where(total[0] > 0, total[2] + dy * f, part[2]),
             total[3] + part[3] + dx * dx * g, total[4] + part[4] + dy * dy * g, total[5] + part[5] + dx * dy * g]
    lo_i, hi_i, lo_j, hi_j = ends
    return total, [np.minimum(limits[0], lo_i), np.maximum(limits[1], hi_i), np.minimum(limits[2], lo_j), np.maximum(limits[3], hi_j)]


def _merge_blocks(n_cols: int, block: int, last: bool):
    """Merges the blocks of two column blocks; ``last``: to the |r| of their pairs, else to one block of the same kind.

    Blocks hold sums about a shift, those of merged blocks about their means: so a merged block has zeros as sums.
    """
    def run(key, pdf):
        bi, bj = int(key[0]), int(key[1])
        i0, j0 = bi * block, bj * block
        h, w = min(block, n_cols - i0), min(block, n_cols - j0)
        total = limits = None
        for values, merged in zip(pdf["cells"], pdf["merged"]):
            if merged:
                c = np.asarray(values, dtype=np.float64)
                part, ends = list(c[:6 * h * w].reshape(6, h, w)), np.split(c[6 * h * w:], np.cumsum([h, h, w]))
            else:
                part, ends = _moments(values, h, w)
            total, limits = (part, ends) if total is None else _joined(total, limits, part, ends)
        if not last:
            cells = np.concatenate([*(x.ravel() for x in total), *limits])
            return pd.DataFrame({"bi": [bi], "bj": [bj], "cells": [cells], "merged": [True], "part": [int(key[2])], "blocks": [len(pdf)]})
        _, mx, my, vx, vy, cxy = total
        # a side without spread beyond rounding has no correlation
        flat = (limits[0] >= limits[1])[:, None] | (limits[2] >= limits[3])[None, :] \
            | (vx <= 1e-22 * total[0] * mx * mx) | (vy <= 1e-22 * total[0] * my * my) | (vx <= 0) | (vy <= 0)
        with np.errstate(all="ignore"):
            r = np.where(flat, np.nan, np.abs(cxy / np.sqrt(vx * vy)))
        at_i, at_j = np.nonzero((i0 + np.arange(h))[:, None] < (j0 + np.arange(w))[None, :])
        return pd.DataFrame({"i": (i0 + at_i).astype(np.int32), "j": (j0 + at_j).astype(np.int32), "r": r[at_i, at_j]})
    return run


def merged_blocks(rows: DataFrame, n_cols: int, block: int) -> DataFrame:
    """The tasks' blocks (bi, bj, cells, merged, part, blocks), merged to at most ``MERGE_PARTS[-1]`` for each pair of column blocks.

    The number of tasks isn't known before they run, so the parts are fixed: up to 32 x 1024 tasks no group, the last
    merge included, gets more than about 32 blocks.
    """
    schema = "bi int, bj int, cells array<double>"
    blocks = rows.mapInArrow(_gram_blocks(n_cols, block), schema).select(
        "*", F.lit(False).alias("merged"), F.spark_partition_id().cast("long").alias("part"), F.lit(1).alias("blocks"))
    for parts in MERGE_PARTS:
        blocks = blocks.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("bi", "bj", "part").applyInPandas(
            _merge_blocks(n_cols, block, False), f"{schema}, merged boolean, part long, blocks int")
    return blocks


def correlation_pairs(df: DataFrame, cols: Sequence[str], block: int = 64) -> DataFrame:
    """(feature_i, feature_j, abs_corr, i, j) for i < j: |Pearson r| over the rows where both are known (NULL, NaN: unknown).

    One pass over the table whether values are missing or not: every task adds
    up the co-moments of all pairs of its rows as matrix products, one block of
    columns against another. The tasks' blocks of a pair of column blocks are merged as a tree (``MERGE_PARTS``).
    Constant columns give NULL.
    """
    cols = list(cols)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "feature_i string, feature_j string, abs_corr double, i int, j int")
    rows = df.select(*[number(df, c).alias(f"c{k}") for k, c in enumerate(cols)])
    pairs = merged_blocks(rows, len(cols), block).groupBy("bi", "bj").applyInPandas(
        _merge_blocks(len(cols), block, True), "i int, j int, r double")
    names = F.array(*[F.lit(c) for c in cols])
    return pairs.select(F.get(names, F.col("i")).alias("feature_i"), F.get(names, F.col("j")).alias("feature_j"),
                        nan_to_null("r").alias("abs_corr"), "i", "j")


def correlation_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """A18 report: (feature, position, max_abs_corr_earlier, kept).

    Column j is dropped if any earlier column i < j (dropped or not) has
    |r| > threshold; undefined correlations (constant columns) never drop.
    """
    cols = list(cols)
    pairs = correlation_pairs(df, cols)
    worst = pairs.groupBy("feature_j").agg(F.max("abs_corr").alias("max_abs_corr_earlier"),
                                           F.count_if(F.col("abs_corr") > F.lit(float(threshold))).alias("_over"))
    spark = df.sparkSession
    feats = spark.createDataFrame([(c, k) for k, c in enumerate(cols)], "feature string, position int")
    return (feats.join(worst, feats["feature"] == worst["feature_j"], "left")
            .select("feature", "position", "max_abs_corr_earlier",
                    (F.coalesce(F.col("_over"), F.lit(0)) == 0).alias("kept")))


def coerce_numeric(df: DataFrame, count_cols: Sequence[str] = ("tp", "fp", "tn", "fn", "total_samples"),
                   metric_cols: Sequence[str] = ("threshold", "precision", "recall", "f1_score", "accuracy", "cost"),
                   ) -> DataFrame:
    """Counts -> long via double, metric fields -> double; unparsable -> NULL."""
    out = []
    for c in df.columns:
        if c in count_cols:
            out.append(F.col(c).cast("string").try_cast("double").cast("long").alias(c))
        elif c in metric_cols:
            out.append(F.col(c).cast("string").try_cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def stringify(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast the given columns to string, keeping NULL (not the text 'nan')."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])


def feature_selection_report(df: DataFrame, target: str, excludes: Sequence[str] = (),
                             variance_threshold: float = 0.01, correlation_threshold: float = 0.95) -> DataFrame:
    """P6b -> A17b (sample variance) -> A18 as a one-row report (counts and final feature names).

    Each step is one aggregate; only per-feature results reach the driver.
    """
    base = project_features(df, target, excludes)
    encoded, _ = one_hot_preview(df, target, excludes)
    numeric = [c for c in encoded.columns
               if isinstance(encoded.schema[c].dataType, NUMERIC_TYPES)]
    after_var = kept_features(variance_filter(encoded, numeric, variance_threshold, population=False), numeric)
    corr = correlation_filter(encoded, after_var, correlation_threshold)
    final = [r["feature"] for r in corr.filter("kept").orderBy("position").select("feature").collect()]
    spark = df.sparkSession
    row = (len(base.columns), len(encoded.columns), len(numeric) - len(after_var), len(after_var) - len(final),
           len(final), final)
    return spark.createDataFrame([row], "original_features int, after_one_hot int, removed_by_variance int, "
                                        "removed_by_correlation int, final_features int, final_names array<string>")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the task functions above reach executors by value
