"""Dataset profiling: class balance, value counts, missing values, duplicates,
constant columns, distinct values, column info, describe, type inference and
column-role detection (A9-A16, A25, P9-P11, M18).

Per-column statistics are computed in ONE wide aggregate and unpivoted into
a long (column_name, ...) table; distinct-value samples use a distributed
top-k (``orderBy().limit()``) per column, never a collect of a whole column.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.functions.metrics import nan_to_null, number
from quorum.operators.prep import NUMERIC_TYPES
from quorum.session import cut_lineage

_MERGE_PARTS = 64  # parts in which the tasks' smallest values of a column are merged first
_BROADCAST_PRINTS = 1_000_000  # most repeated row fingerprints that are broadcast, 16 bytes each

# Heuristics of the evaluated profiler.
CATEGORICAL_MAX_DISTINCT = 50
SAMPLE_VALUES = 10
DECISION_MAX_DISTINCT = 10
DECISION_NAME_KEY = "decision"
SCORE_NAME_KEYS = ["score", "prob", "conf", "output", "pred"]
CLASS_LABELS = ["Good (0)", "Bad (1)"]


def class_balance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Counts of classes 0 and 1 (absent -> 0), percentage, total; empty input -> 0 %."""
    y = F.col(label_col)
    agg = df.agg(F.count_if(y == 0).alias("_n0"), F.count_if(y == 1).alias("_n1"))
    total = F.col("_n0") + F.col("_n1")

    def pct(n):
        return F.when(total > 0, F.col(n) / total * 100).otherwise(F.lit(0.0))

    rows = F.array(
        F.struct(F.lit(0).alias("class_value"), F.lit(CLASS_LABELS[0]).alias("class_label"),
                 F.col("_n0").alias("count"), pct("_n0").alias("percentage"), total.alias("total")),
        F.struct(F.lit(1).alias("class_value"), F.lit(CLASS_LABELS[1]).alias("class_label"),
                 F.col("_n1").alias("count"), pct("_n1").alias("percentage"), total.alias("total")),
    )
    return agg.select(F.inline(rows))


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """A10: count per non-null value, most frequent first."""
    return (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("value")))


def missing_values(df: DataFrame, cols: Sequence[str] | None = None, only_positive: bool = False) -> DataFrame:
    """NULL (and NaN for floating columns) count per column."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    def missing(c):
        cond = F.col(c).isNull()
        if isinstance(types[c], (T.FloatType, T.DoubleType)):
            cond = cond | F.isnan(c)
        return F.count_if(cond).alias(c)

    out = df.agg(*[missing(c) for c in cols]).unpivot([], cols, "column_name", "missing")
    return out.filter(F.col("missing") > 0) if only_positive else out


def duplicate_rows(df: DataFrame, fingerprint: Sequence[Column] | None = None) -> DataFrame:
    """Rows that repeat an earlier identical row (NULL equals NULL).

    Fingerprints (128 bits of hash over all columns, unless given) are counted first, and only rows
    whose fingerprint repeats are compared whole, so the count is exact whatever collides. The repeated
    fingerprints are broadcast if there are at most ``_BROADCAST_PRINTS``, else joined by shuffle.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    prints = list(fingerprint or [F.xxhash64(*names), F.xxhash64(F.lit(1), *names)])
    keys = [f"_print_{k}" for k in range(len(prints))]
    marked = df.select("*", *[p.alias(k) for p, k in zip(prints, keys)])
    repeated = cut_lineage(marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys))
    if repeated.count() <= _BROADCAST_PRINTS:
        repeated = F.broadcast(repeated)
    groups = marked.join(repeated, keys, "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Column has at most one distinct non-null value (min <=> max, one pass)."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.struct(F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")).alias(c)
                   for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              F.col(f"`{c}`.lo").eqNullSafe(F.col(f"`{c}`.hi")).alias("is_constant"))
                     for c in cols])
    return agg.select(F.inline(rows))


def _distinct_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value): the distinct non-null values of all columns, as text."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_p")
    ).select("_p.*").filter(F.col("value").isNotNull()).distinct()


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n_distinct) of non-null values, one distributed distinct over (column, value)."""
    pairs = _distinct_pairs(df, cols)
    return pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def _least_values(n_cols: int, limit: int):
    """A task's ``limit`` smallest distinct texts of every column."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        least: list = [None] * n_cols
        for batch in batches:
            for k in range(n_cols):
                seen = pc.unique(batch.column(k).drop_null())
                if least[k] is not None:
                    seen = pc.unique(pa.concat_arrays([least[k], seen]))
                least[k] = seen.take(pc.array_sort_indices(seen)[:limit])
        for k, values in enumerate(least):
            if values is not None and len(values):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, dtype=np.int32)), values.cast(pa.string())],
                                                 names=["k", "value"])
    return run


def smallest_values(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, list[str]]:
    """The ``limit`` smallest distinct non-null values of each column as text, in byte order.

    Every task keeps ``limit`` values a column; they are merged in parts by the task's number, then to
    one list a column, so no list holds more than ``limit`` values of a task. What comes to the driver has at most
    ``limit`` values a column.
    """
    cols = list(cols)
    if not cols:
        return {}
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(cols)])
    heads = texts.mapInArrow(_least_values(len(cols), limit), "k int, value string") \
        .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_MERGE_PARTS)))
    merged = heads.groupBy("k", "part").agg(F.slice(F.array_sort(F.collect_set("value")), 1, limit).alias("values"))
    lists = merged.groupBy("k").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))), 1, limit).alias("values"))
    found = {cols[r["k"]]: list(r["values"]) for r in lists.collect()}
    return {c: found.get(c, []) for c in cols}


def distinct_values(df: DataFrame, cols: Sequence[str], list_limit: int = CATEGORICAL_MAX_DISTINCT,
                    sample: int = SAMPLE_VALUES) -> DataFrame:
    """(column_name, n_distinct, values) — all values when n <= list_limit,
    else the first ``sample`` in sorted order. The ``list_limit`` + 1 smallest values tell which columns
    have more; only those are counted by a distributed distinct."""
    heads = smallest_values(df, cols, list_limit + 1)
    rows = [(c, len(v), v[:list_limit] if len(v) <= list_limit else v[:sample]) for c, v in heads.items() if v]
    wide = [c for c, n, _ in rows if n > list_limit]
    known = df.sparkSession.createDataFrame(rows, "column_name string, n_listed long, values array<string>")
    if not wide:
        return known.select("column_name", F.col("n_listed").alias("n_distinct"), "values")
    return known.join(distinct_counts(df, wide), "column_name", "left").select(
        "column_name", F.coalesce("n_distinct", "n_listed").alias("n_distinct"), "values")


def column_info(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Dtype, count of known values (NaN is missing) and (numeric columns) min / max, in one aggregate."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    num = {c for c in cols if isinstance(types[c], NUMERIC_TYPES)}

    def stats(c):
        x = number(df, c) if c in num else F.col(f"`{c}`")
        lo = F.min(x) if c in num else F.lit(None).cast("double")
        hi = F.max(x) if c in num else F.lit(None).cast("double")
        return F.struct(F.count(x).alias("non_null"), lo.alias("min_value"), hi.alias("max_value")).alias(c)

    agg = df.agg(*[stats(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c].simpleString()).alias("dtype"),
                              F.col(f"`{c}`.non_null").alias("non_null"), F.col(f"`{c}`.min_value").alias("min_value"),
                              F.col(f"`{c}`.max_value").alias("max_value")) for c in cols])
    return agg.select(F.inline(rows))


def describe(df: DataFrame, cols: Sequence[str], approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Count, mean, std (sample), min, 25/50/75 % (linear interpolation), max per column; NULL and NaN don't count.

    Three scans: moments in one aggregate, then the exact quartiles of ``quantiles_of``; ``approx=True``
    takes ``percentile_approx`` values in the first scan instead. One row a column comes to the driver.
    """
    probs, cols = [0.25, 0.5, 0.75], list(cols)

    def stats(c):
        x = number(df, c)
        sketch = F.percentile_approx(x, F.array(*[F.lit(p) for p in probs]), accuracy) if approx else F.lit(None)
        return F.struct(F.count(x).alias("n"), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x), sketch.alias("q"))

    moments = df.agg(*[stats(c).alias(f"_{k}") for k, c in enumerate(cols)]).first()
    if approx:
        quantiles = {c: dict(zip(probs, moments[k]["q"] or [None] * 3)) for k, c in enumerate(cols)}
    else:
        quantiles = quantiles_of(df, cols, probs, {c: moments[k]["n"] for k, c in enumerate(cols)})
    rows = [(c, *moments[k][:4], *(quantiles[c][p] for p in probs), moments[k][4]) for k, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "feature string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def table_shape(df: DataFrame) -> DataFrame:
    """Rows x columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def infer_column_types(df: DataFrame, cols: Sequence[str] | None = None,
                       max_categories: int = CATEGORICAL_MAX_DISTINCT, count_distinct: bool = True) -> DataFrame:
    """Per string column numeric -> datetime -> categorical (<= 50 distinct) -> problematic.

    One aggregate of non-null / castable counts per column; a column is categorical if its 51 smallest values
    are fewer. n_distinct of wider columns is counted by a distributed distinct, or left NULL without ``count_distinct``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (cols or df.columns) if isinstance(types[c], T.StringType)]
    agg = df.agg(*[F.struct(F.count(c).alias("n"),
                            F.count(F.col(c).try_cast("double")).alias("n_num"),
                            F.count(F.try_to_timestamp(F.col(c))).alias("n_ts")).alias(c) for c in cols])
    per_col = agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`.n").alias("n"), F.col(f"`{c}`.n_num").alias("n_num"),
                 F.col(f"`{c}`.n_ts").alias("n_ts")) for c in cols])))
    heads = smallest_values(df, cols, max_categories + 1)
    wide = [c for c in cols if len(heads[c]) > max_categories]
    listed = df.sparkSession.createDataFrame([(c, len(heads[c])) for c in cols], "column_name string, n_listed long")
    j = per_col.join(listed, "column_name")
    if wide and count_distinct:
        j = j.join(distinct_counts(df, wide), "column_name", "left")
    else:
        j = j.withColumn("n_distinct", F.lit(None).cast("long"))
    few = F.col("n_listed") <= max_categories
    kind = (F.when((F.col("n") > 0) & (F.col("n_num") == F.col("n")), F.lit("numeric"))
            .when((F.col("n") > 0) & (F.col("n_ts") == F.col("n")), F.lit("datetime"))
            .when((F.col("n_listed") > 0) & few, F.lit("categorical"))
            .otherwise(F.lit("problematic")))
    return j.select("column_name", kind.alias("inferred_type"), F.when(few, F.col("n_listed")).otherwise(F.col("n_distinct")).alias("n_distinct"))


def detect_decision_columns(df: DataFrame, target: str, excludes: Sequence[str] = (),
                            max_distinct: int = DECISION_MAX_DISTINCT) -> DataFrame:
    """Columns named like 'decision'; if none, columns with <= max_distinct values (full table)."""
    cands = [c for c in df.columns if c != target and c not in excludes]
    named = [c for c in cands if DECISION_NAME_KEY in c.lower()]
    spark = df.sparkSession
    if named:
        return spark.createDataFrame([(c, "name") for c in named], "column_name string, reason string")
    # the number of hash buckets hit never exceeds the number of values, so a column that hits more
    # buckets than max_distinct is proven wide; only the others get an exact distinct count
    hit = df.agg(*[F.bit_count(F.bit_or(F.when(F.col(f"`{c}`").isNotNull(), F.expr(
        f"shiftleft(1L, cast(pmod(xxhash64(`{c}`), 64) as int))")))).alias(c) for c in cands]).collect()[0]
    narrow = [c for c in cands if max_distinct >= 64 or (hit[c] or 0) <= max_distinct]
    if not narrow:
        return spark.createDataFrame([], "column_name string, reason string")
    counts = distinct_counts(df, narrow)
    return (counts.filter(F.col("n_distinct") <= max_distinct)
            .select("column_name", F.lit("few_values").alias("reason")))


def detect_score_columns(df: DataFrame, target: str, excludes: Sequence[str] = (),
                         decisions: Sequence[str] = ()) -> DataFrame:
    """P10: fully numeric(-castable) columns, or named like a score, excluding target / excludes / decisions."""
    cands = [c for c in df.columns if c != target and c not in excludes and c not in decisions]
    if not cands:
        return df.sparkSession.createDataFrame([], "column_name string, reason string")
    agg = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull())
                   .alias(c) for c in cands])
    rows = agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("_bad"),
                 F.lit(any(k in c.lower() for k in SCORE_NAME_KEYS)).alias("_named")) for c in cands])))
    return rows.filter((F.col("_bad") == 0) | F.col("_named")).select(
        "column_name", F.when(F.col("_bad") == 0, F.lit("numeric")).otherwise(F.lit("name")).alias("reason"))


def dataset_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """Per column dtype, known and missing counts (NaN is missing) plus table rows / columns, one scan."""
    cols = df.columns
    floats = {c for c in cols if df.schema[c].dataType.typeName() in ("float", "double")}
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(nan_to_null(f"`{c}`") if c in floats else F.col(f"`{c}`")).alias(c)
                                                     for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                              F.col(f"`{c}`").alias("non_null"), (F.col("_rows") - F.col(f"`{c}`")).alias("missing"),
                              F.lit(c == target).alias("is_target")) for c in cols])
    return agg.select(F.col("_rows").alias("rows"), F.lit(len(cols)).alias("columns"), F.inline(rows))


def dataset_overview(df: DataFrame, target: str | None = None, sample: int = 5) -> dict[str, DataFrame]:
    """The per-column profile, the distribution of the target and the first rows of a dataset."""
    out = {"profile": dataset_profile(df, target), "sample": df.limit(sample)}
    return out | ({"target_distribution": value_distribution(df, target)} if target else {})


def order_statistics(values: DataFrame, targets: dict[str, Sequence[int]], sizes: dict[str, int],
                     limit: int = 10_000, accuracy: int = 10_000) -> dict[tuple, float]:
    """Exact k-th smallest values (0-based ranks) per column of a long frame (c, x), bounded memory.

    Each target keeps a value bracket [lo, hi] known to contain it. A round
    asks ``percentile_approx`` (restricted to the bracket) for a narrower
    bracket around the target's relative rank and verifies it with exact
    counts; brackets shrink by about ``accuracy / 4`` per round, and every
    round leaves a smaller bracket or a wider margin, so the search ends. Once a
    bracket holds at most ``limit`` rows they are ranked in one task, and only the
    rows of the wanted ranks come to the driver; a bracket whose ends are equal
    is resolved at once (heavy ties). All columns and targets share the jobs of
    a round: one sketch aggregate, one count aggregate and one ranking.
    """
    x, c = F.col("x"), F.col("c")
    state = {(col, r): (None, None, 0, sizes[col], 2.0 / accuracy) for col, rs in targets.items() for r in rs}
    out: dict[tuple, float] = {}

    def in_bracket(col, lo, hi):
        cond = c == F.lit(col)
        if lo is not None:
            cond = cond & (x >= F.lit(lo))
        if hi is not None:
            cond = cond & (x <= F.lit(hi))
        return cond

    while open_ := {k: v for k, v in state.items() if k not in out}:
        groups: dict[tuple, list] = {}
        for (col, r), (lo, hi, below, size, _m) in open_.items():
            groups.setdefault((col, lo, hi, below, size), []).append(r)
        small, refine = [], []
        for key, rs in groups.items():
            col, lo, hi, below, size = key
            if lo is not None and lo == hi:
                for r in rs:
                    out[(col, r)] = lo
            elif size <= limit:
                small.append((key, rs))
            else:
                refine.append((key, rs))
        if small:
            inside = F.array_compact(F.array(*[F.when(in_bracket(*key[:3]), F.lit(g)) for g, (key, _) in enumerate(small)]))
            wanted = {(g, r - key[3] + 1): (key[0], r) for g, (key, rs) in enumerate(small) for r in rs}
            ranked = values.select("x", F.explode(inside).alias("g")).withColumn(
                "k", F.row_number().over(Window.partitionBy("g").orderBy("x")))
            by_group: dict[int, list[int]] = {}
            for g, k in wanted:
                by_group.setdefault(g, []).append(k)
            picked = reduce(lambda a, b: a | b, [(F.col("g") == g) & F.col("k").isin(ks) for g, ks in by_group.items()])
            for row in ranked.filter(picked).collect():
                out[wanted[row["g"], row["k"]]] = row["x"]
        if not refine:
            continue
        sketches, plan = [], []
        for g, ((col, lo, hi, below, size), rs) in enumerate(refine):
            probs = []
            for r in rs:
                q, m = (r - below) / max(size - 1, 1), state[(col, r)][4]
                probs += [max(0.0, q - m), min(1.0, q + m)]
            sketches.append(F.percentile_approx(F.when(in_bracket(col, lo, hi), x),
                                                F.array(*[F.lit(p) for p in probs]), accuracy).alias(f"g{g}"))
            plan.append(((col, lo, hi, below, size), rs))
        approx = values.agg(*sketches).collect()[0]
        checks, bounds = [], {}
        for g, ((col, lo, hi, below, size), rs) in enumerate(plan):
            for i, r in enumerate(rs):
                nlo, nhi = approx[f"g{g}"][2 * i], approx[f"g{g}"][2 * i + 1]
                bounds[(col, r)] = (nlo, nhi)
                inside = in_bracket(col, lo, hi)
                checks += [F.count_if(inside & (x < F.lit(nlo))).alias(f"lt_{g}_{i}"),
                           F.count_if(inside & (x <= F.lit(nlo))).alias(f"lo_{g}_{i}"),
                           F.count_if(inside & (x <= F.lit(nhi))).alias(f"le_{g}_{i}")]
        counts = values.agg(*checks).collect()[0]
        for g, ((col, lo, hi, below, size), rs) in enumerate(plan):
            for i, r in enumerate(rs):
                nlo, nhi = bounds[(col, r)]
                nb, upto = below + counts[f"lt_{g}_{i}"], below + counts[f"le_{g}_{i}"]
                at_lo = below + counts[f"lo_{g}_{i}"]
                if nb <= r < at_lo:  # the target sits in the run of values equal to nlo
                    out[(col, r)] = nlo
                elif nb <= r < upto and upto - nb < size:
                    state[(col, r)] = (nlo, nhi, nb, upto - nb, state[(col, r)][4])
                elif nb <= r < upto:  # no progress (heavy ties at the ends): step past nlo exactly
                    state[(col, r)] = (float(np.nextafter(nlo, np.inf)), nhi, at_lo, upto - at_lo,
                                       state[(col, r)][4])
                else:  # the sketch missed by more than the margin: widen and retry
                    state[(col, r)] = (lo, hi, below, size, min(1.0, state[(col, r)][4] * 4))
    return out


def _reduced(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, float]:
    """``points`` values that stand for equal shares of the weighted values; their ranks err by half a share at most."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, (np.arange(points) + 0.5) * (upto[-1] / points))
    return values[order][np.minimum(at, len(order) - 1)], upto[-1] / points


def _summaries(n_cols: int, points: int, chunk: int = 1 << 16, held: int = 64):
    """One row (k, weight, points) a task and column: boundaries of equal shares of the task's values.

    Values are sorted ``chunk`` at a time, and a task holds ``held`` summaries of each column at most.
    """
    def run(batches):
        import pyarrow as pa
        raw = [[] for _ in range(n_cols)]
        done: list[list[tuple[np.ndarray, float]]] = [[] for _ in range(n_cols)]

        def reduce_all(k):
            if raw[k]:
                x = np.concatenate(raw[k])
                done[k].append((x, 1.0) if len(x) <= points else _reduced(x, np.ones(len(x)), points))
                raw[k] = []

        def merged(k):
            values = np.concatenate([v for v, _ in done[k]])
            if len(done[k]) == 1 and len(values) <= points:
                return done[k][0]
            return _reduced(values, np.concatenate([np.full(len(v), w) for v, w in done[k]]), points)
        for batch in batches:
            for k in range(n_cols):
                x = batch.column(k).drop_null().to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                if len(x):
                    raw[k].append(x)
                if sum(map(len, raw[k])) >= chunk:
                    reduce_all(k)
                    if len(done[k]) >= held:
                        done[k] = [merged(k)]
        for k in range(n_cols):
            reduce_all(k)
            if done[k]:
                values, weight = merged(k)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([weight], pa.float64()),
                                                  pa.array([values], pa.list_(pa.float64()))], names=["k", "weight", "points"])
    return run


def _brackets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], points: int) -> dict[tuple[str, float], tuple[float, float]]:
    """(lo, hi) for each column and probability, between which its quantile should lie: about 10 / ``points`` of the rows."""
    margin = 5.0 / points

    def weighted(pdf):
        values = [np.asarray(v, dtype=np.float64) for v in pdf["points"]]
        return np.concatenate(values), np.concatenate([np.full(len(v), w) for v, w in zip(values, pdf["weight"])])

    def merge(key, pdf):
        values, weight = _reduced(*weighted(pdf), points)
        return pd.DataFrame({"k": [key[0]], "weight": [weight], "points": [values]})

    def ends(key, pdf):
        values, weights = weighted(pdf)
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])

        def at(p):
            return float(values[order][min(int(np.searchsorted(upto, p * upto[-1])), len(order) - 1)])
        return pd.DataFrame({"k": key[0], "p": np.arange(len(probs), dtype=np.int32),
                             "lo": [at(p - margin) if p > margin else -np.inf for p in probs],
                             "hi": [at(p + margin) if p + margin < 1 else np.inf for p in probs]})

    parts = df.select(*[number(df, c).alias(f"c{k}") for k, c in enumerate(cols)]) \
        .mapInArrow(_summaries(len(cols), points), "k int, weight double, points array<double>") \
        .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_MERGE_PARTS)))
    merged = parts.groupBy("k", "part").applyInPandas(merge, "k int, weight double, points array<double>")
    found = merged.groupBy("k").applyInPandas(ends, "k int, p int, lo double, hi double").collect()
    return {(cols[r["k"]], probs[r["p"]]): (r["lo"], r["hi"]) for r in found}


def _bracket_rows(brackets: list[tuple[int, float, float]]):
    """(g, x) of the values strictly inside bracket g = (column, lo, hi), and one row (g, counts) a task: below lo, at lo, at hi."""
    def run(batches):
        import pyarrow as pa
        counts = np.zeros((len(brackets), 3), dtype=np.int64)

        def rows(g, x, table):
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(x, pa.float64()),
                                               *[pa.array(v, pa.int64()) for v in table]], names=["g", "x", "below", "at_lo", "at_hi"])
        for batch in batches:
            values = {}
            for g, (k, lo, hi) in enumerate(brackets):
                if k not in values:
                    x = batch.column(k).drop_null().to_numpy(zero_copy_only=False)
                    values[k] = x[~np.isnan(x)]
                x = values[k]
                below, at_lo, at_hi = x < lo, x == lo, (x == hi) & (lo < hi)
                counts[g] += np.count_nonzero(below), np.count_nonzero(at_lo), np.count_nonzero(at_hi)
                inside = x[(x > lo) & (x < hi)]
                if len(inside):
                    none = [None] * len(inside)
                    yield rows(np.full(len(inside), g), inside, (none, none, none))
        yield rows(np.arange(len(brackets)), [None] * len(brackets), counts.T)
    return run


def quantiles_of(df: DataFrame, cols: Sequence[str], probs: Sequence[float], sizes: dict[str, int], limit: int = 10_000,
                 points: int = 2000) -> dict[str, dict[float, float | None]]:
    """Exact linear-interpolated quantiles in two scans; ``sizes`` counts the known values of each column.

    The first scan sums up every task's values as ``points`` boundaries of equal shares, which are merged in two
    levels to a bracket around each quantile. The second counts what lies below each bracket and at its ends, and writes
    the values inside, about 10 / ``points`` of the rows (ties at the ends are only counted). The wanted ranks are
    taken from the written values: in a task if a bracket has at most ``limit``, else by ``order_statistics`` over them.
    Columns of ``limit`` values or fewer are one bracket. A rank that its bracket misses is searched over the whole column.
    """
    cols, probs = list(cols), list(probs)
    ends = _brackets(df, [c for c in cols if sizes[c] > limit], probs, points) if any(sizes[c] > limit for c in cols) else {}
    brackets, asked = [], []  # (column, lo, hi) and the (column, prob) it is for
    places = {}
    for k, c in enumerate(cols):
        for p in probs:
            if not sizes[c]:
                continue
            at = p * (sizes[c] - 1)
            low = int(at // 1)
            places[c, p] = (low, min(low + 1, sizes[c] - 1), at - low)
            brackets.append((k, *ends.get((c, p), (-np.inf, np.inf))))
            asked.append((c, p))
    if not brackets:
        return {c: dict.fromkeys(probs) for c in cols}
    texts = df.select(*[number(df, c).alias(f"c{k}") for k, c in enumerate(cols)])
    shared = sorted(set(brackets))
    found = cut_lineage(texts.mapInArrow(_bracket_rows(shared), "g int, x double, below long, at_lo long, at_hi long"))
    counts = {r["g"]: r for r in found.groupBy("g").agg(F.sum("below").alias("below"), F.sum("at_lo").alias("at_lo"),
                                                        F.sum("at_hi").alias("at_hi"), F.count("x").alias("inside")).collect()}
    value: dict[tuple[str, int], float] = {}
    inner: dict[int, dict[int, tuple[str, int]]] = {}  # bracket -> rank inside it -> (column, rank)
    missed: dict[str, set[int]] = {}
    for bracket, (c, p) in zip(brackets, asked):
        g = shared.index(bracket)
        for rank in places[c, p][:2]:
            k = rank - counts[g]["below"]
            if k < 0 or k >= counts[g]["at_lo"] + counts[g]["inside"] + counts[g]["at_hi"]:
                missed.setdefault(c, set()).add(rank)
            elif k < counts[g]["at_lo"]:
                value[c, rank] = bracket[1]
            elif k < counts[g]["at_lo"] + counts[g]["inside"]:
                inner.setdefault(g, {})[k - counts[g]["at_lo"]] = (c, rank)
            else:
                value[c, rank] = bracket[2]
    written = found.filter("x is not null").select("g", "x")
    small = {g: ks for g, ks in inner.items() if counts[g]["inside"] <= limit}
    if small:
        wanted = reduce(lambda a, b: a | b, [(F.col("g") == g) & F.col("k").isin([k + 1 for k in ks]) for g, ks in small.items()])
        ranked = written.filter(F.col("g").isin(list(small))).withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("x")))
        for r in ranked.filter(wanted).collect():
            value[small[r["g"]][r["k"] - 1]] = r["x"]
    large = {g: ks for g, ks in inner.items() if g not in small}
    if large:
        deeper = order_statistics(written.withColumnRenamed("g", "c"), {g: sorted(ks) for g, ks in large.items()},
                                  {g: counts[g]["inside"] for g in large}, limit)
        value |= {large[g][k]: x for (g, k), x in deeper.items()}
    if missed:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), number(df, c).alias("x")) for c in missed])).alias("_p")) \
            .select("_p.*").filter("x is not null")
        value |= order_statistics(long, {c: sorted(r) for c, r in missed.items()}, {c: sizes[c] for c in missed}, limit)
    out = {}
    for c in cols:
        out[c] = {}
        for p in probs:
            low, high, f = places.get((c, p), (None, None, None))
            out[c][p] = None if low is None else value[c, low] + (value[c, high] - value[c, low]) * f if high != low else value[c, low]
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str] | str, probs: Sequence[float], limit: int = 10_000,
                    accuracy: int = 2000) -> dict:
    """Linear-interpolated quantiles (pandas / SQL ``quantile_cont``) of each column in three scans,
    without any task or the driver holding a whole column. Returns {col: {p: value}}
    (or {p: value} when ``cols`` is one name). ``accuracy`` is the number of points of a task's summary."""
    single = isinstance(cols, str)
    cols = [cols] if single else list(cols)
    counts = df.agg(*[F.count(number(df, c)) for c in cols]).first()
    out = quantiles_of(df, cols, probs, dict(zip(cols, counts)), limit, accuracy)
    return out[cols[0]] if single else out


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the task functions above reach executors by value
