"""Reproducible stratified folds and train/test splits.

Rows of each class are ordered by ``md5(concat_ws(':', id, seed))`` (ties by
id) and dealt round-robin into k folds, so per-class fold sizes differ by at
most one and the test folds partition the rows. The library's own shuffle
order is not reproduced, only its guarantees; the same ordering is
expressible in SQL, which makes the folds checkable by an oracle.

Scale: a plain ``row_number() OVER (PARTITION BY label ...)`` would put a
whole class (a third of the table or more) into one task. ``hash_rank``
instead ranks in two phases: (1) count rows per (group, md5 prefix) — at most
``groups * 16**bucket_hex`` rows, partially aggregated map-side; (2) rank
inside each (group, prefix) slice and add the slice's running offset. The
offset table is joined on the slice, which is also the partitioning of the
ranking, so the join adds no shuffle of rows and needs no broadcast; AQE still
broadcasts it where it is small. The slices are uniform because md5 is. The
prefix length is chosen from the row count so that a slice holds about 50 000
rows at any size.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.config import DEFAULT_N_SPLITS, DEFAULT_SEED, DEFAULT_TEST_SIZE

_SLICE_ROWS = 50_000    # target rows per (group, prefix) slice when the prefix length is automatic


def auto_bucket_hex(n_rows: int, n_groups: int = 2, slice_rows: int = _SLICE_ROWS) -> int:
    """Shortest md5 prefix giving slices of about ``slice_rows`` rows."""
    need = max(1.0, n_rows / max(1, n_groups) / slice_rows)
    hexd = 1
    while 16 ** hexd < need:
        hexd += 1
    return hexd


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def hash_rank(df: DataFrame, group_cols: Sequence[str], id_col: str, seed: int = DEFAULT_SEED,
              bucket_hex: int | None = None, rank_col: str = "_rank", size_col: str | None = None,
              tiebreak: Sequence[str] = (), largest_col: str | None = None,
              smallest: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """Exact 1-based rank of each row within ``group_cols`` ordered by (md5(id:seed), id, *tiebreak).

    Ids are expected to be unique; ``tiebreak`` columns make the order total
    when they are not (rows equal in every ordering column are interchangeable).
    ``size_col`` and ``largest_col`` add the size of the row's group and of the largest group;
    ``smallest`` = (name, columns) the size of the smallest group among those that share the columns.
    """
    group_cols = list(group_cols)
    if bucket_hex is None:  # one cheap count sizes the slices
        bucket_hex = auto_bucket_hex(df.count(), 2 if group_cols else 1)
    d = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, bucket_hex))
    counts = d.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(
        *group_cols, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*group_cols)).alias("_group_n"),
    )
    if largest_col:
        offs = offs.withColumn(largest_col, F.max("_group_n").over(Window.partitionBy()))
    if smallest:
        offs = offs.withColumn(smallest[0], F.min("_group_n").over(Window.partitionBy(*smallest[1])))
    local = Window.partitionBy(*group_cols, "_b").orderBy("_h", id_col, *tiebreak)
    out = (d.join(offs, group_cols + ["_b"])
           .withColumn(rank_col, F.col("_off") + F.row_number().over(local)))
    keep = [c for c in df.columns] + [rank_col]
    if size_col:
        out = out.withColumnRenamed("_group_n", size_col)
        keep.append(size_col)
    if largest_col:
        keep.append(largest_col)
    if smallest:
        keep.append(smallest[0])
    return out.select(*keep)


def stratified_kfold(df: DataFrame, id_col: str, label_col: str = "label",
                     k: int = DEFAULT_N_SPLITS, seed: int = DEFAULT_SEED,
                     bucket_hex: int | None = None, fold_col: str = "fold", mode: str = "exact") -> DataFrame:
    """Add ``fold`` (1..k): test folds are disjoint and complete.

    ``mode='exact'`` (default): per-class fold sizes differ by at most one (two-phase
    ranking, one sort of the rows). ``mode='hash'``: fold = md5-derived hash mod k — no
    shuffle or sort at all, class balance only in expectation; for tables where a
    full sort is not worth exact balance.

    The job fails if every class has fewer than k rows. A class with fewer rows than k
    while another has enough is dealt into as many folds as it has rows;
    ``check_fold_sizes`` reports such classes beforehand.
    """
    if k < 2:
        raise ValueError("n_splits must be at least 2")
    if mode == "hash":
        h = F.conv(F.substring(hash_key(id_col, seed), 1, 15), 16, 10).cast("long")
        return df.withColumn(fold_col, (F.pmod(h, F.lit(k)) + 1).cast("int"))
    if mode != "exact":
        raise ValueError("mode must be 'exact' or 'hash'")
    ranked = hash_rank(df, [label_col], id_col, seed, bucket_hex, largest_col="_largest")
    fold = F.when(F.col("_largest") < k, F.raise_error(F.lit(f"n_splits={k} exceeds the number of rows of every class")).cast("int")) \
        .otherwise((((F.col("_rank") - 1) % k) + 1).cast("int"))
    return ranked.withColumn(fold_col, fold).drop("_rank", "_largest")


def check_fold_sizes(df: DataFrame, label_col: str, k: int) -> dict:
    """Class sizes (one small aggregate): raise when all have fewer rows than folds, warn when one has."""
    sizes = {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}
    small = {c: n for c, n in sizes.items() if n < k}
    if small and len(small) == len(sizes):
        raise ValueError(f"n_splits={k} exceeds the number of rows of every class: {small}")
    if small:
        warnings.warn(f"some folds hold no row of these classes, which have fewer than {k} rows: {small}", stacklevel=2)
    return sizes


def stratified_split(df: DataFrame, id_col: str, label_col: str = "label",
                     test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
                     bucket_hex: int | None = None, split_col: str = "split") -> DataFrame:
    """Add ``split`` = 'Test' for the first ceil(test_size * n_class) rows of each class, else 'Train'."""
    ranked = hash_rank(df, [label_col], id_col, seed, bucket_hex, size_col="_class_n")
    is_test = F.col("_rank") <= F.ceil(F.lit(float(test_size)) * F.col("_class_n"))
    return (ranked.withColumn(split_col, F.when(is_test, F.lit("Test")).otherwise(F.lit("Train")))
            .drop("_rank", "_class_n"))


def check_unique_ids(df: DataFrame, id_col: str, sample: int = 5) -> None:
    """Raise when ``id_col`` repeats (one distributed aggregate; a few offending ids are reported).

    Every operator keys rows by id; a repeated id would also concentrate rows
    in one ranking slice.
    """
    dups = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    head = dups.orderBy(F.desc("_n"), id_col).limit(sample).collect()
    if head:
        shown = ", ".join(f"{r[id_col]} (x{r['_n']})" for r in head)
        raise ValueError(f"Column '{id_col}' is not a unique row id; repeated values include: {shown}")
