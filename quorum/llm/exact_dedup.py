"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z; the SHA-256 of
the normalised text stands for it. Pass 1 counts one hash slot per row and
keeps the slots hit more than once as a bitmap. Pass 2 counts a second,
independent slot, but only for rows that pass 1 left over, and keeps its
repeated slots the same way. A row in both filters is *possibly repeated*;
only such rows take part in the grouping and shuffle. All others are certainly
unique and pass straight through.

A slot table never has more than ``MAX_SLOTS`` entries, so each broadcast
bitmap has at most ``MAX_SLOTS / 8`` = 16 MB. With more documents the filters
let more unique rows through to the shuffle; the result stays exact.

Groups are pre-aggregated per (text, id). Groups with more than ``1/HOT_SHARE``
of the rows (there can be at most ``HOT_SHARE`` of them) are broadcast instead
of joined by shuffle, so a text that makes up a third of the table lands in no
single task. Should the id that such a group keeps stand in several of its rows
(for instance a null id in a third of the table), these rows are written with a
number each, and the smallest number stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import BUCKET_BITS, HOT_SHARE, ascii_lower, bit_is_set, scratch

MAX_SLOTS = 1 << 27
SLOTS_PER_ROW = 8


def _slot(seed: int, n_slots: int) -> Column:
    return F.pmod(F.xxhash64("_sha", F.lit(seed)), F.lit(n_slots))


def _repeated_slots(rows: DataFrame, slot: Column) -> DataFrame:
    """(bucket, bits): bitmaps of the slots that more than one row has."""
    often = rows.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return often.groupBy(F.expr(f"slot div {BUCKET_BITS}").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(slot % {BUCKET_BITS})").alias("bits"))


def _in_filter(rows: DataFrame, slots: DataFrame, slot: Column, flag: str) -> DataFrame:
    """``rows`` with the boolean ``flag``: the row's slot is set in the broadcast bitmaps."""
    tagged = rows.withColumn("_slot", slot).withColumn("bucket", F.expr(f"_slot div {BUCKET_BITS}"))
    joined = tagged.join(F.broadcast(slots), "bucket", "left")
    return joined.withColumn(flag, F.expr(bit_is_set("bits", "_slot"))).drop("bucket", "bits", "_slot")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: all) of every row with keep_id, group_size, kept and text_sha256, which replace any such.

    The hashes are computed once and written to the shared folder with the ids;
    filters and groups are made from that table, as is the result if no other
    column is asked for.

    Of equal texts the row with the largest id stays. Defined cases: a null
    text counts as empty; a null id is smaller than every other and stays only
    if its whole group has none; of rows that repeat both id and text exactly
    one stays; an empty table gives an empty result.
    """
    carried = [c for c in columns or docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)).alias("_sha")
    table = scratch(docs.select(sha, F.col(id_col)), "dedup-hashes")
    # the carried columns travel in a struct, so that none can clash with the names used here
    whole = table if set(carried) == {id_col} else docs
    rows = whole.select("_sha" if whole is table else sha, F.col(id_col).alias("_id"), F.struct(*carried).alias("_row"))
    total = table.count()
    n_slots = 1 << min(MAX_SLOTS.bit_length() - 1, max(15, (SLOTS_PER_ROW * max(total, 1)).bit_length()))

    keys = table.select("_sha")
    first = scratch(_repeated_slots(keys, _slot(1, n_slots)), "dedup-pass1")
    once = _in_filter(keys, first, _slot(1, n_slots), "_again").filter("_again").select("_sha")
    second = scratch(_repeated_slots(once, _slot(2, n_slots)), "dedup-pass2")

    def flagged(frame: DataFrame) -> DataFrame:
        frame = _in_filter(frame, first, _slot(1, n_slots), "_f1")
        frame = _in_filter(frame, second, _slot(2, n_slots), "_f2")
        return frame.withColumn("_repeat", F.expr("_f1 and _f2")).drop("_f1", "_f2")

    per_id = flagged(table.select("_sha", F.col(id_col).alias("_id"))).filter("_repeat") \
        .groupBy("_sha", "_id").agg(F.count(F.lit(1)).alias("n"))
    groups = scratch(per_id.groupBy("_sha").agg(
        F.max("_id").alias("keep_id"), F.sum("n").alias("group_size"),
        F.max_by("n", F.struct(F.col("_id").isNotNull(), "_id")).alias("_at_keep"))
        .filter("group_size > 1"), "dedup-groups")
    # at most HOT_SHARE such groups can exist
    is_hot = F.col("group_size") * HOT_SHARE > total
    hot = groups.filter(is_hot).withColumn("_single", F.col("_at_keep") == 1).drop("_at_keep")
    cold = groups.filter(~is_hot).drop("_at_keep")

    base = flagged(rows).join(F.broadcast(hot), "_sha", "left")
    in_hot = F.expr("not _repeat or group_size is not null")
    among = F.expr("group_size is not null and not _single and _id <=> keep_id")
    passed = base.filter(in_hot & ~F.coalesce(among, F.lit(False))).withColumn("_copy", F.lit(1))
    rest = base.filter(~in_hot).drop("keep_id", "group_size").join(cold, "_sha", "left") \
        .withColumn("_copy", F.row_number().over(Window.partitionBy("_sha", "_id").orderBy(F.lit(1))))
    both = passed.unionByName(rest)
    if not hot.filter("not _single").isEmpty():
        copies = scratch(base.filter(among).withColumn("_no", F.monotonically_increasing_id()), "dedup-copies")
        least = copies.groupBy("_sha").agg(F.min("_no").alias("_least"))
        both = both.unionByName(copies.join(F.broadcast(least), "_sha")
                                .withColumn("_copy", F.when(F.col("_no") == F.col("_least"), 1).otherwise(2)).drop("_no", "_least"))
    return both.select(
        "_row.*",
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)))
        .alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))
