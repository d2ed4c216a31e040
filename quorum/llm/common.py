"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.session import ensure_checkpoint_dir

#: The white space of the word rules: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


VECTORED = "parquet.hadoop.vectored.io.enabled"


def ship(module: str) -> None:
    """Send a module's functions to executors by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage with files that every executor can reach, so a lost
    executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).option(VECTORED, "false").parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Texts without other capitals or multi-byte characters take the faster function."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, upper, upper.lower()))


def small_batches(batches, rows: int = 500):
    """Arrow batches cut to ``rows`` rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Most bytes of texts that Spark sends to a Python task at a time in the pipeline.
BATCH_BYTES = "4m"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def plain_reads(spark: SparkSession) -> None:
    """Settings that keep a session's tasks on whole texts small, unless it sets them itself.

    Parquet's vectored reads take a buffer outside the heap as large as a column
    chunk for every reading thread, which a column of whole texts makes too
    large; so does an Arrow batch of as many texts as Spark takes by default, in the JVM and again in Python.
    """
    if spark.conf.get(VECTORED, None) is None:
        spark.conf.set(VECTORED, "false")
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that no model may learn labels from: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, without vectored reads (see ``plain_reads``)."""
    return spark.read.option(VECTORED, "false").parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Most slots of a bitmap of ids, 16 MB; a smaller set of ids gets about 16 slots for each. Too few slots only let more
#: rows through.
ID_SLOTS = 1 << 27
BUCKET_BITS = 32768  # bits of one bitmap of Spark's bitmap functions


def bit_is_set(bits: str, slot: str) -> str:
    """SQL text: bit ``slot`` of its bucket's bitmap is set."""
    byte = f"conv(hex(substring({bits}, cast(({slot} % {BUCKET_BITS}) div 8 + 1 as int), 1)), 16, 10)"
    return f"{bits} is not null and (shiftright(cast({byte} as int), cast({slot} % 8 as int)) & 1) = 1"


def in_bits(rows: DataFrame, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """``rows`` with the boolean ``flag``: the id may be among ``ids`` (never wrongly false).

    The hashes of ``ids``, a written table with a column of the same name, make
    a bitmap of at most ``ID_SLOTS / 8`` bytes, which is broadcast.
    """
    n_slots = min(ID_SLOTS, max(BUCKET_BITS, 1 << (16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(id_col), F.lit(n_slots))
    bits = scratch(ids.select(slot.alias("slot")).groupBy(F.expr(f"slot div {BUCKET_BITS}").alias("_bucket")).agg(
        F.expr(f"bitmap_construct_agg(slot % {BUCKET_BITS})").alias("_bits")), "id-bits")
    small = F.broadcast(bits)
    tagged = rows.withColumn("_slot", slot) \
        .withColumn("_bucket", F.expr(f"_slot div {BUCKET_BITS}"))
    return tagged.join(small, "_bucket", "left").withColumn(flag, F.expr(bit_is_set("_bits", "_slot"))) \
        .drop("_bucket", "_bits", "_slot")


#: A group with more than one in HOT_SHARE of the rows is hot; there can be at most HOT_SHARE of them.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int,
                how: str = "inner", written: bool = False) -> DataFrame:
    """``rows`` joined (inner or left) with one row per key of ``groups``, whose ``size_col`` counts the key's rows.

    Rows of hot keys take their groups by broadcast and never shuffle, so no
    task gets more than one in ``HOT_SHARE`` of all rows for one key. ``total`` is
    the number of rows; it bounds the hot keys, whose hashes come to the driver,
    by ``HOT_SHARE``. ``written``: groups is a table already, not to be computed.
    """
    groups = groups if written else scratch(groups, "groups")
    key = F.xxhash64(*keys)
    hot = [r[0] for r in groups.filter(F.col(size_col) * HOT_SHARE > total).select(key).distinct().collect()]
    if not hot:
        return rows.join(groups, keys, how)
    is_hot = key.isin(hot)
    return rows.filter(is_hot).join(F.broadcast(groups.filter(is_hot)), keys, how).unionByName(
        rows.filter(~is_hot).join(groups.filter(~is_hot), keys, how))
