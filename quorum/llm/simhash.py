"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures.

1. Every text becomes a 64-bit fingerprint: a bit is set if more than half of
   the XXH64 hashes of its word shingles (repeats included) have it.
2. ``SEGMENTS`` = 3 segments of 22, 21 and 21 bits: of at most 4 differing bits
   one segment holds one at most. A segment's variants with one bit as a wildcard are
   therefore an index in which two linked fingerprints meet: 64 keys for each
   distinct fingerprint, joined by equality and verified on all 64 bits.
3. Only components are asked for, so pairs are verified where a key's members
   meet and never leave it: a task goes through its keys in order and returns
   links that connect what the key connects, fewer than it has members (but for keys of ``FEW`` members or fewer).
4. A key of more than ``BUCKET`` members is divided first. Its members are verified
   against its centre (the fingerprint of most documents); if they are one
   component by then, it is done. Else the bits outside its segment are dealt into five
   parts, of which two linked fingerprints share one, so its members meet again
   under (key, part). There are six ways of dealing them, any two of which cross, and a
   key is divided until it is small; after all six, at most 20 bits are free.

Fingerprints, links and components stay in Spark. Equal fingerprints are one
node, so copies never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import join_groups, scratch, ship, small_batches
from quorum.llm.components import components

SHINGLE = 4
SEED = 42
#: Fingerprints are linked at this many differing bits or fewer.
BITS = 4
#: First bit and size of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PARTS = BITS + 1
#: Members that a key may have before it is divided, and up to which its verified pairs are all kept.
BUCKET, FEW = 2048, 8
#: Shingles hashed at a time.
CHUNK = 1 << 15


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``size`` words joined by a space, repeats included, some at a time."""
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    last = len(words) - 1
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, last + 1)
    for at in range(0, last - size + 2, CHUNK):
        to = min(at + CHUNK, last - size + 2)
        cells = zip(starts[at:to].tolist(), ends[at + size - 1:to + size - 1].tolist())
        yield np.array([hashed(joined[s:e], SEED) for s, e in cells], dtype="<u8")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of a text, A-Z lower-cased; zero without words.

    ``bytes`` split and lower-case by ASCII rules, which are those wanted here.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for h in shingle_hashes(words, size):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; ``fp`` holds the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in small_batches(batches):
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def wildcard_keys(fp: str = "fp") -> Column:
    """The 64 one-wildcard variants of a fingerprint's segments: the wildcard's place and the segment's other bits."""
    keys = []
    for first, size in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << size) - 1))
        for bit in range(size):
            keys.append(segment.bitwiseAND(F.lit(~(1 << bit))) + F.lit((first + bit) << 32))
    return F.array(*keys)


def part_masks(level: int) -> list[list[int]]:
    """[segment][part]: the bits outside the segment that are in the part, as dealt at ``level`` (0 to 5).

    The bits are cells of a 5 x 5 board in turn; the parts are the board's
    lines in one of its six directions.
    """
    out = []
    for first, size in SEGMENTS:
        masks = [0] * PARTS
        for i, bit in enumerate(b for b in range(64) if not first <= b < first + size):
            x, y = i % PARTS, i // PARTS % PARTS
            masks[y if level == PARTS else (x + level * y) % PARTS] |= 1 << bit
        out.append(masks)
    return out


def divided(rows: DataFrame, level: int) -> DataFrame:
    """Every row once for each part of the bits outside its segment, under a key that holds the part's bits too."""
    masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in parts]) for parts in part_masks(level)])
    bit = F.shiftright("root", 32)
    segment = F.when(bit < SEGMENTS[1][0], 1).when(bit < SEGMENTS[2][0], 2).otherwise(3)
    each = rows.withColumn("_masks", F.element_at(masks, segment)) \
        .select("*", F.posexplode("_masks").alias("_part", "_mask"))
    return each.withColumn("key", F.xxhash64("key", F.lit(level), "_part", F.col("fp").bitwiseAND(F.col("_mask")))) \
        .drop("_masks", "_part", "_mask")


def _trees(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within every key's rows (which are sorted by key), all fingerprints that chains of ``bits`` bits connect."""
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(heads, len(keys)))
    left, right = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    few = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    k, f = keys[few], prints[few]
    for step in range(1, FEW):  # all keys of few rows at once: every row against the one ``step`` rows on
        if step >= len(k):
            break
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        at = at[np.bitwise_count(f[at] ^ f[at + step]) <= bits]
        left.append(f[at])
        right.append(f[at + step])
    for head, size in zip(heads[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        open_prints = prints[head:head + size]
        front: list[int] = []
        while len(open_prints):  # a tree for each component: every fingerprint is compared once with those not reached yet
            if not front:
                front, open_prints = [open_prints[-1]], open_prints[:-1]
            at = front.pop()
            near = np.bitwise_count(open_prints ^ at) <= bits
            if near.any():
                reached, open_prints = open_prints[near], open_prints[~near]
                left.append(np.full(len(reached), at, dtype=np.uint64))
                right.append(reached)
                front.extend(reached)
    return np.concatenate(left), np.concatenate(right)


def links_in_keys(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b) links, at ``bits`` bits or fewer, that connect what is connected among the fingerprints of each key of ``rows`` (key, fp).

    One shuffle by key; a task reads its rows in order of key and holds one key's rows and a batch at a time.
    """
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def found(keys, prints):
            a, b = _trees(keys, prints, bits)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])
        keys, prints = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                if cut:
                    yield found(keys[:cut], prints[:cut])
                    keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield found(keys, prints)

    dealt = rows.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(work, "a long, b long").distinct()


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every


def links_of(nodes: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links whose components are those of all fingerprints of ``nodes`` (fp, copies) at ``bits`` bits or fewer.

    ``nodes`` is a written table of distinct fingerprints.
    """
    links = []
    # the key of the first level, kept as root, names the segment
    rows, total = nodes.withColumn("key", F.explode(wildcard_keys())).withColumn("root", F.col("key")), nodes.count() * 64
    for level in range(PARTS + 2):
        hot = scratch(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > bucket), "simhash-hot")
        if level > PARTS or not hot.head(1):
            links.append(scratch(links_in_keys(rows, bits), "simhash-links"))
            break
        split = join_groups(rows, hot, ["key"], "m", total, "left", written=True)
        links.append(scratch(links_in_keys(split.filter("m is null"), bits), "simhash-links"))
        many = scratch(split.filter("m is not null").drop("m"), "simhash-rows")
        centres = many.groupBy("key").agg(F.max(F.struct("copies", "fp")).alias("centre"), F.count(F.lit(1)).alias("m"))
        near = F.expr(f"fp <> centre.fp and bit_count(fp ^ centre.fp) <= {bits}")
        links.append(scratch(join_groups(many, centres, ["key"], "m", total).filter(near)
                             .select(F.least("fp", "centre.fp").alias("a"), F.greatest("fp", "centre.fp").alias("b")).distinct(),
                             "simhash-links"))
        # keys whose members are one component by now are done
        found = components(_union(links)).select(F.col("id").alias("fp"), F.col("component").alias("comp"))
        named = scratch(many.join(found, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "simhash-rows")
        mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")) \
            .filter("low <> high").select("key", "m")
        rows = scratch(divided(join_groups(named, mixed, ["key"], "m", total).drop("m", "comp"), level), "simhash-rows")
        total = rows.count()
        if not total:
            break
    return _union(links)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Rows are linked if their fingerprints differ in ``bits`` bits or fewer (up to
    ``BITS``, for which the segments are cut); component_id is the smallest id
    reachable. Defined cases: a text with fewer words than a shingle is one
    shingle of all its words; null and empty texts have the fingerprint zero
    and are linked like any other; a null id takes part in links, but names a
    component only if no row of it has an id (then component_id is null); rows
    that repeat an id are linked each by its own text; other columns are left out.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be between 0 and {BITS}")
    table = scratch(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = scratch(table.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    links = links_of(nodes.select("fp", "copies"), bits, bucket)
    found = components(links).withColumnRenamed("id", "fp")
    named = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    total = table.count()
    named = join_groups(named, least, ["component"], "size", nodes.count()).select("fp", "copies", "component_id")
    rows = join_groups(table, named, ["fp"], "copies", total)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ship(__name__)
