"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidates.

1. Every text becomes the set of its distinct word shingles (64-bit hashes).
   Documents with equal sets form a class; its smallest id stands for it.
2. One hash per shingle gives the sketch: bin = hash mod ``BINS``, and each bin
   keeps its smallest hash. An empty bin takes the value of the first filled bin
   in an order of its own (optimal densification). ``ROWS`` bins make a band;
   at the threshold 0.8 a pair misses all 42 bands with a chance of 3 in a million.
3. The classes of a bucket are linked to its smallest id only (a star), so a
   bucket gives as many candidates as members. Candidates are confirmed on the
   full sets, and components are found over the confirmed links.
4. A star says nothing of two members that both differ from its centre. Where a
   star holds more than one component, its members go through an exact pass:
   shingles are ordered from rare to frequent, two sets of the wanted similarity
   share one within the first ``n - ceil(t n) + 1`` of each, and the places of
   the shared shingle and the sets' parity bits bound the overlap. Only pairs of
   different components within the bounds are confirmed; all of them are.

Candidate pairs, sets and links stay in Spark throughout; sets are computed a
second time for the documents that have candidates, rather than kept for all.
Hot buckets, classes and shingles are joined by a broadcast of at most
``HOT_SHARE`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import in_bits, join_groups, scratch, ship, small_batches
from quorum.llm.components import components

SHINGLE = 4
PERCENT = 80
ROWS = 6
BANDS = 42
BINS = ROWS * BANDS
PARITY_BITS = 512
CACHE_WORDS = 300_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; at most ``CACHE_WORDS`` of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased.

    ``bytes`` split and lower-case by ASCII rules, which are those wanted here.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    if len(h) < size:
        total = np.full(1, len(h), dtype=np.uint64)
        for x in h:
            total = total * _STEP + x
        return mix(total)
    total = h[:len(h) - size + 1].copy()
    for k in range(1, size):
        total = total * _STEP + h[k:len(h) - size + 1 + k]
    return np.unique(mix(total))


def bin_order(bins: int = BINS) -> np.ndarray:
    """[e, j]: the place of bin j in the order in which the empty bin e looks for a value."""
    cells = np.arange(bins * bins, dtype=np.uint64) + np.uint64(1 << 40)
    return mix(mix(cells)).reshape(bins, bins)


def sketch(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One-permutation MinHash values of a set that isn't empty."""
    bins = len(order)
    none = np.iinfo(np.uint64).max
    out = np.full(bins, none, dtype=np.uint64)
    at = (shingles % np.uint64(bins)).astype(np.int64)
    out[at[::-1]] = shingles[::-1]  # sorted, so the smallest is written last
    filled = np.zeros(bins, dtype=bool)
    filled[at] = True
    if not filled.all():
        have, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
        out[empty] = out[have[order[np.ix_(empty, have)].argmin(axis=1)]]
    return out


def band_hashes(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Bucket of every band of every sketch, the band's number mixed in."""
    cells = sketches.reshape(len(sketches), -1, rows)
    h = np.broadcast_to(np.arange(cells.shape[1], dtype=np.uint64), cells.shape[:2]).copy()
    for k in range(rows):
        h = mix(h * _STEP + cells[:, :, k])
    return h


def parity(shingles: np.ndarray) -> np.ndarray:
    """``PARITY_BITS`` bits as 64-bit integers; each shingle turns one of them over.

    Shared shingles leave the same traces in two sets, so the bits in which two
    of these differ are never more than the shingles in which the sets do.
    """
    turned = np.bincount(((shingles >> np.uint64(32)) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(turned.astype(np.uint8)).view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, k1, k2, bands): set size, 128-bit hash of the set and band buckets (null for empty sets)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        words, order = WordHashes(), bin_order()
        for batch in small_batches(batches):
            sets = [shingle_set(t, size, words) for t in batch.column(1).to_pylist()]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                hashes = band_hashes(np.stack([sketch(sets[i], order) for i in full])).view(np.int64)
                for i, h in zip(full, hashes):
                    bands[i] = h
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].copy()),
                 pa.array(keys[:, 1].copy()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "bands"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, n long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, shingles, parity): the full set of every document, as little-endian 64-bit integers, and its parity bits."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        words = WordHashes()
        for batch in small_batches(batches):
            sets = [shingle_set(t, size, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles", "parity"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, shingles binary, parity array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * intersection >= percent * union, from the full sets."""
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b") \
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in small_batches(batches):
            x, y = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), dtype="<u8"), np.frombuffer(y[i].as_buffer(), dtype="<u8")
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(work, f"a {kind}, b {kind}").distinct()


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str, name: str) -> DataFrame:
    """``rows`` with the component of ``id_col``, which is the id itself where ``labels`` has none."""
    named = labels.select(F.col("id").alias(id_col), F.col("component").alias("_component"))
    return rows.join(named, id_col, "left").withColumn(name, F.coalesce("_component", id_col)).drop("_component")


def exact_candidates(open_ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of different components among ``open_ids`` (id, component) that may be similar enough; none is missed.

    Prefix and place filters over shingles in the order of their frequency, then the parity bits of the sets.
    """
    def explode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in small_batches(batches):
            counts = [len(x.as_buffer()) // 8 if x.is_valid else 0 for x in batch.column(2)]
            flat = np.frombuffer(b"".join(x.as_py() for x in batch.column(2)), dtype="<i8")
            take = pa.array(np.repeat(np.arange(batch.num_rows), counts), pa.int64())
            n = pa.array(counts, pa.int64()).take(take)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), n, pa.array(flat)],
                                             names=["id", "component", "n", "token"])

    kind = open_ids.schema["id"].dataType.simpleString()
    tokens = scratch(open_ids.join(sets, "id").select("id", "component", "shingles")
                     .mapInArrow(explode, f"id {kind}, component {kind}, n long, token long"), "near-tokens")
    total = tokens.count()
    often = scratch(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "near-frequencies")
    # shingles of one document alone come first and can't be shared; the others follow by frequency
    shared = join_groups(tokens, often, ["token"], "f", total, written=True)
    per_doc = shared.groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("row")) \
        .withColumn("own", F.col("n") - F.size("row")) \
        .withColumn("prefix", F.expr(f"n - (n * {percent} + 99) div 100 + 1"))
    prefix = scratch(per_doc.filter("prefix > own").select(
        "id", "component", "n", "own", F.posexplode(F.expr("slice(row, 1, cast(prefix - own as int))")).alias("k", "cell"))
        .select("id", "component", "n", (F.col("own") + F.col("k")).alias("place"), F.col("cell.token").alias("token")), "near-prefixes")
    sizes = prefix.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(
        F.sum("m").alias("size"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("m", "component")).alias("main")) \
        .filter("parts > 1").select("token", "size", "main")
    rows = join_groups(prefix, sizes, ["token"], "size", prefix.count()).drop("size")
    rows = scratch(rows.join(sets.select("id", "parity"), "id"), "near-lists")
    left, right = rows.filter("component <> main").alias("l"), rows.alias("r")
    fits = (
        "l.token = r.token and l.component <> r.component and (r.component = r.main or l.id < r.id) "
        f"and 100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) "
        # overlap <= what is left of either from the shared place on, itself included
        f"and {100 + percent} * least(l.n - l.place, r.n - r.place) >= {percent} * (l.n + r.n) "
        # the sets differ in at least as many shingles as their parity bits do
        f"and {100 + percent} * aggregate(zip_with(l.parity, r.parity, (x, y) -> bit_count(x ^ y)), 0, (t, v) -> t + v) "
        f"<= {100 - percent} * (l.n + r.n)")
    return left.join(right, F.expr(fits)).select(
        F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Documents are linked if 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id reachable and kept marks it.
    Defined cases: a text with fewer words than a shingle is one shingle of all
    its words; null and empty texts have an empty set and are linked with
    nothing; a null id is linked with nothing, has a null component and is kept;
    rows that repeat an id count as one document with all their texts.
    """
    table = scratch(_sketches(docs, id_col, text_col, shingle), "near-sketches")
    named = table.filter("n > 0 and id is not null")
    classes = scratch(named.groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-classes")
    members = classes.select(F.col("id"), F.col("n"), F.explode("bands").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("centre"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    edges = scratch(join_groups(members, stars, ["bucket"], "m", classes.count() * BANDS)
                    .filter("id <> centre.id")
                    .select(F.col("centre.id").alias("a"), F.col("centre.n").alias("an"), F.col("id").alias("b"), F.col("n").alias("bn"))
                    .distinct(), "near-edges")
    ends = scratch(edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", id_col),
                   "near-ends")
    named_docs = docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col)
    sets = scratch(_sets(in_bits(named_docs, ends, id_col, "_end").filter("_end"),
                         id_col, text_col, shingle), "near-sets")
    links = scratch(confirm(edges.filter(f"100 * least(an, bn) >= {percent} * greatest(an, bn)"), sets, percent), "near-links")
    first = components(links)

    # stars that hold several components: all their members are compared exactly
    tagged = _labelled(_labelled(edges.select("a", "b"), first, "a", "ca"), first, "b", "cb")
    mixed = tagged.groupBy("a").agg(F.max(F.col("ca") != F.col("cb")).alias("mixed"), F.count(F.lit(1)).alias("m")).filter("mixed")
    around = join_groups(tagged, mixed.select("a", "m"), ["a"], "m", edges.count())
    open_ids = around.select(F.col("a").alias("id"), F.col("ca").alias("component")) \
        .unionByName(around.select(F.col("b").alias("id"), F.col("cb").alias("component"))).distinct()
    more = scratch(confirm(scratch(exact_candidates(scratch(open_ids, "near-open"), sets, percent), "near-pairs"), sets, percent), "near-links")
    last = components(links.unionByName(more))

    found = _labelled(classes.select("k1", "k2", "size", "id"), last, "id", "component_id")
    found = scratch(found.filter("size > 1 or component_id <> id").select("k1", "k2", "size", "component_id"), "near-components")
    rows = table.select("id", "n", F.when(F.expr("n > 0 and id is not null"), F.col("k1")).alias("k1"), "k2")
    joined = join_groups(rows.filter("k1 is not null"), found, ["k1", "k2"], "size", table.count(), "left", written=True) \
        .select("id", "n", "component_id").unionByName(
            rows.filter("k1 is null").select("id", "n", F.col("id").alias("component_id")))
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("id").eqNullSafe(component).alias("kept"))


ship(__name__)
