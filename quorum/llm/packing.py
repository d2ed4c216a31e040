"""Best-fit packing of token sequences by bin completion.

Every document becomes its token ids and an end id; only documents longer than
a sequence are cut, into full pieces and a rest. Full pieces fill sequences of
their own. The others are dealt at random into shards of about ``SHARD_ROWS``
rows (lengths and ids of documents, never tokens), and each shard is packed by
branch and bound: a best-fit-decreasing packing is the first incumbent; then
each sequence is completed around the largest document left, with the
undominated fillings of the remaining room in order of waste, and a branch ends
as soon as its waste rules out a better packing. A shard wastes at most about
one sequence in thousands, so the number of shards hardly matters.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.bpe import load
from quorum.llm.common import scratch, ship, small_batches

CAPACITY = 2048
END_ID = 0
SHARD_ROWS = 16384
BRANCHES = 3
NODES = 2000  # branchings beyond the first descent


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every whole text's ids, its end id included.

    A null or empty text is one piece that holds the end id alone.
    """
    shared, end = load(docs.sparkSession, path, queue_from=32), end_id.to_bytes(4, "little")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        bpe = shared.value
        for batch in small_batches(batches):
            source, piece, length, crc = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = bpe.encode_bytes(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    source.append(row)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            k = pa.array(piece, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), k, pa.array([x * capacity for x in piece], pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit-decreasing packing; rooms are found as bits of one integer."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0
    for n in sorted(lengths, reverse=True):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(n)
        if room > n:
            by_room[room - n].append(k)
            rooms |= 1 << (room - n)
    return bins


class _Stock:
    """The lengths left: how often each, and which there are as bits of an integer, both ways round."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity, self.count, self.bits, self.mirror = capacity, [0] * (capacity + 1), 0, 0
        for n in lengths:
            self.put(n)

    def put(self, n: int) -> None:
        self.count[n] += 1
        if self.count[n] == 1:
            self.bits |= 1 << n
            self.mirror |= 1 << (self.capacity - n)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits &= ~(1 << n)
            self.mirror &= ~(1 << (self.capacity - n))

    def largest(self, room: int) -> int:
        return (self.bits & ((2 << room) - 1)).bit_length() - 1 if room > 0 else -1

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths left with this sum, the larger as large as can be."""
        shift = self.capacity - total
        both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
        while both:
            a = both.bit_length() - 1
            if a * 2 < total:
                return None
            if a * 2 != total or self.count[a] > 1:
                return a, total - a
            both &= ~(1 << a)
        return None

    def fillings(self, room: int, most: int) -> list[tuple[int, ...]]:
        """At most ``most`` undominated fillings of the room, least waste first.

        A single length dominates all smaller ones and every set with no larger
        sum; so a pair or triple counts only if it fills more than the best
        smaller set does.
        """
        one = self.largest(room)
        if one < 0:
            return [()]
        found: list[tuple[int, ...]] = [(one,)]
        if one == room:
            return found
        best = one
        for total in range(room, max(one, room - 64), -1):
            if two := self.pair(total):
                found.append(two)
                best = total
                break
        if best < room:
            first, tried = self.largest(room - 1), 0
            while first > 0 and tried < 24 and 3 * first >= room - 64:
                self.take(first)
                for total in range(room, best, -1):
                    if total > first and (two := self.pair(total - first)):
                        found.append((first, *two))
                        best = total
                        break
                self.put(first)
                if best == room:
                    break
                first, tried = self.largest(first - 1), tried + 1
        if best < room - 2:  # more small lengths, each the largest that still fits
            rest, many = room, []
            while (n := self.largest(rest)) > 0:
                many.append(n)
                self.take(n)
                rest -= n
            for n in many:
                self.put(n)
            if room - rest > best:
                found.append(tuple(many))
        return sorted(found, key=lambda f: (-sum(f), len(f)))[:most]


def complete(lengths: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """A packing of ``lengths`` (each 1 to ``capacity``) into few sequences by bin completion."""
    incumbent = best_fit(lengths, capacity)
    total = sum(lengths)
    least = -(-total // capacity)
    if len(incumbent) <= least:
        return incumbent
    stock, bins, wasted, spent = _Stock(lengths, capacity), [], 0, 0
    open_nodes: list[tuple[list[tuple[int, ...]], int]] = []  # (fillings not tried yet, waste before) of each sequence

    def undo() -> None:
        for n in bins.pop():
            stock.put(n)

    descending = True
    while True:
        if descending and stock.bits:
            head = stock.bits.bit_length() - 1
            stock.take(head)
            options = [(head, *f) for f in stock.fillings(capacity - head, BRANCHES)]
            stock.put(head)
            open_nodes.append((options, wasted))
        elif descending:  # a whole packing
            if len(bins) < len(incumbent):
                incumbent = [list(b) for b in bins]
                if len(incumbent) <= least:
                    return incumbent
            descending = False
        # the next filling of the deepest sequence that has one left within the waste allowed
        allowed = (len(incumbent) - 1) * capacity - total
        while open_nodes:
            options, before = open_nodes[-1]
            if len(bins) == len(open_nodes):
                undo()
                spent += 1
            if spent > nodes:
                return incumbent
            if options:
                choice = options.pop(0)
                waste = before + capacity - sum(choice)
                if waste <= allowed:
                    for n in choice:
                        stock.take(n)
                    bins.append(list(choice))
                    wasted, descending = waste, True
                    break
            else:
                open_nodes.pop()
        if not open_nodes:
            return incumbent


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Defined cases: a null or empty text takes one token; rows that repeat an id
    are packed each; null ids are kept; an empty table gives no rows. The
    random dealing uses row numbers that are written down before, so a retried
    task deals the same way.
    """
    table = scratch(pieces(docs, path, id_col, text_col, capacity).withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    names = [c for c in table.columns if c != "_row"]
    full = table.filter(F.col("length") == capacity).select(
        *names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = table.filter(F.col("length") < capacity)
    n_shards = max(1, -(-rest.count() // shard_rows))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name != "_row")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_row"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        ends = {n: i for i, n in enumerate(lengths)}  # the last row of each length still to be placed
        order, sequence, offset = [], [], []
        for k, content in enumerate(complete(lengths, capacity)):
            at = 0
            for n in content:
                order.append(ends[n])
                ends[n] -= 1
                sequence.append(int(key[0]) << 32 | k)
                offset.append(at)
                at += n
        return pdf.iloc[order][names].assign(sequence_id=sequence, offset=offset)

    dealt = rest.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(n_shards)))
    packed = dealt.groupBy("_shard").applyInPandas(run, f"{kind}, sequence_id long, offset long")
    return full.unionByName(packed)


ship(__name__)
