"""Spelling variants: words of a corpus that are one inserted, deleted or replaced code point apart.

1. The vocabulary is counted over all texts, with sums per task before the shuffle.
2. Of two words within one error, either the first half of the shorter one or
   its second half stands unchanged at that end of the other. Words are
   dealt into blocks by these halves (and by the shorter word's length), so near
   words meet in a block, and pairs meet in one block only: the blocks of first
   halves give the pairs of equal halves, those of second halves the others.
3. Each block is a bit-sliced position index: for every position and letter a
   bitset over the block's words. All words of the shorter length run through it as
   queries, a position at a time. Three sets of bits follow each query:
   the words without an error so far, those with one replaced letter, and those with one
   letter more, which are read one position further on. A word with one letter less is
   the same pair seen from the longer word.
4. Blocks return one row a word: how many near words, and the most frequent one. Pairs never leave a block.
5. A word's form is its most frequent near word if that is ``RATIO`` times as frequent.
   Chains of forms are followed to the last by doubling the steps; frequencies
   double along a chain, so a handful of rounds is enough.

A half shared by more than a block's words is cut into parts, and each part's
queries run through each part's index, so that no task gets more than two parts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import join_groups, scratch, ship, small_batches

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
#: A word's form is at least so many times as frequent.
RATIO = 2
#: Words of a block; a word of many letters counts as several.
BLOCK = 4096
LETTERS = 128
#: Words that a task counts before it passes the counts on.
HELD = 200_000


def dropped_letter(key: object, run: str) -> str:
    """A rewrite that deletes a letter of about one run in 97, chosen by the row's id; null ids have none."""
    if key is None:
        return run
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rewrite: Callable[[object, str], str] | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, of at least ``min_length`` code points.

    ``rewrite(id, run)`` may change a run first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from collections import Counter
        runs, counts = re.compile(RUN), Counter()

        def passed_on():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])
        for batch in small_batches(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    found = Counter(runs.findall(text.encode("utf-8", "replace").lower().decode()))
                    for run, n in found.items():
                        word = rewrite(key, run) if rewrite else run
                        if len(word) >= min_length:
                            counts[word] += n
            if len(counts) > HELD:
                yield passed_on()
                counts.clear()
        yield passed_on()

    return rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bits(flags: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as 64-bit integers."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.concatenate([packed, np.zeros((*packed.shape[:-1], pad), dtype=np.uint8)], axis=-1).view(np.uint64)


def _places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of every set bit."""
    row, cell = np.nonzero(bits)
    at, bit = np.nonzero(np.unpackbits(bits[row, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[at], cell[at] * 64 + bit


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, one word a row; positions past a word's end hold 0."""
    return np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width)


def near_in_block(queries: list[str], index: list[str], length: int, first_halves: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, longer) of every near pair of a query and a word of the index.

    Queries have ``length`` code points, the index's words as many or one more
    (``longer``). Pairs whose first ``length // 2`` code points are equal
    are given if ``first_halves``, else the others.
    """
    asked, held = _codes(queries, length), _codes(index, length + 1)
    letters, asked = np.unique(asked, return_inverse=True)
    asked = asked.reshape(-1, length)
    sizes = np.fromiter(map(len, index), dtype=np.int64, count=len(index))
    every = _bits(np.ones(len(index), dtype=bool))
    exact = np.repeat(every[None, :], len(queries), axis=0)
    replaced, inserted = np.zeros_like(exact), exact.copy()
    equal_half = exact
    here = _bits(held[:, 0] == letters[:, None])
    for p in range(length):
        further = _bits(held[:, p + 1] == letters[:, None])
        same = here[asked[:, p]]
        replaced &= same
        replaced |= exact & ~same
        exact = exact & same
        inserted &= further[asked[:, p]]
        inserted |= exact
        here = further
        if p + 1 == length // 2:
            equal_half = exact
    wanted = equal_half if first_halves else ~equal_half
    q1, x1 = _places(replaced & _bits(sizes == length) & wanted)
    q2, x2 = _places(inserted & _bits(sizes == length + 1) & wanted)
    return np.concatenate([q1, q2]), np.concatenate([x1, x2]), np.repeat([False, True], [len(q1), len(q2)])


def _summed(table):
    """One block's rows (block, length, first, role, word, n) to (word, n_near, best_n, best)."""
    import pyarrow as pa
    length, first = table.column("length")[0].as_py(), table.column("first")[0].as_py()
    words, n = np.array(table.column("word").to_pylist(), dtype=object), table.column("n").to_numpy()
    role = table.column("role").to_numpy()
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ask, hold = np.flatnonzero((role & 1 > 0) & (sizes == length)), np.flatnonzero(role & 2)
    target = near = np.zeros(0, dtype=np.int64)
    if len(ask) and len(hold):
        q, x, longer = near_in_block(words[ask].tolist(), words[hold].tolist(), length, first)
        q, x = ask[q], hold[x]
        target, near = np.concatenate([q, x[longer]]), np.concatenate([x, q[longer]])
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words), dtype=np.int64)
    np.minimum.at(best, target, rank[near])
    many = np.bincount(target, minlength=len(words))
    have = np.flatnonzero(many)
    chosen = [order[r] for r in best[have]]
    return pa.table({"word": pa.array(words[have], pa.string()), "n_near": pa.array(many[have], pa.int64()),
                     "best_n": pa.array(n[chosen], pa.int64()), "best": pa.array(words[chosen], pa.string())})


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``vocabulary`` (word, n; a written table) that have a near word.

    ``best`` is the near word of largest n, the smallest in code-point order of equal ones.
    """
    sized = vocabulary.withColumn("size", F.length("word"))
    sides = F.array(F.struct(F.lit(True).alias("first"), F.expr("substring(word, 1, length div 2)").alias("part")),
                    F.struct(F.lit(False).alias("first"), F.expr("substring(word, size - (length - length div 2) + 1)").alias("part")))
    rows = sized.withColumn("length", F.explode(F.array("size", F.col("size") - 1))) \
        .withColumn("_side", F.explode(sides)) \
        .select("word", "n", "size", "length", "_side.first", F.xxhash64("length", "_side.first", "_side.part").alias("key"),
                F.expr(f"1 + size div {LETTERS}").alias("weight"))
    sizes = scratch(rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.sum("weight").alias("total"), F.first("length").alias("_length"),
        F.max(F.col("size") == F.col("length")).alias("asked")).filter("m > 1 and asked"), "spelling-halves")
    blocks = sizes.groupBy("_length").agg(F.expr(f"ceil(sum(total) / {block})").alias("blocks"))
    sizes = scratch(sizes.join(blocks, "_length").select("key", "m", "total", "blocks"), "spelling-halves")
    met = join_groups(rows, sizes, ["key"], "m", 4 * vocabulary.count(), written=True)
    plain = met.filter(F.col("total") <= block).select(
        F.xxhash64("length", "first", F.expr("pmod(key, blocks)")).alias("block"), "length", "first", F.lit(3).alias("role"), "word", "n")
    parts = met.filter(F.col("total") > block).withColumn("parts", F.expr(f"cast(ceil(total / {block}) as int)")) \
        .withColumn("own", F.expr("cast(pmod(xxhash64(word), parts) as int)")) \
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    # (part of the queries, part of the index, role); queries are words of the shorter length
    tiles = F.expr("if(own = other, array(struct(own as q, own as x, 3 as role)), "
                   "if(size = length, array(struct(own as q, other as x, 1 as role), struct(other as q, own as x, 2 as role)), "
                   "array(struct(other as q, own as x, 2 as role))))")
    tiled = parts.withColumn("_tile", F.explode(tiles)).select(
        F.xxhash64("key", "_tile.q", "_tile.x", F.lit("tile")).alias("block"), "length", "first", F.col("_tile.role").alias("role"), "word", "n")
    found = plain.unionByName(tiled).groupBy("block").applyInArrow(
        _summed, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("_b")) \
        .select("word", "n_near", (-F.col("_b.less")).alias("best_n"), F.col("_b.best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the end of every chain of (word, form), by doubling the steps taken until no root moves."""
    state = scratch(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    total = state.count()
    while total:
        follow = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        sizes = state.groupBy("root").agg(F.count(F.lit(1)).alias("_m")).join(follow, "root")
        after = join_groups(state, sizes, ["root"], "_m", total, "left")
        state = scratch(after.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        if not state.filter("moved").head(1):
            break
        state = state.drop("moved")
    return state.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      rewrite: Callable[[object, str], str] | None = None, min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    Words are runs of letters (A-Z lower-cased, others as they are) of at least
    ``min_length`` code points that occur ``min_count`` times. Defined cases: null and
    empty texts have no words; rows that repeat an id count each by itself; a null id
    counts like any other (``rewrite`` gets it); of near words that are equally frequent the smallest in code-point
    order is the form; an empty table gives no rows; other columns are left out.
    """
    counted = word_counts(docs, id_col, text_col, rewrite, min_length)
    vocabulary = scratch(counted.filter(F.col("n") >= min_count), "spelling-words")
    near = near_words(vocabulary, block)
    is_form = F.col("best_n") >= ratio * F.col("n")
    words = scratch(vocabulary.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = last_forms(words.filter("form is not null"))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ship(__name__)
