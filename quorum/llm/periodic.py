"""Runs of periodic word sequences by recompression.

A run is a stretch of consecutive words with smallest period q and a length of
at least max(``LEAST``, ``TIMES`` * q) that no neighbouring word extends with that period.

1. Recompression: a text's words become numbers, and two steps alternate until
   one symbol is left. Block compression replaces every maximal block of one
   symbol by a symbol for (symbol, length); pair compression parts the
   symbols into left and right ones by a hash and replaces every left symbol
   with its right neighbour by a symbol for the pair. The levels make a
   run-length grammar; a symbol stands for the same words wherever it stands.
2. The longest common extension of two places goes up the grammar while
   the symbols at both places are equal and begin a parent, and down again from the first difference.
   A level takes at most one step of a pair or of a block, so a query takes as
   many steps as there are levels, whatever the length of the extension.
3. Candidates are a harmonic grid: a run of period q matches itself q words on
   for at least 3 q places in a row, one of which is a multiple of 3 q. The
   extensions from there to both sides give the exact run; n log n / 3 candidates
   are most, and those whose words differ at the ends of half a run go at once.

Each text is judged by itself, with memory in proportion to it; candidates are
tried ``GRID`` at a time, and those inside a known run of a divisor of their period are skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import ship, small_batches

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Candidates held at a time.
GRID = 1 << 20


def _numbered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Equal (high, low) pairs get equal numbers from 0."""
    width = int(low.max()) + 1
    return np.unique(high * width + low, return_inverse=True)[1].astype(np.int64)


def _right(symbols: np.ndarray, seed: int) -> np.ndarray:
    """True for the symbols that are right ones in the pair compression of this seed."""
    h = symbols.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(63)).astype(bool)


class Grammar:
    """The levels of a sequence's recompression, and longest common extensions over them.

    Of every level: ``symbols``; below the top also each symbol's ``parent``, the ``first`` child of each
    parent (with the number of symbols at the end) and whether the parents are ``blocks`` or pairs.
    """

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.symbols, self.parent, self.first, self.blocks = [words], [], [], []
        seed = 0
        while len(self.symbols[-1]) > 1:
            s = self.symbols[-1]
            changes = np.flatnonzero(s[1:] != s[:-1]) + 1
            if len(changes) + 1 < len(s):
                heads = np.concatenate(([0], changes))
                self._add(heads, _numbered(s[heads], np.diff(np.append(heads, len(s)))), True)
                continue
            right = _right(s, seed)
            seed += 1
            second = np.zeros(len(s), dtype=bool)
            second[1:] = right[1:] & ~right[:-1]
            if not second.any():
                continue
            heads = np.flatnonzero(~second)
            paired = np.append(second[1:], False)[heads]
            partner = np.where(paired, s[np.minimum(heads + 1, len(s) - 1)] + 1, 0)
            self._add(heads, _numbered(s[heads], partner), False)

    def _add(self, heads: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        mark = np.zeros(len(self.symbols[-1]), dtype=np.int64)
        mark[heads] = 1
        self.parent.append(np.cumsum(mark) - 1)
        self.first.append(np.append(heads, len(mark)))
        self.blocks.append(blocks)
        self.symbols.append(symbols)

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of the places i < j: how many words from there on are equal."""
        a, b = i.copy(), j.copy()
        top = len(self.symbols) - 1
        level = np.zeros(len(a), dtype=np.int64)  # where each query met its difference
        active = np.arange(len(a))
        for k in range(top + 1):  # up: everything before a and b is equal, and both begin a symbol of this level
            x, y, live = self._step(k, a[active], b[active])
            a[active], b[active], level[active] = x, y, k
            active = active[live]
            if k == top or not len(active):
                break
            a[active], b[active] = self.parent[k][a[active]], self.parent[k][b[active]]
        for k in range(int(level.max(initial=0)) - 1, -1, -1):  # down: the symbols of the level above differ
            below = np.flatnonzero(level > k)
            a[below], b[below] = self._equal(k, self.first[k][a[below]], self.first[k][b[below]])
        return b - j

    def _equal(self, k: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the first children of differing parents: past those that are equal, one of a pair or what two blocks share."""
        s, end = self.symbols[k], len(self.symbols[k])
        same = b < end
        same[same] = s[a[same]] == s[b[same]]
        step = np.zeros(len(a), dtype=np.int64)
        step[same] = self._left(k, a[same], b[same]) if self.blocks[k] else 1
        return a + step, b + step

    def _left(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Children left of the parents of a and b, itself included; the smaller number."""
        up, first = self.parent[k], self.first[k]
        return np.minimum(first[up[a] + 1] - a, first[up[b] + 1] - b)

    def _step(self, k: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over equal symbols until both places begin a parent; live tells where they do and go on."""
        s, end = self.symbols[k], len(self.symbols[k])
        a, b = a.copy(), b.copy()
        live = b < end
        live[live] = s[a[live]] == s[b[live]]
        if k == len(self.symbols) - 1:
            return a, b, np.zeros(len(a), dtype=bool)
        up, first = self.parent[k], self.first[k]
        inside = np.flatnonzero(live)
        inside = inside[(first[up[a[inside]]] != a[inside]) | (first[up[b[inside]]] != b[inside])]
        if len(inside):
            step = self._left(k, a[inside], b[inside])
            a[inside] += step
            b[inside] += step
            ok = b[inside] < end
            at = inside[ok]
            ok[ok] = (s[a[at]] == s[b[at]]) & (first[up[a[at]]] == a[at]) & (first[up[b[at]]] == b[at])
            live[inside] = ok
        return a, b, live


def _grid(low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, q) of all i = 0, 3 q, 6 q ... with i + q < n, for the periods q from low to high - 1."""
    q = np.arange(low, high, dtype=np.int64)
    many = (n - q + 3 * q - 1) // (3 * q)
    before = np.cumsum(many) - many
    period = np.repeat(q, many)
    return (np.arange(len(period)) - np.repeat(before, many)) * 3 * period, period


def find_runs(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    n = len(words)
    grammar = back = None
    found: list[np.ndarray] = []
    known_end = known_period = None
    low = 1
    while TIMES * low <= n:
        high = low + 1  # as many periods as make GRID candidates
        room = GRID - n // (3 * low)
        while TIMES * high <= n and room > 0:
            step = min(max(1, room * high // (n + 1)), n // TIMES + 1 - high)
            room -= step * (n // (3 * high) + 1)
            high += step
        i, q = _grid(low, high, n)
        low = high
        j = i + q
        keep = words[i] == words[j]
        i, q, j = i[keep], q[keep], j[keep]
        # 3 q places in a row that hold i reach 3 q // 2 to one side of it at least
        for near in (True, False):
            reach = np.ones_like(q) if near else 3 * q // 2
            right = j + reach < n
            right[right] = words[(i + reach)[right]] == words[(j + reach)[right]]
            left = i >= reach
            left[left] = words[(i - reach)[left]] == words[(j - reach)[left]]
            keep = right | left
            i, q, j = i[keep], q[keep], j[keep]
        if known_end is not None:
            keep = (known_end[i] <= j) | (q % known_period[i] != 0)
            i, q, j = i[keep], q[keep], j[keep]
        if not len(i):
            continue
        if grammar is None:
            grammar, back = Grammar(words), Grammar(words[::-1].copy())
        right = grammar.extend(i, j)
        left = back.extend(n - 1 - j, n - 1 - i) - 1  # the place itself counts once
        start, length = i - left, right + left + q
        keep = length >= np.maximum(LEAST, TIMES * q)
        runs = np.stack([start, length, q], axis=1)[keep]
        if not len(runs):
            continue
        found.append(runs)
        if low <= n // TIMES:  # more periods follow
            if known_end is None:
                known_end, known_period = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
            for s, size, period in np.unique(runs, axis=0).tolist():
                part = slice(s, s + size)
                longer = known_end[part] < s + size
                known_period[part][longer] = period
                known_end[part][longer] = s + size
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    runs = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    first = np.ones(len(runs), dtype=bool)  # of equal stretches, the smallest period divides the others
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def most_repeated(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; the first by start and period of equal ones."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for the words that stay when every run is cut to its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def planted_repeats(key: object, words: list[bytes]) -> list[bytes]:
    """A rewrite that makes the words of one row in ten periodic from some place on; null ids have none."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def word_numbers(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, texts: bool = True) -> DataFrame:
    """(id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs, collapsed]) of every row.

    ``start`` to ``exponent_milli`` tell the run of greatest length / period, null
    without runs; ``runs`` lists all as (start, length, period); ``collapsed`` is the
    text with every run cut to its first period, its words joined by one space. The
    hashes are of the runs' lines ``start,length,period`` and of ``collapsed``.
    ``rewrite(id, words)`` may change a row's words first. Defined cases: words are
    what stands between spaces and U+0009 to U+000D, compared as they are; null
    and empty texts have no words and no runs; rows that repeat an id, and null
    ids, are judged each by itself; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        cell = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        names = ["id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        for batch in small_batches(batches):
            out: list[list] = [[] for _ in range(10)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                if rewrite is not None:
                    words = rewrite(key, words)
                n, runs = len(words), find_runs(word_numbers(words))
                best = most_repeated(runs)
                lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs.tolist())
                if len(runs):
                    words = [words[i] for i in np.flatnonzero(kept_words(n, runs)).tolist()]
                collapsed = b" ".join(words)
                row = [n, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                       hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
                for column, value in zip(out, row):
                    column.append(value)
                if texts:
                    out[8].append([{"start": s, "length": size, "period": q} for s, size, q in runs.tolist()])
                    out[9].append(collapsed.decode("utf-8"))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:6]), *(pa.array(c, pa.string()) for c in out[6:8])]
            if texts:
                columns += [pa.array(out[8], pa.list_(cell)), pa.array(out[9], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(["runs", "collapsed"] if texts else [])])

    schema = (f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_runs long, start long, length long, period long, "
              "exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    if texts:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


ship(__name__)
