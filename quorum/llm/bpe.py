"""BPE encoding and decoding of whole texts, and what a word-level BPE file needs around it.

The merge loop keeps the symbols of a word in a doubly linked list and the
possible merges in a priority queue by (rank, position); entries whose pair has
changed since they were queued are stale and skipped. Decoding joins the
vocabulary strings of the ids.

The tokenizer file is read on the driver and broadcast (its size is fixed by
the file, about 2 MB), so executors need no copy of it. Words repeat, so every
worker keeps the ids of a bounded number of words and of pieces between white
space (about 120 MB at most).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import ship, small_batches

CACHE_WORDS = 300_000
CACHE_WORD_CHARS = 64  # longer words are encoded each time

_SEPARATORS = re.compile("[\x1c-\x1f]")
_BITS = 24  # ids and ranks are smaller than 1 << _BITS
_MADE = (1 << _BITS) - 1


def byte_symbols() -> list[str]:
    """The printable character of each byte value: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordBpe:
    """Encoder of a ``tokenizers`` file of the word-BPE kind: NFC, lower case, white space dropped, word ends marked."""

    def __init__(self, spec: str, queue_from: int = 0):
        self.queue_from = queue_from  # words of fewer symbols are merged by scanning
        parts = json.loads(spec)
        model = parts["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        self.merges: dict[int, int] = {}  # pair of symbols -> rank and what the merge makes
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges[self.vocab[left] << _BITS | self.vocab[right]] = rank << _BITS | self.vocab[left + right]
        split = next(p for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = split["pattern"]["Regex"]
        shown = byte_symbols()
        self.first = [self.vocab.get(c, -1) for c in shown]  # of a word's bytes but the last
        self.last = [self.vocab.get(c + self.suffix, -1) for c in shown]
        self._compile()

    def _compile(self) -> None:
        self.cache = Cache(self.piece_ids)
        self._find = regex.compile(self.words).findall
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "_find", "_special")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compile()

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a word's symbols, lowest rank first, leftmost first among equals.

        A queue entry is one integer: the merge (rank, then what it makes) above
        the position of its left symbol. ``due`` holds the merge that the pair
        at a position stands for now; entries that differ from it are stale.
        """
        find, n = self.merges.get, len(symbols)
        due = [find(a << _BITS | b, -1) for a, b in pairwise(symbols)]
        place = n.bit_length()
        queue = [v << place | i for i, v in enumerate(due) if v >= 0]
        if not queue:
            return symbols
        due.append(-1)
        before, after, mask = list(range(-1, n - 1)), list(range(1, n + 1)), (1 << place) - 1
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & mask
            v = entry >> place
            if due[i] != v:
                continue
            j = after[i]
            symbols[i] = made = v & _MADE
            symbols[j] = due[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                due[i] = v = find(made << _BITS | symbols[k], -1)
                if v >= 0:
                    push(queue, v << place | i)
            else:
                due[i] = -1
            h = before[i]
            if h >= 0:
                due[h] = v = find(symbols[h] << _BITS | made, -1)
                if v >= 0:
                    push(queue, v << place | h)
        return [s for s in symbols if s >= 0]

    def scan(self, symbols: list[int]) -> list[int]:
        """``merge`` without a queue, by looking for the lowest rank each time: quicker for short words."""
        find, none = self.merges.get, 1 << 62
        due = [find(a << _BITS | b, none) for a, b in pairwise(symbols)]
        while due and (v := min(due)) != none:
            i = due.index(v)
            symbols[i] = made = v & _MADE
            del symbols[i + 1], due[i]
            if i < len(due):
                due[i] = find(made << _BITS | symbols[i + 1], none)
            if i:
                due[i - 1] = find(symbols[i - 1] << _BITS | made, none)
        return symbols

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the pattern."""
        data = word.encode("utf-8")
        symbols = [self.first[b] for b in data[:-1]]
        symbols.append(self.last[data[-1]])
        symbols = [s for s in symbols if s >= 0] if -1 in symbols else symbols
        return tuple(self.merge(symbols) if len(symbols) >= self.queue_from else self.scan(symbols))

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece without white space, by way of the cache for the words in it."""
        if piece.isalpha():
            return little_endian(array("I", self._word(piece)))
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return self.cache[piece[:-1]] + self.cache[piece[-1]]
        words = self._find(piece)
        if words == [piece]:
            return little_endian(array("I", self._word(piece)))
        return b"".join(map(self.cache.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-casing here knows no final sigma
        text = text.lower()
        # str.split() also splits at U+001C to U+001F, which aren't white space to the pattern
        chunks = list(filter(None, regex.split(r"\s+", text))) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.cache.__getitem__, chunks))

    def encode_bytes(self, text: str) -> bytes:
        """``encode`` as little-endian unsigned 32-bit integers."""
        if self._special is None or "<|" not in text:
            return self._plain(text)
        return b"".join(little_endian(array("I", [self.specials[part]])) if part in self.specials else self._plain(part)
                        for part in self._special.split(text))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; no special tokens are added, those written out count."""
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        """Vocabulary strings joined by a space, as for a file without a decoder; unknown ids are left out."""
        strings = self.strings
        try:
            return " ".join(map(strings.__getitem__, ids))
        except KeyError:
            return " ".join([strings[i] for i in ids if i in strings])


class Cache(dict):
    """Values of ``make`` by string, the latest ``CACHE_WORDS`` to twice as many of them."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def load(spark, path: str, queue_from: int = 0):
    """The encoder of a tokenizer file, as a broadcast value."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(WordBpe(f.read(), queue_from))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every whole text.

    Defined cases: a null or empty text has no ids; rows with null or repeated
    ids are encoded like any other; other columns are not read.
    """
    shared, name, kind = load(docs.sparkSession, path), id_col, docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = shared.value
        for pdf in batches:
            yield pd.DataFrame({name: pdf["id"], "ids": [bpe.encode(t or "") for t in pdf["text"]]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"`{name}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the decoded text of every row of ids; null ids give an empty text."""
    shared, name, kind = load(encoded.sparkSession, path), id_col, encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = shared.value
        for pdf in batches:
            yield pd.DataFrame({name: pdf["id"], "text": [bpe.decode(x) if x is not None else "" for x in pdf["ids"]]})

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(run, f"`{name}` {kind}, text string")


def round_trip_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass over the rows."""
    shared, name, kind = load(docs.sparkSession, path), id_col, docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        bpe = shared.value
        for batch in small_batches(batches):
            counts, digests, back = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode_bytes(text or "")
                decoded = bpe.decode(np.frombuffer(ids, dtype="<u4").tolist())
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                                              pa.array(back, pa.string())], names=[name, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{name}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


ship(__name__)
