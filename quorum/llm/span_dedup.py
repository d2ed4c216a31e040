"""Substring deduplication over sliding spans of sentences.

A text is cut into sentences (at ``.``, ``!``, ``?`` before white space, and at
line ends); a sentence of more than ``MAX_WORDS`` words counts as several, so
that one long sentence still makes spans. Where it is cut depends only on the
words around the place (winnowing): of any ``MAX_WORDS`` words in a row before
its last word, it is cut after the one with the smallest hash, the last such if
several are equal. So copies of a passage are cut alike whatever stands before
and after them, but for at most ``MAX_WORDS`` words at either end, and copies of
more than ``2 * MAX_WORDS + MIN_WORDS`` words always share a span. In a text with
letters of a script that is written without spaces (Chinese, Japanese, Thai and
their like), each such letter counts as a word, and the full stops of these
scripts end a sentence whatever follows. Every run of
``RUN`` consecutive sentences, extended until it holds ``MIN_WORDS`` words, is
hashed (96 bits, A-Z lower-cased, white space as one space). The hashes are
grouped over all documents; of the places that share a hash the first, by
document id and then place in the text, stays, and the sentences of every other
place are removed.

Spans are written once as (id, place, hash). Their grouping combines within
each task before it shuffles. Only the repeated hashes are joined back; those so
frequent that they could crowd one task, of which there are at most
``HOT_SHARE``, are broadcast, the rest are joined by shuffle. Whole texts
shuffle only for documents in a bitmap of the changed ids (at most 16 MB); all
others pass straight through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import in_bits, join_groups, scratch, ship, small_batches

RUN = 3
MIN_WORDS = 24
MAX_WORDS = 12
#: A sentence ends at a mark that is a word's last character, or at a line end.
_ENDS = re.compile(r"[.!?…。](?!\S)|\n\s*+|\Z")
_WORD = re.compile(r"\S++")
#: Letters of scripts without spaces: Thai and Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_UNSPACED_ENDS = re.compile(r"[.!?…](?!\S)|[。！？]|\n\s*+|\Z")
_UNSPACED_WORD = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]++")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str) -> str:
    """A-Z lower-cased, which keeps every place in the text."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _pieces(text: str, start: int, end: int, word_rule: re.Pattern) -> Iterator[tuple[int, list[str]]]:
    """(end of each piece, its words) of a long sentence."""
    words: list[str] = []  # since the last cut
    ends: list[int] = []
    keys: list[int] = []
    least = -1  # the hash at the last cut, none before the first
    for m in word_rule.finditer(text, start, end):
        # the window is the MAX_WORDS words before this one
        if len(words) == MAX_WORDS:  # all of them since the last cut
            least = min(keys)
            n = MAX_WORDS - keys[::-1].index(least)
            yield ends[n - 1], words[:n]
            del words[:n], ends[:n], keys[:n]
        elif words and keys[-1] <= least:  # the last cut is one of them
            least = keys[-1]
            yield ends[-1], words
            words, ends, keys = [], [], []
        word = m[0]
        words.append(word)
        ends.append(m.end())
        keys.append(xxhash.xxh32_intdigest(word))
    yield ends[-1], words


def sentences(text: str) -> tuple[list[int], list[int], list[str]]:
    """(start of each sentence, its number of words, its normalised words) of a lower-cased text; they tile all of it."""
    starts, counts, norm = [], [], []
    unspaced = not text.isascii() and _HAS_UNSPACED.search(text) is not None
    ends, word_rule = (_UNSPACED_ENDS, _UNSPACED_WORD) if unspaced else (_ENDS, _WORD)
    at = 0
    for m in ends.finditer(text):
        sentence = text[at:m.end()].rstrip()
        words = word_rule.findall(sentence) if unspaced else sentence.split(None, MAX_WORDS)
        if not words:
            continue
        z = at + len(sentence)
        for then, piece in [(z, words)] if len(words) <= MAX_WORDS else _pieces(text, at, z, word_rule):
            starts.append(at)
            counts.append(len(piece))
            norm.append(" ".join(piece))
            at = then
    return starts, counts, norm


def _runs(counts: list[int], run: int, min_words: int) -> list[tuple[int, int]]:
    """(first, end) of the shortest span from every sentence that has ``run`` sentences and ``min_words`` words."""
    total = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(len(counts))
    end = np.maximum(first + run, np.searchsorted(total, total[:-1] + min_words))
    fits = end <= len(counts)
    return list(zip(first[fits].tolist(), end[fits].tolist()))


def spans(docs: DataFrame, id_col: str, text_col: str, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, first, h1, h2): every span of every whole text, by its first sentence, and its hash in two parts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in small_batches(batches):
            source, first, digests = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                _, counts, norm = sentences(lower(text))
                if len(counts) < run:
                    continue
                each = [xxhash.xxh3_128_digest(s) for s in norm]
                for a, z in _runs(counts, run, min_words):
                    source.append(row)
                    first.append(a)
                    digests.append(xxhash.xxh3_128_digest(b"".join(each[a:z])))
            parts = np.frombuffer(b"".join(digests), dtype="<i8,<i4,<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), pa.array(first, pa.int32()),
                 pa.array(parts["f0"].copy()), pa.array(parts["f1"].copy())], names=["id", "first", "h1", "h2"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, first int, h1 long, h2 int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
                   min_words: int = MIN_WORDS) -> DataFrame:
    """(id, spans): the first sentences of a document's spans that stand in an earlier place too."""
    table = scratch(spans(docs, id_col, text_col, run, min_words), "spans")
    groups = scratch(table.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "first")).alias("keep")).filter("n > 1"), "span-groups")
    total = table.count()
    later = join_groups(table, groups, ["h1", "h2"], "n", total, written=True).drop("n")
    return later.filter(~F.struct("id", "first").eqNullSafe(F.col("keep"))) \
        .groupBy("id").agg(F.collect_list("first").alias("spans"))


def cut(text: str | None, places, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[str, int]:
    """(the text without the sentences of the spans that start at ``places``, the number of sentences removed)."""
    if not text or places is None or not len(places):
        return text or "", 0
    starts, counts, _ = sentences(lower(text))
    ends = dict(_runs(counts, run, min_words))
    gone = np.zeros(len(starts) + 1, dtype=np.int64)
    for first in places:
        gone[first] += 1
        gone[ends[first]] -= 1
    covered = np.cumsum(gone)[:len(starts)] > 0
    return "".join(text[a:z] for a, z, out in zip(starts, [*starts[1:], len(text)], covered) if not out).strip(), int(covered.sum())


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
               min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with its text cut, n_removed (sentences) and changed (which replace any such columns).

    Defined cases: a null text stays null; an empty text, and one with fewer
    sentences than a run, stays as it is; a passage repeated within one text
    loses its later places; rows that repeat an id count as one document, whose
    texts should be equal; rows with null ids are left as they are.
    """
    names = [c for c in docs.columns if c not in ("n_removed", "changed")]
    found = scratch(repeated_spans(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, run, min_words)
                    .select(F.col("id").alias(id_col), F.col("spans").alias("_spans")), "span-places")
    tagged = in_bits(docs.select(*names), found, id_col, "_changed")
    passed = tagged.filter("not _changed").drop("_changed").withColumns(
        {"n_removed": F.lit(0), "changed": F.lit(False)})
    rows = tagged.filter("_changed").drop("_changed").join(found, id_col, "left").select(*names, "_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        where = names.index(text_col)
        for batch in small_batches(batches):
            texts, removed = [], []
            for text, places in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                new, n = cut(text, places, run, min_words)
                texts.append(new if n else text)
                removed.append(n)
            columns = [pa.array(texts, pa.string()) if i == where else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(removed, pa.int32()), pa.array([n > 0 for n in removed])], names=[*names, "n_removed", "changed"])

    return passed.unionByName(rows.mapInArrow(work, schema + ", n_removed int, changed boolean"))


ship(__name__)
