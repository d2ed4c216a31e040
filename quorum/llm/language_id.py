"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every hashed n-gram of every labelled training text: each task
adds up its own counts per language and emits one row per language and part of
the table, and Spark sums those. The log-probability matrix has
``N_BUCKETS`` x languages entries whatever the corpus size (2^15 x 100
languages x 4 bytes = 13 MB); it is broadcast, and texts are scored as sparse
count vectors against it in numpy. Texts are read whole, in slices of at most
``SLICE`` characters, so a long text needs no large array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import held_out, ship, small_batches

N_BUCKETS = 1 << 15
SIZES = (1, 2, 3)
SLICE = 1 << 18
SMOOTHING = 0.5
PARTS = 16
UNKNOWN = "und"


def gram_hashes(codes: np.ndarray, sizes: tuple[int, ...], n_buckets: int) -> list[tuple[np.ndarray, int]]:
    """(bucket of the n-gram that starts at each position, n) for each size."""
    out, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(sizes) + 1):
        if len(codes) < n:
            break
        h = (h[:len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1:] + np.uint32(n << 24))
        if n in sizes:
            mixed = h * np.uint32(0x9E3779B1)
            out.append((((mixed >> np.uint32(15)) ^ mixed) & np.uint32(n_buckets - 1), n))
    return out


def slices(texts: list[str], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, row of each) of the lower-cased texts, a bounded number at a time.

    Each text is framed by spaces and followed by NULs; slices of a long text
    overlap so that every n-gram starts in exactly one slice.
    """
    codes, owners, size = [], [], 0
    for row, text in enumerate(texts):
        framed = f" {(text or '').lower()} "
        for at in range(0, len(framed), SLICE):
            piece = framed[at:at + SLICE]
            points = np.frombuffer(piece.encode("utf-32-le", "replace"), dtype=np.uint32)
            codes.append(points)
            owners.append(np.full(len(points), row, dtype=np.int32))
            if at + SLICE < len(framed):  # the tail's n-grams go on into the next slice
                tail = np.frombuffer(framed[at + SLICE:at + SLICE + max(sizes) - 1].encode("utf-32-le", "replace"), dtype=np.uint32)
                codes.append(tail)
                owners.append(np.full(len(tail), -1, dtype=np.int32))
            else:
                codes.append(np.full(max(sizes) - 1, 0, dtype=np.uint32))
                owners.append(np.full(max(sizes) - 1, -1, dtype=np.int32))
            size += len(points)
            if size >= SLICE:
                yield np.concatenate(codes), np.concatenate(owners)
                codes, owners, size = [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(owners)


def count_grams(docs: DataFrame, text_col: str, lang_col: str, n_buckets: int = N_BUCKETS,
                sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(lang, part, docs, counts array<long>): summed counts of the n-gram buckets; part p holds the p-th block of buckets."""
    width = n_buckets // PARTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for pdf in batches:
            langs, rows = np.unique(pdf["lang"].to_numpy(dtype=object).astype(str), return_inverse=True)
            for k, lang in enumerate(langs):
                texts = pdf["text"][rows == k].tolist()
                counts = table.setdefault(lang, np.zeros(n_buckets, dtype=np.int64))
                n_docs[lang] = n_docs.get(lang, 0) + len(texts)
                for codes, owners in slices(texts, sizes):
                    for hashes, _ in gram_hashes(codes, sizes, n_buckets):
                        counts += np.bincount(hashes[owners[:len(hashes)] >= 0], minlength=n_buckets)
        for lang, counts in table.items():
            yield pd.DataFrame({"lang": lang, "part": range(PARTS), "docs": n_docs[lang],
                                "counts": list(counts.reshape(PARTS, width))})

    partial = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .filter("text is not null and lang is not null") \
        .mapInPandas(run, "lang string, part int, docs long, counts array<long>")
    longs = partial.select("lang", "part", "docs", F.posexplode("counts").alias("k", "n")).filter("n > 0 or k = 0")
    return longs.groupBy("lang", "part", "k").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")) \
        .groupBy("lang", "part").agg(F.max(F.when(F.col("k") == 0, F.col("docs"))).alias("docs"),
                                     F.collect_list(F.struct("k", "n")).alias("cells"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n_buckets: int = N_BUCKETS,
          sizes: tuple[int, ...] = SIZES) -> dict:
    """The model: its languages and the (bucket, language) matrix of log probabilities, with log priors.

    Defined cases: rows with null text or language teach nothing; without any
    row there are no languages and every prediction is ``und``.
    """
    rows = count_grams(docs, text_col, lang_col, n_buckets, sizes).collect()  # languages x PARTS rows
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((n_buckets, len(langs)))
    n_docs = np.zeros(len(langs))
    width = n_buckets // PARTS
    for r in rows:
        k = langs.index(r["lang"])
        n_docs[k] = max(n_docs[k], r["docs"] or 0)
        cells = np.array([(c["k"], c["n"]) for c in r["cells"]], dtype=np.int64).reshape(-1, 2)
        counts[r["part"] * width + cells[:, 0], k] = cells[:, 1]
    counts += SMOOTHING
    return {"langs": langs, "sizes": sizes, "n_buckets": n_buckets,
            "logs": np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else counts,
            "prior": np.log(n_docs / n_docs.sum()) if langs else n_docs}


def score_texts(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    langs, sizes = model["langs"], model["sizes"]
    known = np.array([bool(t) and regex.search(r"\p{L}", t) is not None for t in texts], dtype=bool)
    if not langs or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = np.tile(model["prior"], (len(texts), 1))
    for codes, owners in slices([t if k else "" for t, k in zip(texts, known)], sizes):
        starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        for hashes, _ in gram_hashes(codes, sizes, model["n_buckets"]):
            here = starts[starts < len(hashes)]
            sums = np.add.reduceat(model["logs"][hashes], here, axis=0, dtype=np.float64)
            rows = owners[here]
            np.add.at(total, rows[rows >= 0], sums[rows >= 0])
    total -= total.max(axis=1, keepdims=True)
    chance = np.exp(total)
    chance /= chance.sum(axis=1, keepdims=True)
    best = chance.argmax(axis=1)
    names = [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
    return names, np.where(known, chance[np.arange(len(texts)), best], 0.0)


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row with lang_pred and score.

    Defined cases: a null text and one without a letter give ``und`` and score
    0; ties go to the first language in order of name; columns lang_pred and
    score of the input are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(keep if keep is not None else ["*"])).drop("lang_pred", "score")
    names = kept.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    picked = names if keep is None else [c for c in keep if not isinstance(c, str) or c in names]
    rows = docs.select(F.col(text_col).alias("_whole_text"), *picked)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in small_batches(batches):
            langs, scores = score_texts(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, (schema + ", " if schema else "") + "lang_pred string, score double")


def train_on_learnable(docs: DataFrame, id_col: str = "doc_id", **options) -> dict:
    """``train`` on the rows that aren't held out."""
    return train(docs.filter(~held_out(id_col)), **options)


ship(__name__)
