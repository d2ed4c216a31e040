"""Quality classifier: Bradley-Terry pairwise ranking of documents.

A document's worth is linear in its features. Learning takes preference pairs
(a good document, a bad one) and fits the weights by logistic loss on the
feature differences, so only the order of scores matters; a cut at a quantile
of the training scores then turns them into decisions.

Every labelled row that isn't held out takes part, in the weights and in the cut. The
rows of each class are dealt into blocks of about ``BLOCK_ROWS`` by a hash, and the pairs
are drawn between a block's rows; a class too small for its own share of the blocks
meets several of them with the same rows. A Newton step is one pass over the blocks,
whose gradients and Hessians (about 20 x 20 numbers a block) are added up by Spark, and the cut is a
quantile of all scores, narrowed down by counts. Blocks and orders don't depend on partitions.
With ``sample_rows``, ``learn`` fits a bounded sample on the driver instead.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import held_out, scratch, ship
from quorum.session import cut_lineage

BLOCK_ROWS = 5000  # rows of the larger class in a block of pairs
PAIRS_PER_ROW = 8
FEATURES = ("log_words", "mean_word", "long_words", "distinct_words", "top_word", "echo_words", "repeat_trigrams",
            "dup_lines", "symbols", "pipes", "bangs", "upper", "digits", "other_marks", "stops", "line_words",
            "is_empty")
_SYMBOLS = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((b"#*$%&<>", b"|", b"!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
                             b"\"'()+-/:;=?@[]^_`{}~\\", b".,"), 1):
    _SYMBOLS[list(_chars)] = _k


def features(text: str | None) -> list[float]:
    """The feature values of one whole text, in the order of ``FEATURES``."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    kinds = np.bincount(_SYMBOLS[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)], minlength=8)
    upper = int(kinds[4]) + (0 if text.isascii() else len(re.findall(r"[À-ÖØ-Þ]", text)))
    often = Counter(words)
    trigrams = set(zip(words, words[1:], words[2:]))
    lines = [line for line in text.split("\n") if line.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    return [
        float(np.log1p(n)), min(float(lengths.mean()), 50.0) / 10, float((lengths > 15).mean()), len(often) / n,
        max(often.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(trigrams) / max(n - 2, 1) if n > 2 else 0.0, 1 - len(set(lines)) / len(lines),
        min(int(kinds[1]) / n, 5.0), min(int(kinds[2]) / n, 5.0), min(int(kinds[3]) / n, 5.0),
        upper / lengths.sum(), int(kinds[5]) / lengths.sum(), min(int(kinds[6]) / n, 5.0), min(int(kinds[7]) / n, 5.0),
        float(np.log1p(n / len(lines))), 0.0]


def with_features(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``x``, the features of every whole text."""
    rows = docs.select(*keep, F.col(text_col).alias("_whole_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_whole_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="_whole_text").assign(x=[features(t) for t in pdf["_whole_text"]])

    return rows.mapInPandas(run, f"{schema}, x array<double>")


def pairs(good: np.ndarray, bad: np.ndarray, seed: int = 7) -> np.ndarray:
    """Feature differences of the preference pairs that are drawn between the rows of ``good`` and ``bad``."""
    draw = np.random.default_rng(seed)
    n_pairs = PAIRS_PER_ROW * max(len(good), len(bad))
    rows = np.arange(n_pairs)
    return good[draw.permutation(len(good))[rows % len(good)]] - bad[draw.permutation(n_pairs) % len(bad)]


def slopes(diff: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the summed loss log(1 + exp(-w.diff))."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
    return -(diff * p[:, None]).sum(axis=0), (diff * (p * (1 - p))[:, None]).T @ diff


def newton(summed, mean: np.ndarray, spread: np.ndarray, penalty: float) -> dict:
    """The weights that minimise the mean loss + penalty; ``summed(w)`` gives (pairs, gradient, Hessian) over all of them."""
    w = np.zeros(len(mean))
    for _ in range(50):  # Newton steps on the convex loss
        n_pairs, grad, hess = summed(w)
        step = np.linalg.solve(hess / n_pairs + penalty * np.eye(len(w)), grad / n_pairs + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return {"w": w / spread, "shift": float((mean / spread) @ w)}


def fit(good: np.ndarray, bad: np.ndarray, penalty: float = 1e-3, seed: int = 7) -> dict:
    """Bradley-Terry weights from preference pairs between the rows of ``good`` and ``bad``."""
    both = np.vstack([good, bad])
    mean, spread = both.mean(axis=0), both.std(axis=0)
    spread[spread < 1e-9] = 1.0
    diff = pairs((good - mean) / spread, (bad - mean) / spread, seed)
    return newton(lambda w: (len(diff), *slopes(diff, w)), mean, spread, penalty)


def in_blocks(found: DataFrame, rows: dict[int, int], id_col: str, label_col: str) -> DataFrame:
    """(block, label, x): the rows of ``found`` dealt into blocks, sorted by (block, label, hash, id, x), whole blocks a partition.

    The smaller class is dealt into as few shares as leave about ``BLOCK_ROWS`` / 5 rows in each, and a share goes to
    every block of its remainder. Equal rows are counted first and dealt by their number, so that no block depends on partitions.
    """
    n_blocks = max(1, math.ceil(max(rows.values()) / BLOCK_ROWS))
    shares = {k: n_blocks if n == max(rows.values()) else min(n_blocks, max(1, n * 5 // BLOCK_ROWS)) for k, n in rows.items()}
    share = F.when(F.col(label_col) == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    copies = found.groupBy(id_col, label_col, "x").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    dealt = copies.withColumn("_share", F.pmod(F.xxhash64(F.lit("block"), F.col(id_col), "x", "_copy"), share)) \
        .withColumn("block", F.explode(F.sequence(F.col("_share"), F.lit(n_blocks - 1).cast("long"), share.cast("long"))))
    order = ["block", label_col, F.xxhash64(F.col(id_col)), id_col, "x"]
    return dealt.repartition(min(n_blocks, 2000), "block").sortWithinPartitions(*order) \
        .select("block", F.col(label_col).cast("int").alias("label"), "x")


def fit_blocks(blocks: DataFrame, mean: np.ndarray, spread: np.ndarray, penalty: float = 1e-3, seed: int = 7) -> dict:
    """``fit`` over the pairs of all blocks; ``blocks`` is what ``in_blocks`` gives, written with its partitions."""
    def summed(w: np.ndarray) -> tuple:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, grad, hess, open_, rows = 0, np.zeros(len(w)), np.zeros((len(w), len(w))), None, []

            def close() -> None:
                nonlocal n, grad, hess
                label = np.concatenate([r[0] for r in rows])
                x = (np.concatenate([r[1] for r in rows]) - mean) / spread
                if 0 < label.sum() < len(label):
                    diff = pairs(x[label == 1], x[label == 0], seed)
                    g, h = slopes(diff, w)
                    n, grad, hess = n + len(diff), grad + g, hess + h

            for pdf in batches:
                block = pdf["block"].to_numpy()
                cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
                for part in np.split(np.arange(len(pdf)), cuts):
                    if len(part):
                        if open_ is not None and block[part[0]] != open_:
                            close()
                            rows = []
                        open_ = block[part[0]]
                        rows.append((pdf["label"].to_numpy()[part], np.stack(pdf["x"].to_numpy()[part])))
            if rows:
                close()
            if n:
                yield pd.DataFrame({"n": [n], "grad": [grad.tolist()], "hess": [hess.ravel().tolist()]})

        # one row a partition, whose numbers Spark adds up place by place
        each = blocks.mapInPandas(run, "n long, grad array<double>, hess array<double>") \
            .select("n", F.posexplode(F.concat("grad", "hess")).alias("place", "v"))
        total = each.groupBy("place").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # about 20 + 20 x 20 rows
        values = np.zeros(len(w) * (len(w) + 1))
        for r in total:
            values[r["place"]] = r["v"]
        return total[0]["n"], values[:len(w)], values[len(w):].reshape(len(w), len(w))

    return newton(summed, mean, spread, penalty)


_BINS = 4096
_COLLECTED = 20_000  # scores of one bin that come to the driver


def weighted_cut(scores: DataFrame, weights: dict[int, float], below: float) -> float:
    """Where the scores (label, worth), weighted by their labels, first reach the weight ``below``: the middle of that score and the next.

    Counts in bins of the scores' range narrow it down to few rows, or to one value; nothing is estimated.
    """
    weight = F.when(F.col("label") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    low, high = scores.agg(F.min("worth"), F.max("worth")).first()
    before, after, part = 0.0, high, scores
    while True:
        width = (high - low) / _BINS
        place = F.least(F.floor((F.col("worth") - F.lit(low)) / F.lit(width)), F.lit(_BINS - 1)) if width > 0 else F.lit(0)
        bins = sorted(part.groupBy(place.cast("long").alias("place")).agg(
            F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("n1"), F.count(F.lit(1)).alias("n"),
            F.min("worth").alias("low"), F.max("worth").alias("high")).collect(), key=lambda r: r["place"])  # at most _BINS rows
        for i, r in enumerate(bins):
            held = r["n1"] * weights[1] + (r["n"] - r["n1"]) * weights[0]
            if before + held >= below or i == len(bins) - 1:
                break
            before += held
        low, high, after = r["low"], r["high"], bins[i + 1]["low"] if i + 1 < len(bins) else after
        part = part.filter(F.col("worth").between(low, high))
        if r["n"] <= _COLLECTED:
            rows = sorted((x["worth"], weights[x["label"]]) for x in part.select("worth", "label").collect())
            sums = before + np.cumsum([w for _, w in rows])
            at = min(int(np.searchsorted(sums, below)), len(rows) - 1)
            return (rows[at][0] + (rows[at + 1][0] if at + 1 < len(rows) else after)) / 2
        if low == high:
            # rows of one value, of either label; the next one is another unless the weight is reached at the last of them
            return low if before + held > below + max(weights.values()) / 2 else (low + after) / 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int | None = None) -> dict:
    """The ranking model and its cut, learned from all labelled rows that aren't held out.

    Defined cases: rows with a null label or id and labels without a document
    teach nothing; with one class only, or without rows, every score is 0.5.
    ``sample_rows`` bounds the rows of each class to the first ones in the order of a hash of their ids.
    """
    marked = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()) \
        .select(id_col, label_col)
    sizes = {0: 0, 1: 0} | {r[0]: r[1] for r in marked.groupBy(label_col).count().collect()}
    if sample_rows is not None:
        return _learn_sample(docs, marked, sizes, id_col, text_col, label_col, sample_rows)
    learnable = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    # features are small, so they and not the texts meet the labels
    found = scratch(with_features(learnable, id_col, text_col, [id_col]).join(marked, id_col).select(
        id_col, F.col(label_col).cast("int").alias("label"), "x"), "quality-rows")
    places = [F.col("x")[i] for i in range(len(FEATURES))]
    totals = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0)), *[F.avg(x) for x in places], *[F.stddev_pop(x) for x in places]).first()
    rows = {0: totals[0] - totals[1], 1: totals[1]}
    if not rows[0] or not rows[1]:
        return _NO_MODEL
    mean, spread = np.array(totals[2:], dtype=np.float64).reshape(2, -1)
    spread = np.where(spread < 1e-9, 1.0, spread)
    model = fit_blocks(cut_lineage(in_blocks(found, rows, id_col, "label")), mean, spread)
    worth = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in model["w"]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scores = scratch(found.select("label", (worth - F.lit(model["shift"])).alias("worth")), "quality-worth")
    # the quantile at which the scores, weighted to the labels' own shares, leave out the share of label 0
    weights = {k: sizes[k] / rows[k] for k in rows}
    cut = weighted_cut(scores, weights, sizes[0] - 1e-12 * sum(sizes.values()))
    return model | {"cut": float(cut), "unit": float(max(scores.agg(F.stddev_pop("worth")).first()[0], 1e-9) / 2)}


_NO_MODEL = {"w": np.zeros(len(FEATURES)), "shift": 0.0, "cut": 0.0, "unit": 1.0}


def _learn_sample(docs: DataFrame, marked: DataFrame, sizes: dict, id_col: str, text_col: str, label_col: str, sample_rows: int) -> dict:
    parts = [marked.filter(F.col(label_col) == k).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(sample_rows)
             for k in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # at most 2 x sample_rows rows
    found = with_features(docs.select(id_col, text_col).join(F.broadcast(sample), id_col), id_col, text_col, [id_col, label_col])
    order = [F.xxhash64(F.col(id_col)), id_col, "x"]
    # ids may repeat, so the rows are bounded as well; rows that tie in this order are equal
    rows = [r for k in (0, 1) for r in found.filter(F.col(label_col) == k).orderBy(*order).limit(sample_rows).collect()]
    x = {k: np.array([r["x"] for r in rows if r[label_col] == k]).reshape(-1, len(FEATURES)) for k in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return _NO_MODEL
    model = fit(x[1], x[0])
    scores = {k: v @ model["w"] - model["shift"] for k, v in x.items()}
    # the quantile at which the scores, weighted to the labels' own shares, leave out the share of label 0
    every = np.concatenate([scores[0], scores[1]])
    weight = np.concatenate([np.full(len(scores[k]), sizes[k] / len(scores[k])) for k in (0, 1)])
    order = np.argsort(every, kind="stable")
    below = np.cumsum(weight[order]) / weight.sum()
    at = int(np.searchsorted(below, sizes[0] / (sizes[0] + sizes[1]) - 1e-12))
    low, high = every[order][at], every[order][min(at + 1, len(every) - 1)]
    return model | {"cut": float((low + high) / 2), "unit": float(max(np.std(every), 1e-9) / 2)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str | Column] | None = None) -> DataFrame:
    """``keep`` (default: the id) of every row with score in 0 to 1 and predicted (score >= 0.5), which replace any such columns.

    Defined cases: a null text counts as empty, an empty text has the features
    of a text without words; repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(keep if keep is not None else [id_col]), F.col(text_col).alias("_whole_text")).drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_whole_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            x = np.array([features(t) for t in pdf["_whole_text"]]).reshape(-1, len(FEATURES))
            chance = 1 / (1 + np.exp(-np.clip((x @ m["w"] - m["shift"] - m["cut"]) / m["unit"], -700, 700)))
            yield pdf.drop(columns="_whole_text").assign(score=chance, predicted=(chance >= 0.5).astype(np.int32))

    return rows.mapInPandas(run, f"{schema}, score double, predicted int")


ship(__name__)
