import re
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from quorum.llm import quality as op
from quorum.llm.catalog import QUERIES
from quorum.llm.common import read
from tests.llm.conftest import SF

SF001 = "/root/testdata/sf0.01"


def test_held_out_ranking(spark):
    got = QUERIES["op4_quality_classifier"](spark, SF001).join(read(spark, SF001, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    good, bad = ([r.score for r in held if r.quality == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_pairs_set_the_order():
    rnd = np.random.default_rng(1)
    good, bad = rnd.normal(1, 1, (200, 4)), rnd.normal(0, 1, (50, 4))
    model = op.fit(good, bad)
    score = lambda x: x @ model["w"] - model["shift"]
    assert (score(good)[:, None] > score(bad)[None, :]).mean() > 0.85


def test_edges(spark, make):
    docs = make([(1, None), (2, ""), (3, " \n "), (4, "good words here"), (4, "good words here"), (None, "x" * 100000)])
    labels = spark.createDataFrame([(4, 1, None), (None, 0, 0), (99, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = op.learn(docs, labels)
    got = op.score(docs, model).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5}
    assert op.score(docs.limit(0), model).count() == 0
    assert len(op.features("a b\nc")) == len(op.features(None)) == len(op.FEATURES)


def brute_features(text):
    """Each feature by its meaning, with plain loops."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * 16 + [1.0]
    count = lambda chars: sum(text.count(c) for c in chars)
    letters = sum(len(w) for w in words)
    upper = sum(1 for c in text if re.match("[A-Z\u00c0-\u00d6\u00d8-\u00de]", c))
    windows = [tuple(words[i:i + 3]) for i in range(n - 2)]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(n), min(letters / n, 50) / 10, sum(len(w) > 15 for w in words) / n, len(set(words)) / n,
        max(words.count(w) for w in set(words)) / n, sum(words[i] == words[i + 1] for i in range(n - 1)) / n,
        1 - len(set(windows)) / len(windows) if windows else 0.0, 1 - len(set(lines)) / len(lines),
        min(count("#*$%&<>") / n, 5), min(count("|") / n, 5), min(count("!") / n, 5), upper / letters,
        count("0123456789") / letters, min(count("\"'()+-/:;=?@[]^_`{}~\\") / n, 5), min(count(".,") / n, 5),
        np.log1p(n / len(lines)), 0.0]


def brute_scores(spark, sf):
    """Score of every document: features, pairs, an accelerated gradient descent on the loss, the weighted quantile."""
    docs = read(spark, sf, "documents").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).collect()
    label = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect() if crc32(str(r.doc_id).encode()) % 3 != 1}
    x = {r.doc_id: brute_features(r.text) for r in docs}
    learned = sorted((r.h, r.doc_id) for r in docs if label.get(r.doc_id) in (0, 1))
    bad, good = (np.array([x[i] for _, i in learned if label[i] == k]) for k in (0, 1))
    both = np.vstack([good, bad])
    mean, spread = both.mean(axis=0), both.std(axis=0)
    spread = np.where(spread < 1e-9, 1, spread)
    g, b = (good - mean) / spread, (bad - mean) / spread
    draw = np.random.default_rng(7)
    n = op.PAIRS_PER_ROW * max(len(g), len(b))
    first, second = draw.permutation(len(g)), draw.permutation(n)
    diff = np.array([g[first[i % len(g)]] - b[second[i] % len(b)] for i in range(n)])
    steep = np.linalg.eigvalsh(diff.T @ diff / n)[-1] / 4 + 1e-3
    push = (1 - (1e-3 / steep) ** 0.5) / (1 + (1e-3 / steep) ** 0.5)
    w = at = np.zeros(len(mean))
    for _ in range(3000):
        new = at - (1e-3 * at - (diff / (1 + np.exp(diff @ at))[:, None]).mean(axis=0)) / steep
        w, at = new, new + push * (new - w)
    worth = {i: float(((v - mean) / spread) @ w) for i, v in x.items()}
    # the quantile of the learned rows' worth that leaves out the share of bad labels
    sizes = [sum(v == k for v in label.values()) for k in (0, 1)]
    shares = sorted((worth[i], sizes[label[i]] / (len(bad), len(good))[label[i]] / sum(sizes)) for _, i in learned)
    below, place = 0.0, 0
    while below + shares[place][1] < sizes[0] / sum(sizes) - 1e-12:
        below += shares[place][1]
        place += 1
    cut = (shares[place][0] + shares[place + 1][0]) / 2
    unit = np.std([worth[i] for _, i in learned]) / 2
    return {i: 1 / (1 + np.exp(-(v - cut) / unit)) for i, v in worth.items()}


def test_query_equals_brute_force(spark):
    want = brute_scores(spark, SF001)
    got = QUERIES["op4_quality_classifier"](spark, SF001).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-4, r
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == (r.score >= 0.5)


def test_sample_is_bounded_and_ordered(spark, make, monkeypatch):
    ids = [i for i in range(400) if crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"word{j} " * (5 + i % 7 + j)) for i in ids for j in range(5)] + [(ids[0], "hot row here")] * 500
    labels = spark.createDataFrame([(i, i % 2, None) for i in ids], "doc_id long, quality int, toxic int")
    taken = []
    fit = op.fit
    monkeypatch.setattr(op, "fit", lambda good, bad: taken.append((good, bad)) or fit(good, bad))
    models = [op.learn(make(rows).repartition(n), labels, sample_rows=30) for n in (1, 7)]
    assert [len(x) for pair in taken for x in pair] == [30] * 4
    assert all(np.array_equal(a, b) for a, b in zip(*taken)) and np.array_equal(models[0]["w"], models[1]["w"])


def test_kept_columns_that_clash(make):
    docs = make([(1, "some words"), (2, None)]).withColumns({"score": F.lit("x"), "predicted": F.lit("y")})
    model = {"w": np.zeros(len(op.FEATURES)), "shift": 0.0, "cut": 0.0, "unit": 1.0}
    got = op.score(docs, model, keep=["doc_id", "score", "predicted"])
    assert got.columns == ["doc_id", "score", "predicted"] and {r.score for r in got.collect()} == {0.5}


def test_every_labelled_row_is_learned(spark, make, monkeypatch):
    """Weights and cut come from all rows, however many: more than one block of them, of classes of very different sizes."""
    ids = [i for i in range(18000) if crc32(str(i).encode()) % 3 != 1]
    bad = {i for i in ids if i % 11 == 0}
    rnd = np.random.default_rng(3)
    sizes = {i: int(rnd.integers(1, 60) + (0 if i in bad else 12)) for i in ids}
    docs = make([(i, " ".join(f"w{j}" for j in range(n))) for i, n in sizes.items()], extra=False)
    labels = spark.createDataFrame([(i, int(i not in bad), None) for i in ids], "doc_id long, quality int, toxic int")
    seen = []
    fit_blocks = op.fit_blocks
    monkeypatch.setattr(op, "fit_blocks", lambda blocks, *a: seen.append(blocks) or fit_blocks(blocks, *a))
    model = op.learn(docs, labels)
    assert len(ids) - len(bad) > 2 * op.BLOCK_ROWS > 5000
    blocks = [r["block"] for r in seen[0].filter("label = 0").collect()]
    assert seen[0].filter("label = 1").count() == len(ids) - len(bad) and set(blocks) == {0, 1, 2} and len(blocks) == 3 * len(bad)
    x = {i: np.array(op.features(" ".join(f"w{j}" for j in range(n)))) for i, n in sizes.items()}
    worth = {i: float(v @ model["w"] - model["shift"]) for i, v in x.items()}
    # the cut leaves out as many rows as are bad, but for those that tie with it
    assert sum(v < model["cut"] - 1e-9 for v in worth.values()) <= len(bad) <= sum(v <= model["cut"] + 1e-9 for v in worth.values())
    monkeypatch.setattr(op, "_COLLECTED", 1)
    again = op.learn(docs.repartition(5), labels.repartition(3))
    assert np.allclose(again["w"], model["w"], rtol=1e-6, atol=1e-9) and abs(again["cut"] - model["cut"]) < 1e-9
