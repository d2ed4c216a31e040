"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quorum.llm import periodic
from quorum.llm.catalog import QUERIES
from tests.llm.conftest import SF


def plain_runs(x):
    """(start, length, period) by scanning the places where words q apart are equal, for every q."""
    n, by_stretch = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and x[e] == x[e + q]:
                e += 1
            if e - i + q >= max(6, 4 * q) and e > i:
                by_stretch.setdefault((i, e - i + q), q)  # periods ascend, so the smallest is first
            i = e + 1
    return sorted((s, size, q) for (s, size), q in by_stretch.items())


def expected(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query_equals_brute_force(spark, documents):
    want = sorted((expected(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()), key=repr)
    assert rows_of(QUERIES["op13_periodic_runs"](spark, SF)) == want
    assert any(r[1] for r in want) and any(not r[1] for r in want)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_sequences(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 3 == 0:
        monkeypatch.setattr(periodic, "GRID", 5)  # many rounds of candidates
    x = []
    while len(x) < rng.choice([30, 200, 500]):
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 30))]
        x += (unit * rng.randint(1, 9))[:rng.randint(1, 250)]
        if len(x) > 20 and rng.random() < 0.3:  # runs of runs
            x += x[-20:] * rng.randint(1, 5)
    got = [tuple(r) for r in periodic.find_runs(np.array(x, dtype=np.int64)).tolist()]
    assert got == sorted(plain_runs(x), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(20))
def test_extensions(seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.integers(0, 3, 120), rng.integers(1, 6, 120))
    x = np.concatenate([x, x[:150], x[50:]])
    i = rng.integers(0, len(x) - 1, 2000)
    j = i + 1 + (rng.random(2000) * (len(x) - 1 - i)).astype(int)
    got = periodic.Grammar(x).extend(i, j)
    for a, b, k in zip(i.tolist(), j.tolist(), got.tolist()):
        assert (x[a:a + k] == x[b:b + k]).all() and (b + k == len(x) or x[a + k] != x[b + k])


def test_long_texts():
    one = periodic.find_runs(np.zeros(300_000, dtype=np.int64))
    assert one.tolist() == [[0, 300_000, 1]]
    x = np.tile(np.arange(25_000), 5)
    assert periodic.find_runs(np.concatenate([[99_999], x, [99_998]])).tolist() == [[1, 125_000, 25_000]]
    fib = [0]
    before = [1]
    while len(fib) < 20_000:  # Fibonacci words hold no fourth power
        fib, before = fib + before, fib
    assert not len(periodic.find_runs(np.array(fib, dtype=np.int64)))
    many = np.repeat(np.arange(20_000) % 7, 6)
    assert len(periodic.find_runs(many)) == 20_000 + 1  # every block, and the whole by 42


def test_edge_cases(make):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 5), (5, "a " * 6), (6, "a b " * 4 + "a"), (None, "x " * 30), (7, "É é " * 9),
            (7, "É é " * 9), (8, "A a " * 3), (9, "w " * 7 + "\x85 " * 7)]
    df = make(rows)
    assert rows_of(periodic.periodic_runs(df)) == sorted((expected(i, t, False) for i, t in rows), key=repr)
    full = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert [tuple(c) for c in full[9].runs] == [(0, 7, 1), (7, 7, 1)] and full[9].collapsed == "w \x85" and full[9].n_words == 14
    assert periodic.periodic_runs(make([])).collect() == []
