import random
from collections import Counter, defaultdict

import numpy as np

from quorum.llm import near_dedup as op
from quorum.llm.catalog import QUERIES
from quorum.llm.components import components
from tests.llm.conftest import SF


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size=4, percent=80):
    """Sets of all the shingles and components by comparing every pair that shares one."""
    sets = [shingles(t, size) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    having = defaultdict(list)
    for k, s in enumerate(sets):
        for j, n in Counter(j for t in s for j in having[t]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(rows[k][0]), find(rows[j][0])))
                root[b] = a
        for t in s:
            having[t].append(k)
    return [len(s) for s in sets], {i: find(i) for i, _ in rows}


def check(df, rows, size=4):
    counts, root = brute(rows, size)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())
    assert got == Counter((i, n, root[i], root[i] == i) for (i, _), n in zip(rows, counts))


def variants(seed, families=12):
    """Near copies at every distance around the threshold, documents that share most of a passage, and loners."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([3, 6, 30, 120, 400]))]
        for _ in range(rnd.randrange(1, 8)):
            copy = list(base)
            for _ in range(int(len(copy) * rnd.choice([0, 0.01, 0.03, 0.05, 0.08]))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            base = copy if rnd.random() < 0.3 else base
    passage = [word() for _ in range(60)]
    rows += [" ".join(passage + [word() for _ in range(rnd.randrange(2, 40))]) for _ in range(40)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(make):
    rows = variants(1) + [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two"), (1004, "\xa0"), (1005, "é x\x1cy z w")]
    check(op.near_dedup(make(rows)), rows)
    check(op.near_dedup(make(rows), shingle=5), rows, 5)


def test_star_with_an_outlying_centre(make):
    """Two members that are near each other but both far from the smallest id of their buckets."""
    words = [f"p{i}" for i in range(200)]
    rows = [(1, " ".join(words + [f"a{i}" for i in range(60)])),
            *((10 + k, " ".join(words + [f"b{i}" for i in range(40)] + [f"c{k}"])) for k in range(6))]
    check(op.near_dedup(make(rows)), rows)


def test_hot_groups(make, monkeypatch):
    monkeypatch.setattr("quorum.llm.common.HOT_SHARE", 20)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"{passage} tail{i % 40} x{i}") for i in range(200)] + [(500 + i, passage) for i in range(100)]
    check(op.near_dedup(make(rows)), rows)


def test_edges(make):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "q"), (2, "q")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in op.near_dedup(make(rows)).collect()), key=repr)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True)], key=repr)
    assert op.near_dedup(make(rows).limit(0)).count() == 0


def test_sketches_collide_as_often_as_sets_are_similar():
    rnd, order = np.random.default_rng(2), op.bin_order()
    for size in (4, 40, 1000):
        a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(size * 0.9) or 1], rnd.integers(0, 1 << 63, size - int(size * 0.9), dtype=np.uint64)]))
        similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (op.sketch(np.sort(a), order) == op.sketch(np.sort(b), order)).mean()
        assert abs(same - similar) < 0.25


def test_parity_bits_never_overstate_the_difference():
    rnd = np.random.default_rng(3)
    for n in (3, 50, 2000):
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 4:], rnd.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        differ = int(np.bitwise_count((op.parity(a) ^ op.parity(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (n > 50 or differ > 0)


def test_components_of_a_long_path(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b").unionByName(spark.range(300, 305).selectExpr("id as a", "id * 2 as b"))
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{i * 2: i for i in range(300, 305)}}


def test_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(QUERIES["op7_minhash"](spark, SF), rows)
