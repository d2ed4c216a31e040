"""SimHash near-duplicates against a plain fingerprint and all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quorum.llm import simhash
from quorum.llm.catalog import QUERIES
from tests.llm.conftest import SF


def plain_fingerprint(text, size=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    cells = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64(c.encode(), seed=42).intdigest() for c in cells]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=4):
    """{fingerprint: smallest fingerprint reachable} over all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= bits:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in prints}


def expected(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    return sorted(((i, f"{p:016x}", least.get(comp[p])) for i, p in prints), key=repr)


def test_query_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = QUERIES["op12_simhash"](spark, SF).collect()
    want = expected(rows)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert any(i != c for i, _, c in want)


def test_segments_share_a_variant_at_four_bits(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(2000):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))))
    signed = [tuple(simhash._signed(x) for x in p) for p in pairs]
    df = spark.createDataFrame(signed, "a long, b long")
    shared = df.select(F.arrays_overlap(simhash.wildcard_keys("a"), simhash.wildcard_keys("b")).alias("s"))
    assert shared.filter("not s").count() == 0


@pytest.mark.parametrize("level", range(6))
def test_parts_cover_the_bits_outside_a_segment(level):
    for (first, size), masks in zip(simhash.SEGMENTS, simhash.part_masks(level)):
        assert sum(masks) == (1 << 64) - 1 - (((1 << size) - 1) << first)
        assert sum(m.bit_count() for m in masks) == 64 - size


@pytest.mark.parametrize("bucket", [2048, 30])
def test_components_of_dense_fingerprints(spark, bucket):
    """Chains, balls and fingerprints that share a segment, with keys that must be divided."""
    rng = random.Random(7)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(60):  # a walk and the neighbours of its steps
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(p)
            prints.add(p ^ 1 << rng.randrange(64))
    same = rng.getrandbits(22)
    prints |= {same | rng.getrandbits(42) << 22 for _ in range(200)}  # one hot segment, nothing else in common
    nodes = spark.createDataFrame([(simhash._signed(p), 1) for p in prints], "fp long, copies long")
    links = simhash.links_of(simhash.scratch(nodes, "test"), bucket=bucket)
    edges = [(r.a, r.b) for r in links.collect()]
    root = {simhash._signed(p): simhash._signed(p) for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for p in root:
        groups.setdefault(find(p), set()).add(p)
    want = {}
    for p, c in plain_components(prints).items():
        want.setdefault(c, set()).add(simhash._signed(p))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_trees_connect_what_pairs_connect():
    import numpy as np
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 60, 900)).astype(np.int64)
    prints = rng.integers(0, 1 << 14, 900).astype(np.uint64)
    a, b = simhash._trees(keys, prints, 2)
    assert (np.bitwise_count(a ^ b) <= 2).all() and len(a) < 900 * 4
    for key in set(keys.tolist()):
        own = {int(p) for p in prints[keys == key]}
        root = {p: p for p in own}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p
        for x, y in zip(a.tolist(), b.tolist()):
            if x in own and y in own:
                root[find(max(x, y))] = find(min(x, y))
        want = plain_components(own, 2)
        for p in own:  # links of other keys may join more, never less
            assert find(p) == find(want[p])


def test_edge_cases(make):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "ÀB c"), (None, "one two"), (7, long),
            (8, long + " extra"), (8, "other words that stand alone here"), (None, "nobody has this"), (9, "x")]
    got = simhash.simhash_dedup(make(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_hot_copies_and_empty_table(make):
    rows = [(i, "the same text of many words again") for i in range(300)] + [(1000 + i, f"text number {i} of {i * i}") for i in range(100)]
    assert sorted((tuple(r) for r in simhash.simhash_dedup(make(rows)).collect()), key=repr) == expected(rows)
    assert simhash.simhash_dedup(make([])).collect() == []
    with pytest.raises(ValueError):
        simhash.simhash_dedup(make([]), bits=5)
