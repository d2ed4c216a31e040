import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quorum.llm import packing as op
from quorum.llm.catalog import QUERIES, tokenizer_path
from tests.llm.conftest import SF


def valid(lengths, bins, capacity):
    assert Counter(n for b in bins for n in b) == Counter(lengths) and all(0 < sum(b) <= capacity for b in bins)


def fewest(lengths, capacity):
    """Brute force: the smallest number of bins."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1:]])
        place(i + 1, [*rooms, capacity - lengths[i]])
    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_small_packings_are_optimal(lengths):
    bins = op.complete(lengths, 20)
    valid(lengths, bins, 20)
    assert len(bins) == fewest(lengths, 20)


@pytest.mark.parametrize("kind", ["exponential", "uniform", "thirds", "same"])
def test_large_packings_are_no_worse_than_best_fit(kind):
    rnd = random.Random(3)
    lengths = {"exponential": [min(2047, 1 + int(rnd.expovariate(1 / 600))) for _ in range(4000)],
               "uniform": [rnd.randrange(1, 2048) for _ in range(2000)],
               "thirds": [683] * 600 + [rnd.randrange(1, 1000) for _ in range(100)], "same": [700] * 900}[kind]
    bins = op.complete(lengths, 2048)
    valid(lengths, bins, 2048)
    assert len(bins) <= len(op.best_fit(lengths, 2048))
    if kind == "exponential":
        assert len(bins) == -(-sum(lengths) // 2048)


def check(rows, texts, capacity=2048):
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    want = Counter()
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k:k + capacity], dtype="<u4")
            want[i, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for row in places.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(k[3] * n for k, n in want.items())


def test_query(spark, documents):
    n, tokens = check(QUERIES["op6_packing"](spark, SF).collect(), [(r.doc_id, r.text) for r in documents.collect()])
    assert n <= tokens / 2048 * 1.02 + 1


def test_edges_and_many_shards(make):
    rows = [(1, None), (2, ""), (3, "a " * 5000), (3, "a " * 5000), (None, "b"), *((i, "c " * (i % 50)) for i in range(10, 200))]
    check(op.pack(make(rows), tokenizer_path(), shard_rows=20).collect(), rows)
    assert op.pack(make(rows).limit(0), tokenizer_path()).count() == 0
