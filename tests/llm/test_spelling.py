"""Spelling variants against a plain count and deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quorum.llm import spelling
from quorum.llm.catalog import QUERIES
from tests.llm.conftest import SF


def plain_counts(rows, spoil=True):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if spoil and key is not None:
                h = zlib.crc32(f"{key}:{run}".encode())
                if h % 97 == 0:
                    run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_near(words):
    """{word: near words}, by words and gaps."""
    near = defaultdict(set)
    gaps = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[i, w[:i] + w[i + 1:]].add(w)
            short = w[:i] + w[i + 1:]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    return near


def expected(rows, spoil=True):
    n = plain_counts(rows, spoil)
    near = plain_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = expected(rows)
    assert rows_of(QUERIES["op11_spelling"](spark, SF)) == want
    assert any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])


@pytest.mark.parametrize("seed", range(20))
def test_blocks_give_all_pairs(seed):
    rng = random.Random(seed)
    length = rng.choice([5, 6, 9, 30])
    base = ["".join(rng.choices("abcé", k=length)) for _ in range(6)]
    words = set(base)
    for w in base * 40:
        i, c = rng.randrange(length), rng.choice("abcé")
        words.add(rng.choice([w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w + c]))
    words = sorted(words)
    queries = [w for w in words if len(w) == length]
    got = {}
    for first in (True, False):
        for q, x, longer in zip(*spelling.near_in_block(queries, words, length, first)):
            assert (queries[q], words[x]) not in got
            got[queries[q], words[x]] = bool(longer)
    near = plain_near(set(words))
    assert got == {(q, w): len(w) > length for q in queries for w in near[q]}


@pytest.mark.parametrize("block", [60, 4096])
def test_vocabulary_with_hot_halves(spark, block):
    """A half that a third of the words share is cut into parts when it has more words than a block."""
    rng = random.Random(3)
    words = {"prefix" + "".join(rng.choices("abc", k=6)) for _ in range(120)}
    words |= {"".join(rng.choices("xyz", k=rng.randint(4, 7))) + "ending" for _ in range(120)}
    words |= {"".join(rng.choices("mn", k=rng.randint(5, 8))) for _ in range(120)} | {"q" * k for k in range(5, 12)}
    n = {w: rng.choice([3, 5, 5, 12, 40]) for w in words}
    df = spelling.scratch(spark.createDataFrame(list(n.items()), "word string, n long"), "test")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df, block).collect()}
    near = plain_near(n)
    want = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            want[w] = (len(near[w]), n[best], best)
    assert got == want


def test_edge_cases(make):
    long = "z" * 5_000
    rows = [(1, None), (2, ""), (3, "word1 12 --"), (4, "Letters letters LETTERS letterz letterz letterz leters leters leters"),
            (5, "ÉTUDE étude ÉTUDE ÉTUDE"), (None, "letters letters letters letters"), (6, f"{long} {long} {long} {long}z {long}z {long}z"),
            (7, "abcde abcde abcde abcdf abcdf abcdf abcdg abcdg abcdg"), (7, "abcde abcde abcde"), (8, "four four four")]
    for spoil in (None, spelling.dropped_letter):
        assert rows_of(spelling.spelling_variants(make(rows), rewrite=spoil)) == expected(rows, spoil is not None)
    assert spelling.spelling_variants(make([])).collect() == []


def test_chains_are_followed_to_the_last(spark):
    chain = [("w%d" % i, "w%d" % (i + 1)) for i in range(30)] + [("v%d" % i, "w5") for i in range(50)]
    got = spelling.last_forms(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.word: r.root for r in got} == {w: "w30" for w, _ in chain}
