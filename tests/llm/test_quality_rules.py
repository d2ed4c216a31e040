import math
import re
from collections import Counter
from math import comb

import pytest

from quorum.llm import quality_rules as op
from quorum.llm.catalog import QUERIES
from quorum.llm.common import read, scratch
from tests.llm.conftest import SF

TEXTS_SF = "/root/testdata/sf0.1"  # every stratum holds enough labelled texts there


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    often, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if often[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


TEXTS = ["", None, "a", "a b c", "a a a", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "a b c\x0bd\x1ce", "|<>#", "\n\n", "é é é é",
         " lead and trail ", "\xa0 x\xa0y", "w " * 3000, "one two three four " * 500]


def test_counts_equal_brute_force(make, documents):
    rows = make(TEXTS).select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    for r in op.base_counts(rows).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(r.text)
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])


@pytest.mark.parametrize("n,k", [(1, 0), (50, 0), (1000, 0), (1000, 3), (3000, 10)])
def test_binomial_tail_is_exact(spark, n, k):
    p = 0.005
    want = sum(comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1.0
    got = spark.createDataFrame([(k, n)], "k long, n long").select(op.binomial_tail("k", "n", p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def holdout(spark, n, n_bad):
    rows = [(i, 300, 1200, 60 if i < n_bad else 0, 0, 0) for i in range(n)]
    return scratch(spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                               "n_repeat_words long"), "test")


def cutoffs(df, spark):
    return {r.stratum: {rule: r[rule] for rule in op.RULES} for r in op.certify(df, spark).collect()}


def at(i):
    return {rule: cuts[i] for rule, (_, cuts) in op.RULES.items()}


def test_cutoffs_follow_the_holdout(spark):
    assert cutoffs(holdout(spark, 100, 0), spark) == {}             # too few texts to certify anything
    assert cutoffs(holdout(spark, 5000, 0), spark) == {1: at(0)}    # nothing good is lost at the strictest vector
    assert cutoffs(holdout(spark, 5000, 500), spark) == {1: at(3)}  # a tenth of the good texts has 60 symbols in 300 words


def test_cutoffs_are_tested_from_loose_to_strict(spark):
    assert op.least_holdout() == 203
    got = {n: cutoffs(holdout(spark, n, 0), spark) for n in (202, 203)}
    assert got == {202: {}, 203: {1: at(0)}}
    # 60 symbols in 300 words are above 0.1 in a sixth of the texts: that vector fails, and nothing stricter is tested
    assert cutoffs(holdout(spark, 1200, 200), spark) == {1: at(3)}


def brute_sequence(rows):
    """The certified vector of each stratum's good (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), by exact sums."""
    out = {}
    for s in range(len(op.BANDS)):
        mine = [r for r in rows if sum(r[0] >= low for low in op.BANDS[1:]) == s]
        n = len(mine)
        for step in reversed(range(7)):
            lost = 0
            for n_words, chars, symbols, dup, repeats in mine:
                values = {"symbols": symbols, "dup_lines": dup, "repeats": repeats, "long_words": chars}
                lost += any(v / n_words > op.RULES[rule][1][step] for rule, v in values.items())
            tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(op.ALPHA)
                                      + (n - j) * math.log1p(-op.ALPHA)) for j in range(lost + 1))
            if lost >= n * op.ALPHA or tail > op.DELTA / 3:
                break
            out[s] = at(step)
    return out


def test_sequence_and_verdicts_equal_brute_force(spark):
    docs, labels = read(spark, TEXTS_SF, "documents"), read(spark, TEXTS_SF, "labels")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    counts = {r.doc_id: brute(r.text) for r in docs.select("doc_id", "text").collect()}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, c in counts.items()}
    want = brute_sequence([c for i, c in counts.items() if i in good and not failed[i]])
    base = scratch(op.base_counts(docs.select("doc_id", "text")).drop("text"), "test")
    holdout = base.filter("not base_failed").join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    assert cutoffs(holdout, spark) == want and len(want) == 3      # every stratum has its cutoffs
    for r in op.quality_rules(docs, labels).collect():
        n_words, chars, symbols, dup, repeats = counts[r.doc_id]
        cut = want[sum(n_words >= low for low in op.BANDS[1:])]
        values = {"symbols": symbols, "dup_lines": dup, "repeats": repeats, "long_words": chars}
        assert r.kept == (not failed[r.doc_id] and not any(v / n_words > cut[rule] for rule, v in values.items()))


def test_query_and_edges(spark, make):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = QUERIES["op8_quality_rules"](spark, SF).collect()
    assert len(got) == docs.count() and not any(r.kept and r.base_failed for r in got)
    out = op.quality_rules(make(TEXTS), labels.limit(0)).collect()
    assert len(out) == len(TEXTS) and all(r.kept != r.base_failed for r in out)
    assert op.quality_rules(make(TEXTS).limit(0), labels).count() == 0


def test_no_python_in_the_plan(spark):
    df = QUERIES["op8_quality_rules"](spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
