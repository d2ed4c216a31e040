"""Randomised invariants: bucketed sweep = brute force, folds partition the rows,
counts add up to n, rule identities."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorum.functions.rules import combine
from quorum.operators import evaluation as E
from quorum.operators.folds import stratified_kfold

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

scores = st.one_of(st.none(), st.just(float("nan")), st.floats(min_value=-0.5, max_value=1.5),
                   st.sampled_from([i * 0.05 for i in range(21)]))


@SETTINGS
@given(st.lists(st.tuples(scores, st.integers(0, 1)), min_size=1, max_size=60),
       st.lists(st.floats(min_value=0, max_value=1), min_size=1, max_size=6, unique=True))
def test_sweep_equals_brute_force(spark, rows, grid):
    df = spark.createDataFrame([("m", s, y) for s, y in rows], "model_name string, score double, label int")
    got = {r["threshold"]: r for r in E.threshold_sweep(df, ["model_name"], grid=grid).collect()}
    for t in grid:
        pred = [int(s is not None and not math.isnan(s) and s >= t) for s, _ in rows]
        tp = sum(p and y for p, (_, y) in zip(pred, rows))
        fp = sum(p and not y for p, (_, y) in zip(pred, rows))
        r = got[t]
        assert (r["tp"], r["fp"]) == (tp, fp)
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == len(rows)


@SETTINGS
@given(st.integers(10, 120), st.integers(2, 6), st.integers(0, 10 ** 6))
def test_folds_partition_rows(spark, n, k, seed):
    df = spark.createDataFrame([(str(i), int(i % 3 == 0)) for i in range(n)], "id string, label int")
    f = stratified_kfold(df, "id", "label", k, seed).collect()
    assert sorted(r["id"] for r in f) == sorted(str(i) for i in range(n))
    for lab in (0, 1):
        sizes = [sum(1 for r in f if r["label"] == lab and r["fold"] == j) for j in range(1, k + 1)]
        assert max(sizes) - min(sizes) <= 1


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=20))
def test_rule_identities(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int, c int")
    cols = [F.col("a"), F.col("b"), F.col("c")]
    out = df.select(*[combine(op, cols).alias(op) for op in ["OR", "AND", "XOR", "NOR", "NAND", "NXOR"]]).collect()
    for r in out:
        assert r["NOR"] == 1 - r["OR"] and r["NAND"] == 1 - r["AND"] and r["NXOR"] == 1 - r["XOR"]
        assert r["AND"] <= r["OR"]


@SETTINGS
@given(st.lists(st.one_of(st.floats(min_value=-1e6, max_value=1e6), st.sampled_from([0.0, 1.0, 2.5])),
                min_size=1, max_size=300),
       st.lists(st.floats(min_value=0, max_value=1), min_size=1, max_size=4))
def test_exact_quantiles_match_sorted(spark, xs, probs):
    from quorum.operators.profile import exact_quantiles
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = exact_quantiles(df, "v", probs, limit=7, accuracy=20)
    s = sorted(xs)
    for p in probs:
        at = p * (len(s) - 1)
        lo = int(at // 1)
        hi = min(lo + 1, len(s) - 1)
        want = s[lo] if hi == lo else s[lo] + (s[hi] - s[lo]) * (at - lo)
        assert got[p] == want
