"""Sweep, best threshold, metrics and curves against brute force (FIXTURES E1-E5, F10, F11)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.config import Costs, default_grid
from quorum.functions import metrics as M
from quorum.operators import curves as C
from quorum.operators import evaluation as E
from quorum.operators import report as RP


def brute_sweep(scores, labels, grid, costs=Costs()):
    out = {}
    for t in grid:
        pred = [1 if (s is not None and not (isinstance(s, float) and math.isnan(s)) and s >= t) else 0
                for s in scores]
        tp = sum(1 for p, y in zip(pred, labels) if p == 1 and y == 1)
        fp = sum(1 for p, y in zip(pred, labels) if p == 1 and y == 0)
        tn = sum(1 for p, y in zip(pred, labels) if p == 0 and y == 0)
        fn = sum(1 for p, y in zip(pred, labels) if p == 0 and y == 1)
        out[t] = (tp, fp, tn, fn, costs.c_fp * fp + costs.c_fn * fn)
    return out


def sweep_rows(spark, scores, labels, grid=None):
    df = spark.createDataFrame([("m", float(s) if s is not None else None, y) for s, y in zip(scores, labels)],
                               "model_name string, score double, label int")
    rows = E.threshold_sweep(df, ["model_name"], grid=grid).collect()
    return {r["threshold"]: r for r in rows}


def test_grid_is_linspace_bits():
    g = default_grid()
    assert np.array_equal(np.array(g), np.linspace(0, 1, 21))
    assert g[3] == 0.15000000000000002 and g[6] == 0.30000000000000004


def test_grid_boundary_E1(spark):
    scores = [0.05, 0.15, 0.3, 0.35, 0.6, 0.7, 1.0]
    labels = [0, 1, 0, 1, 1, 0, 1]
    got = sweep_rows(spark, scores, labels)
    want = brute_sweep(scores, labels, default_grid())
    for t, (tp, fp, tn, fn, cost) in want.items():
        r = got[t]
        assert (r["tp"], r["fp"], r["tn"], r["fn"], r["cost"]) == (tp, fp, tn, fn, cost)
    # 0.15 sits below the step 0.15000000000000002, so at that threshold it predicts 0
    assert got[default_grid()[3]]["tp"] == 3


def test_missing_scores_E2(spark):
    got = sweep_rows(spark, [None, float("nan"), 0.9], [1, 1, 1])
    for t, r in got.items():
        assert r["tp"] <= 1 and r["fn"] >= 2  # NULL and NaN never predict 1, even at 0.0


def test_one_class_E3(spark):
    got = sweep_rows(spark, [0.0, 0.0, 0.0], [0, 0, 0])
    r = got[0.5]
    assert (r["tn"], r["precision"], r["recall"], r["f1_score"], r["accuracy"]) == (3, 0.0, 0.0, 0.0, 100.0)


def test_ties_pick_lowest_threshold_E4(spark):
    df = spark.createDataFrame([("m", 0.0, 1), ("m", 0.0, 0)], "model_name string, score double, label int")
    sweep = E.threshold_sweep(df, ["model_name"])
    best = {r["threshold_type"]: r for r in E.best_thresholds(sweep, ["model_name"]).collect()}
    assert best["cost"]["threshold"] == 0.0
    assert best["accuracy"]["threshold"] == 0.0


def test_no_positive_predictions_E5(spark):
    got = sweep_rows(spark, [0.0, 0.0, 0.0, 0.0], [1, 0, 1, 0])
    r = got[0.5]
    assert r["precision"] == 0.0 and r["f1_score"] == 0.0


def test_random_sweep_matches_brute_force(spark):
    rng = random.Random(7)
    scores = [rng.random() if rng.random() > 0.05 else None for _ in range(500)]
    scores += [0.05 * rng.randint(0, 20) for _ in range(200)]  # exact grid hits
    labels = [rng.randint(0, 1) for _ in scores]
    grid = [0.0, 0.1, 0.25, 0.33, 0.5, 0.9, 1.0]
    got = sweep_rows(spark, scores, labels, grid)
    for t, (tp, fp, tn, fn, cost) in brute_sweep(scores, labels, grid).items():
        r = got[t]
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (tp, fp, tn, fn)


def test_average_fold_results_sums_counts(spark):
    best = spark.createDataFrame(
        [("m", 1, "cost", 0.3, 1.0, 5, 1, 3, 0), ("m", 2, "cost", 0.35, 2.0, 4, 2, 2, 0)],
        "model_name string, fold int, threshold_type string, threshold double, cost double, tp long, fp long, "
        "tn long, fn long")
    r = E.average_fold_results(best, Costs()).collect()[0]
    assert r["model_name"] == "kfold_avg_m" and (r["tp"], r["fp"], r["tn"], r["fn"]) == (9, 3, 5, 0)
    assert r["threshold"] == (0.0 + 0.3 + 0.35) / 2 and r["cost"] == 3.0
    assert r["precision"] == 100 * 9 / 12


def test_stored_run_golden_F16(spark):
    # AD_Decision / CL_Decision of the stored run: counts -> metrics with C_FP=1, C_FN=30, 5 splits
    counts = spark.createDataFrame([("AD_Decision", 35, 1648, 726, 3), ("CL_Decision", 24, 317, 2057, 14)],
                                   "model_name string, tp long, fp long, tn long, fn long")
    rows = {r["model_name"]: r for r in E.decision_results(counts, Costs(1.0, 30.0), 5, "base").collect()}
    ad, cl = rows["AD_Decision"], rows["CL_Decision"]
    assert ad["cost"] == pytest.approx(347.6) and cl["cost"] == pytest.approx(147.4)
    assert round(ad["accuracy"], 3) == 31.551 and round(ad["recall"], 3) == 92.105
    assert round(cl["precision"], 3) == 7.038 and round(cl["f1_score"], 3) == 12.665


def test_curves_F10(spark):
    df = spark.createDataFrame([("m", 0.1, 0), ("m", 0.4, 0), ("m", 0.35, 1), ("m", 0.8, 1)],
                               "model_name string, score double, label int")
    assert C.roc_auc(df).collect()[0]["roc_auc"] == pytest.approx(0.75)
    assert C.pr_auc(df).collect()[0]["pr_auc"] == pytest.approx(0.7916667, abs=1e-7)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    v = df.select(array_to_vector(F.array(F.lit(1.0) - F.col("score"), F.col("score"))).alias("rawPrediction"),
                  F.col("label").cast("double").alias("label"))
    ev = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
    assert ev.evaluate(v) == pytest.approx(0.75)


def test_suffix_totals_many_buckets(spark):
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", round(rng.random(), 4), rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, v long").groupBy("g", "s").agg(F.sum("v").alias("v"))
    got = {(r["g"], r["s"]): r["cum_v"] for r in C.suffix_totals(df, ["g"], "s", ["v"], range_rows=200).collect()}
    agg = {}
    for g, s, v in rows:
        agg[(g, s)] = agg.get((g, s), 0) + v
    for (g, s), _ in agg.items():
        want = sum(v for (g2, s2), v in agg.items() if g2 == g and s2 >= s)
        assert got[(g, s)] == want


def test_confusion_layout_F11(spark):
    res = spark.createDataFrame([("m", "Full", "cost", 10, 5, 15, 3)],
                                "model_name string, split string, threshold_type string, tp long, fp long, tn long, "
                                "fn long")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in RP.confusion_layout(res).collect()}
    assert cells == {(0, 0): 15, (0, 1): 5, (1, 0): 3, (1, 1): 10}


def test_apply_threshold_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.5,)], "s double")
    assert [r[0] for r in df.select(M.apply_threshold("s", 0.0)).collect()] == [0, 0, 1]


def test_reduced_roc_curve_equals_brute_force(spark):
    import random

    from quorum.operators import curves
    rng = random.Random(5)
    rows = [(m, s / 64, int(rng.random() < (0.1 if s < 30 else 0.9 if s > 50 else 0.5)))
            for m in ("a", "b") for s in range(64) for _ in range(rng.choice([1, 1, 1, 2]))]
    rows += [("c", i / 100, 1) for i in range(40)] + [("one", 0.5, 1), ("gap", float("nan"), 1), ("gap", 0.2, 0)]
    long = spark.createDataFrame(rows, "model_name string, score double, label int")
    want = set()
    for m in {r[0] for r in rows}:
        steps = {}
        for _, s, y in (r for r in rows if r[0] == m and r[1] == r[1]):
            pos, neg = steps.get(s, (0, 0))
            steps[s] = (pos + y, neg + 1 - y)
        order = sorted(steps, reverse=True)
        want |= {(m, s) for i, s in enumerate(order) if i in (0, len(order) - 1) or steps[s] != steps[order[i + 1]]} | {(m, None)}
    full = {(r.model_name, r.score): (r.fpr, r.tpr) for r in curves.roc_curve(long).collect()}
    for size in (5, 100_000):       # many ranges, so that borders cut straight lines, and one
        got = {(r.model_name, r.score): (r.fpr, r.tpr) for r in curves.roc_curve_reduced(long, range_rows=size).collect()}
        assert set(got) == want and all(full[k] == v for k, v in got.items()) and len(want) < len(full)
        areas = []
        for points in (full, got):
            pts = sorted(v for (m, _), v in points.items() if m == "a")
            areas.append(sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(pts, pts[1:])))
        assert abs(areas[0] - areas[1]) < 1e-12


def test_positional_mean_of_rows_ranked_before_the_unpivot(spark):
    rows = [(f"r{i}", 1 + i % 3, i / 10, None if i % 7 == 0 else float("nan") if i % 5 == 0 else -i / 3) for i in range(100)]
    wide = spark.createDataFrame(rows, "id string, fold int, a double, b double")
    unpivot = lambda d: d.unpivot([c for c in d.columns if c not in ("a", "b")], ["a", "b"], "model_name", "score")
    ranked = E.fold_positions(wide, "id", 42)
    assert {(r["fold"], r["position"]) for r in ranked.collect()} == {(f, p) for f in (1, 2, 3) for p in range(1, 34 + (f == 1))}
    got, want = (sorted(map(tuple, E.positional_mean(d, "id", 42).collect())) for d in (unpivot(ranked), unpivot(wide)))
    assert got == want and len(got) == 2 * 33
