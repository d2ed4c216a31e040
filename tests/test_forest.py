"""Forests over explicit bags: weights of each bag, out-of-bag scores, storing (M1, M4)."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.operators import forest as FO
from quorum.operators import models as ML

SPEC = ML.ModelSpec("RandomForest", {"n_estimators": 12, "max_depth": 4, "class_weight": "balanced_subsample", "oob_score": True}, 3)


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(0)
    y = (rnd.random(1500) < 0.1).astype(int)
    rows = [(str(i), int(k), float(rnd.normal(1.5 * k)), float(rnd.normal(k)), float(rnd.normal())) for i, k in enumerate(y)]
    return spark.createDataFrame(rows, "id string, label int, a double, b double, c double").cache()


@pytest.fixture(scope="module")
def forest(data):
    return ML.fit(SPEC, data, ["a", "b", "c"])


def brute_count(i, tree, seed):
    h = int(hashlib.md5(f"{i}:{seed}:{tree}".encode()).hexdigest()[:13], 16) / 16 ** 13
    n, chance = 0, np.exp(-1)
    while h >= chance:
        h -= chance
        n += 1
        chance = np.exp(-1) / np.prod(np.arange(1, n + 1))
    return n


def auc(pairs):
    good, bad = ([s for k, s in pairs if k == want] for want in (0, 1))
    return np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])


def test_bags_and_their_weights(data):
    rows = [(r.id, r.label) for r in data.select("id", "label").collect()]
    got = {(r.tree, r.label): (r.n_bag, r.weight) for r in FO.bag_weights(data, 4, 3).collect()}
    for t in range(4):
        n = {k: sum(brute_count(i, t, 3) for i, label in rows if label == k) for k in (0, 1)}
        for k in (0, 1):
            assert got[t, k] == (n[k], pytest.approx((n[0] + n[1]) / (2 * n[k])))
    assert len({w for (_, k), (_, w) in got.items() if k == 1}) == 4  # each bag has its own


def test_out_of_bag(data, forest):
    got = {r.id: r for r in forest.out_of_bag(data).collect()}
    for i, r in got.items():
        assert r.n_out == sum(brute_count(i, t, 3) == 0 for t in range(12))
        assert (r.oob_score is None) == (r.n_out == 0)
    held = auc([(r.label, r.oob_score) for r in got.values() if r.n_out])
    fitted = auc([(r.label, r.score) for r in ML.score(forest, data).collect()])
    assert 0.85 < held < fitted  # rows that a tree was fitted on flatter it
    assert FO.oob_accuracy(forest.out_of_bag(data)) > 0.75


def test_one_trees_votes(data, forest):
    one = FO.BaggedForest(forest.trees[:1], forest.features, 3)
    alone = {r.id: r.score for r in one.transform(data).collect()}
    for r in one.out_of_bag(data).collect():
        assert r.oob_score == (alone[r.id] if brute_count(r.id, 0, 3) == 0 else None)


def test_weights_change_the_trees(spark, data):
    plain = ML.fit(ML.ModelSpec("RandomForest", {**SPEC.params, "class_weight": None}, 3), data, ["a", "b", "c"])
    mean = lambda m: np.mean([r.score for r in ML.score(m, data).collect()])
    assert mean(ML.fit(SPEC, data, ["a", "b", "c"])) > mean(plain) + 0.1


def test_store_and_importances(spark, data, forest, tmp_path):
    path = str(tmp_path / "forest")
    ML.save_model(forest, path)
    scores = lambda m: sorted((r.id, r.score, r.prediction) for r in ML.score(m, data).collect())
    assert scores(ML.load_model(spark, path)) == scores(forest)
    assert forest.featureImportances.sum() == pytest.approx(1) and forest.featureImportances.argmax() == 0
    assert ML.batch_predict(path, data.drop("label")).columns == ["id", "a", "b", "c", "prediction", "score"]


def test_parameters(spark, data):
    assert ML.positive_weight_of(SPEC) is None and ML.is_bagged(SPEC)
    whole = ML.ModelSpec("RandomForest", {"class_weight": "balanced_subsample", "bootstrap": False})
    assert ML.positive_weight_of(whole) == "balanced" and not ML.is_bagged(whole)
    with pytest.raises(ML.InvalidParameter):
        ML.positive_weight_of(ML.ModelSpec("RandomForest", {"class_weight": "balance"}))
    with pytest.raises(ValueError):
        ML.fit(SPEC, data.limit(0), ["a", "b", "c"])
    few = ML.fit(SPEC, data.filter("label = 0").limit(3), ["a"])  # one class, and some bags are empty
    assert {r.score for r in ML.score(few, data).collect()} == {0.0}
    two = ML.train_and_score(SPEC, data, {"t": data}, ["a", "b"], positive_weight=5.0)["t"]
    assert two.filter("score between 0 and 1").count() == 1500


def test_rows_of_a_bag_take_one_hash(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(3000)] + [(None,)], "id string")
    for t in (0, 3):
        both = ids.select(F.col("id"), FO.in_bag("id", t, 42).alias("is_in"), FO.bag_count("id", t, 42).alias("n")).collect()
        assert all(r.is_in == (r.n > 0) for r in both) and 0.6 < sum(r.is_in for r in both) / len(both) < 0.66
        # how often a row is in a bag is what the hash says as a number
        key = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce("id", F.lit("")), F.lit(f"42:{t}"))), 1, FO.HASH_HEX), 16, 10).cast("long")
        want = {r.id: sum(r.h >= c for c in FO.bag_cuts()) for r in ids.select("id", key.alias("h")).collect()}
        assert {r.id: r.n for r in both} == want
    plan = ids.filter(FO.in_bag("id", 0, 42))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
