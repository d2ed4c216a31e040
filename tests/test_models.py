"""Model registry and training paths for every registered model kind."""

import pytest
from pyspark.sql import functions as F

from quorum.config import EvalConfig
from quorum.operators import models as ML
from quorum.operators.folds import stratified_kfold


@pytest.fixture(scope="module")
def data(spark):
    rows = [(str(i), int(i % 4 == 0), float(i % 4 == 0) * 2 + (i % 7) / 7.0, float(i % 5)) for i in range(400)]
    return spark.createDataFrame(rows, "id string, label int, a double, b double")


def test_registry_M1():
    cfg = {"models": {"enabled": ["XGBoost", "RandomForest", "Unknown"]},
           "model_params": {"XGBoost": {"n_estimators": 5, "max_depth": 3}}, "data": {"random_state": 7}}
    specs = ML.create_models(cfg)
    assert list(specs) == ["XGBoost", "RandomForest"] and specs["XGBoost"].params["n_estimators"] == 5
    assert specs["RandomForest"].seed == 7


@pytest.mark.parametrize("name,params", [
    ("XGBoost", {"n_estimators": 5, "max_depth": 3}), ("RandomForest", {"n_estimators": 5, "max_depth": 3}),
    ("LogisticRegression", {"max_iter": 20}), ("SVM", {"max_iter": 20}), ("MLP", {"max_iter": 30}),
    ("KNN", {"n_neighbors": 3})])
def test_train_and_score_each_model(spark, data, name, params):
    spec = ML.ModelSpec(name, params, 1)
    tr, te = data.filter("cast(id as int) % 5 <> 0"), data.filter("cast(id as int) % 5 = 0")
    out = ML.train_and_score(spec, tr, {"Test": te}, ["a", "b"], "id")["Test"].collect()
    assert len(out) == te.count()
    assert all(r["score"] is not None and 0.0 <= r["score"] <= 1.0 for r in out)
    pos = [r["score"] for r in out if r["label"] == 1]
    neg = [r["score"] for r in out if r["label"] == 0]
    assert sum(pos) / len(pos) > sum(neg) / len(neg)  # separable feature a


def test_smote_training_path(spark, data):
    spec = ML.ModelSpec("LogisticRegression", {"max_iter": 20}, 1)
    tr = data.filter("cast(id as int) % 5 <> 0")
    bal = ML.oversample(tr, ["a", "b"], "id", 0.5, 42)
    n0 = tr.filter("label = 0").count()
    assert bal.filter("label = 1").count() == int(0.5 * n0)
    out = ML.train_and_score(spec, tr, {"t": tr}, ["a", "b"], "id", use_smote=True)["t"]
    assert out.count() == tr.count()


def test_class_weights_M4(spark, data):
    w = {r["label"]: r["weight"] for r in ML.class_weights(data).select("label", "weight").distinct().collect()}
    assert w[1] == pytest.approx(400 / (2 * 100)) and w[0] == pytest.approx(400 / (2 * 300))
    fixed = {r["label"]: r["weight"] for r in ML.class_weights(data, positive_weight=62.5).select(
        "label", "weight").distinct().collect()}
    assert fixed == {0: 1.0, 1: 62.5}


def test_cv_final_and_batch_predict(spark, data, tmp_path):
    cfg = EvalConfig(n_splits=3)
    folded = stratified_kfold(data, "id", "label", 3, 42)
    spec = ML.ModelSpec("LogisticRegression", {"max_iter": 20}, 1)
    cv = ML.cv_evaluate(folded, {"LR": spec}, ["a", "b"], cfg, "id")
    res = {r["threshold_type"]: r for r in cv["results"].collect()}
    assert set(res) == {"cost", "accuracy"} and res["cost"]["tp"] + res["cost"]["fn"] == 100
    assert cv["predictions"].count() == 400
    path = str(tmp_path / "m")
    model, final = ML.final_model(spec, data, ["a", "b"], cfg, "id", path)
    assert final.count() == 2
    pred = ML.batch_predict(path, data.select("id", "a", "b"))
    assert pred.count() == 400 and set(pred.columns) >= {"prediction", "score"}
    with pytest.raises(ValueError):
        ML.batch_predict(str(tmp_path / "missing"), data)


def test_depth_and_strength(spark, data):
    assert ML.build_estimator(ML.ModelSpec("RandomForest", {"max_depth": None}), 2).getMaxDepth() == 30
    with pytest.raises(ML.InvalidParameter):
        ML.build_estimator(ML.ModelSpec("XGBoost", {"max_depth": 50}), 2)
    for name in ("LogisticRegression", "SVM"):
        est = ML.build_estimator(ML.ModelSpec(name, {"C": 0.5}), 2, n_rows=200)
        assert est.getRegParam() == pytest.approx(0.01)
    easy = ML.score(ML.fit(ML.ModelSpec("LogisticRegression", {"C": 1.0}), data, ["a", "b"]), data)
    low, high = easy.selectExpr("min(score)", "max(score)").first()
    assert low < 0.1 and high > 0.9


def test_class_weights_reach_the_fit(spark, data):
    mixed = data.withColumn("c", data["b"])  # c says nothing about the label
    def mean(params):
        out = ML.train_and_score(ML.ModelSpec("XGBoost", {"n_estimators": 2, "max_depth": 2, "learning_rate": 1.0, **params}), mixed,
                                 {"t": mixed}, ["c"], "id")
        return out["t"].selectExpr("avg(score)").first()[0]
    assert mean({"scale_pos_weight": 62.5}) > mean({}) + 0.2


@pytest.mark.parametrize("name", ["SVM", "KNN", "LogisticRegression"])
def test_stored_models_score_alike(spark, data, tmp_path, name):
    cfg = EvalConfig(n_splits=3)
    path = str(tmp_path / name)
    model, final = ML.final_model(ML.ModelSpec(name, {}, 1), data, ["a", "b"], cfg, "id", path)
    assert final.count() == 2
    want = {r["id"]: r["score"] for r in ML.score(model, data).select("id", "score").collect()}
    got = {r["id"]: r["score"] for r in ML.batch_predict(path, data.select("id", "a", "b")).collect()}
    assert got == want


def test_search_fails_loudly(spark, data):
    folded = stratified_kfold(data, "id", "label", 2, 42)
    best, trials = ML.hyperparam_search(ML.ModelSpec("SVM", {"max_iter": 10}), folded, ["a", "b"], {"C": [0.1, 1.0]}, n_folds=2)
    assert all(r["neg_log_loss"] > -1 for r in trials.collect()) and best.params["C"] in (0.1, 1.0)
    with pytest.raises(ML.InvalidParameter):
        ML.hyperparam_search(ML.ModelSpec("RandomForest"), folded, ["a", "b"], {"max_depth": [40, 50]}, n_folds=2)
    with pytest.raises(Exception, match="nope"):
        ML.hyperparam_search(ML.ModelSpec("SVM"), folded, ["nope"], {"C": [1.0]}, n_folds=2)


def test_contract_names_types_and_order(spark, data):
    from quorum.sources.tables import contract_problems, feature_contract
    contract = feature_contract(data, ["a", "b"], id_col="id")
    assert contract_problems(contract, data) == []
    assert contract_problems(contract, data.select("b", "a")) == ["the order is ['b', 'a']"]
    assert contract_problems(contract, data.selectExpr("cast(a as float) a")) == ["b is missing", "a is float, not double"]


def test_search_space_M5():
    spaces = {"shared": {"max_iter": [10, 20]}, "LogisticRegression": {"C": (0.1, 10.0), "max_iter": [30]}}
    sp = ML.resolve_space(spaces, "LogisticRegression")
    assert sp == {"max_iter": [30], "C": (0.1, 10.0)}
    t1 = ML.sample_trials(sp, 5, 42)
    assert t1 == ML.sample_trials(sp, 5, 42) and len(t1) == 5
    assert all(0.1 <= t["C"] <= 10.0 and t["max_iter"] == 30 for t in t1)
    grid = ML.sample_trials({"a": [1, 2], "b": [3]}, 10, 1)
    assert sorted(g["a"] for g in grid) == [1, 2]
    with pytest.raises(ValueError):
        ML.sample_trials({"a": (1, 2, 3)}, 2, 1)


def test_average_fold_sweep_fallback_A6(spark):
    from quorum.operators.evaluation import average_fold_sweep
    sweep = spark.createDataFrame(
        [("m", 0.5, 1, 2, 3, 4, 10.0, 50.0, 40.0, 30.0, 20.0), ("m", 0.5, None, 2, 3, 4, 20.0, 60.0, 50.0, 40.0, 30.0)],
        "model_name string, threshold double, tp long, fp long, tn long, fn long, cost double, accuracy double, "
        "precision double, recall double, f1_score double")
    r = average_fold_sweep(sweep).collect()[0]
    assert r["cost"] == 15.0 and r["accuracy"] == 55.0 and r["tp"] == 1.0  # averaged, not summed


def test_cv_with_per_fold_search(spark, data):
    cfg = EvalConfig(n_splits=2)
    folded = stratified_kfold(data, "id", "label", 2, 42)
    spec = ML.ModelSpec("LogisticRegression", {"max_iter": 10}, 1)
    cv = ML.cv_evaluate(folded, {"LogisticRegression": spec}, ["a", "b"], cfg, "id",
                        search={"spaces": {"LogisticRegression": {"C": [1.0, 10.0]}}, "n_trials": 2, "inner_folds": 2})
    assert cv["results"].count() == 2


def test_cv_oversamples_each_fold_once(spark, data, monkeypatch):
    calls, oversample = [], ML.oversample
    monkeypatch.setattr(ML, "oversample", lambda *a: calls.append(a) or oversample(*a))
    specs = {n: ML.ModelSpec(n, p, 1) for n, p in (("LogisticRegression", {"max_iter": 5}), ("RandomForest", {"n_estimators": 2, "max_depth": 2}))}
    out = ML.cv_evaluate(stratified_kfold(data, "id", "label", 2, 42), specs, ["a", "b"], EvalConfig(n_splits=2), use_smote=True)
    assert len(calls) == 2 and out["predictions"].count() == 2 * data.count()
    assert {r[0] for r in out["results"].select(F.expr("tp + fp + tn + fn")).collect()} == {data.count()}


def test_cv_assembles_vectors_once(spark, data, monkeypatch):
    """Every fit and every scoring assembled the vectors again at each reading of its rows."""
    folded = stratified_kfold(data, "id", "label", 2, 42)
    specs = {"LogisticRegression": ML.ModelSpec("LogisticRegression", {"max_iter": 20}, 1),
             "RandomForest": ML.ModelSpec("RandomForest", {"n_estimators": 3, "max_depth": 3, "bootstrap": False}, 1),
             "Bagged": ML.ModelSpec("RandomForest", {"n_estimators": 3, "max_depth": 3, "oob_score": True}, 1)}
    stages, fit = [], ML.fit

    def seen(spec, *args):
        model = fit(spec, *args)
        stages.extend(type(s).__name__ for s in getattr(model, "stages", []))
        return model

    monkeypatch.setattr(ML, "fit", seen)
    got = {(r.model_name, r.id): r.score for r in ML.cv_evaluate(folded, specs, ["a", "b"], EvalConfig(n_splits=2), "id")["predictions"].collect()}
    assert len(stages) == 4 and "VectorAssembler" not in stages and len(got) == 3 * 400
    monkeypatch.undo()
    for name in ("LogisticRegression", "RandomForest"):
        for k in (1, 2):
            plain = ML.train_and_score(specs[name], folded.filter(F.col("fold") != k), {"t": folded.filter(F.col("fold") == k)}, ["a", "b"], "id")
            for r in plain["t"].collect():
                assert got[f"kfold_avg_{name}", r.id] == pytest.approx(r.score, nan_ok=True)
    knn = ML.cv_evaluate(folded, {"KNN": ML.ModelSpec("KNN", {"n_neighbors": 3}, 1)}, ["a", "b"], EvalConfig(n_splits=2), "id")
    assert knn["predictions"].count() == 400


@pytest.mark.parametrize("ids", [400, 150])
def test_knn_votes_are_those_of_a_join_by_id_F2(spark, data, ids):
    """Labels go along with the neighbours instead of a join of every neighbour; ids may repeat or be missing."""
    from quorum.operators.neighbours import knn_join
    rows = data.withColumn("id", F.when(F.col("a") < 2.9, (F.col("id").cast("int") % ids).cast("string")))
    vec = rows.select("id", F.array("a", "b").alias("v"))
    nn = knn_join(vec, vec, 3, "id", "v")
    want = {r[0]: r[1] for r in nn.join(rows.select(F.col("id").alias("rid"), "label"), "rid").groupBy("qid").agg(F.avg("label")).collect()}
    got = ML.knn_scores(rows, rows, ["a", "b"], 3)
    assert got.columns == [*rows.columns, "score"] and got.count() == 400
    for r in got.collect():
        assert r["score"] == (pytest.approx(want[r["id"]]) if r["id"] is not None else None)
