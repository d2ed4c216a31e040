"""Report operators on the reference's fixtures."""

import pytest
from pyspark.sql import functions as F

from quorum.operators import report as RP

RES_SCHEMA = ("model_name string, split string, threshold_type string, threshold double, precision double, "
              "recall double, f1_score double, accuracy double, cost double, tp long, fp long, tn long, fn long, "
              "is_base_model boolean")


def _f8(spark):
    return spark.createDataFrame([
        ("Model1", "Test", "cost", .5, .85, .75, None, .80, 8.0, 15, 3, 12, 5, False),
        ("Model2", "Test", "cost", .6, .82, .78, None, .79, 9.0, 14, 4, 11, 6, False),
        ("Base1", "Test", "base", None, None, .5, .5, .7, 3.0, 1, 2, 3, 4, True),
    ], RES_SCHEMA)


def test_model_comparison_F8_E14(spark):
    rows = {r["model_name"]: r for r in RP.model_comparison(_f8(spark), "cost", "test").collect()}
    assert set(rows) == {"Model1", "Model2", "Base1"}
    assert rows["Model1"]["f1_score"] == 0.0 and rows["Model1"]["threshold"] == 0.5
    assert rows["Base1"]["threshold"] is None and rows["Base1"]["precision"] == 0.0  # fallback, NULL -> 0.0
    with pytest.raises(ValueError):
        RP.model_comparison(_f8(spark), "invalid", "Test")
    assert RP.model_comparison(_f8(spark), "cost", "NonExistent").count() == 0
    with pytest.raises(RuntimeError, match="No results"):
        RP.model_comparison(_f8(spark), "cost", "NonExistent", strict=True)
    with pytest.raises(ValueError, match="Available splits"):
        RP.filter_results(_f8(spark), "Train", strict=True)
    assert RP.filter_results(_f8(spark), "Test", "cost", ["Model1"], strict=True).count() == 1


def test_sweep_series_F7(spark):
    sweep = spark.createDataFrame(
        [("m", .3, .8, .7, 0.0, .75, 10.0, 1, 1), ("m", .5, .85, .65, 0.0, .80, 8.0, 1, 2),
         ("m", .7, .9, .6, 0.0, .78, 12.0, 1, 1)],
        "model_name string, threshold double, precision double, recall double, f1_score double, accuracy double, "
        "cost double, tp long, tn long")
    r = RP.sweep_series(sweep).collect()[0]
    assert r["threshold"] == [.3, .5, .7] and r["cost"] == [10.0, 8.0, 12.0]
    assert r["cost_optimal_threshold"] == .5 and r["accuracy_optimal_threshold"] == .5
    assert RP.sweep_series(sweep.limit(0)).count() == 0


def test_sweep_projection_F12(spark):
    sweep = spark.createDataFrame([("XGBoost", .1, 10.0, .7), ("XGBoost", .5, 5.0, .85), ("XGBoost", .9, 8.0, .75)],
                                  "model_name string, threshold double, cost double, accuracy double")
    r = RP.sweep_projection(sweep, "costs").collect()[0]
    assert r["thresholds"] == [.1, .5, .9] and r["values"] == [10.0, 5.0, 8.0]
    with pytest.raises(ValueError):
        RP.sweep_projection(sweep, "nope")


def test_display_label_and_melt(spark):
    res = _f8(spark)
    labels = {r["model_name"]: r["label"] for r in RP.with_display_label(res).collect()}
    assert labels == {"Model1": "Model1 (τ=0.50)", "Model2": "Model2 (τ=0.60)", "Base1": "Base1"}
    assert RP.melt_metrics(res).count() == 12


def test_importance_tables(spark):
    a = spark.createDataFrame([("f1", .5, 0), ("f2", .3, 1), ("f3", 0.0, 2)], "feature string, importance double, "
                                                                            "position int")
    b = spark.createDataFrame([("f2", .6, 0), ("f4", .1, 1)], "feature string, importance double, position int")
    ranks = {r["feature"]: r["rank"] for r in RP.importance_rank(a).collect()}
    assert ranks == {"f1": 1, "f2": 2, "f3": 3}
    outer = {r["feature"]: (r["a"], r["b"]) for r in RP.importance_outer({"a": a, "b": b}).collect()}
    assert outer["f4"] == (0.0, .1) and outer["f1"] == (.5, 0.0)
    top = RP.topk_features({"a": a, "b": b}, 3).orderBy("rank").collect()
    assert [r["b"] for r in top] == ["f2", "f4", "N/A"]
    diff = RP.importance_diff({"a": a, "b": b}).collect()
    assert diff[0]["feature"] == "f1"


def test_pick_sweep_split(spark):
    sweep = spark.createDataFrame(
        [("a", "oof", .5, 1.0), ("a", "Full", .5, 2.0), ("b", "oof", .5, 3.0), ("c", "Train", .5, 4.0),
         ("c", "Test", .5, 5.0)], "model_name string, split string, threshold double, cost double")
    got = {r["model_name"]: r["split"] for r in RP.pick_sweep_split(sweep).collect()}
    assert got == {"a": "Full", "b": "oof", "c": "Test"}


def test_store_summary_collects_names_from_counted_rows(spark):
    from quorum.operators.report import store_summary
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "model_name string")
    out = store_summary({"some": rows, "none": rows.limit(0), "nameless": rows.filter("model_name IS NULL")})
    assert {r["dataset"]: (r["rows"], r["models"]) for r in out.collect()} == {
        "some": (4, ["a", "b"]), "none": (0, []), "nameless": (1, [])}
    plan = store_summary({"some": rows})._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [model_name" in plan  # not a set collected from every row


def test_results_rank_the_rows_once(spark):
    """The k-fold averages and the fold bests read one written sweep: no plan of theirs ranks rows again."""
    from tests.conftest import SF0001
    from quorum.plans.catalog import all_results
    results = all_results(spark, SF0001)
    assert "md5(" not in results._jdf.queryExecution().optimizedPlan().toString()
    assert results.filter("split LIKE 'Fold%'").count() == 30


def test_end_to_end_ranks_the_rows_once_for_models_and_score_columns(spark, monkeypatch):
    from quorum.config import EvalConfig
    from quorum.operators.models import ModelSpec
    from quorum.plans import flows
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "Bad").otherwise("Good").alias("t"),
                                 (F.col("id") % 10 / 10).alias("s"), (F.col("id") % 7).cast("double").alias("x"))
    ranked, kfold = [], flows.stratified_kfold
    monkeypatch.setattr(flows, "stratified_kfold", lambda *a, **k: ranked.append(1) or kfold(*a, **k))
    cfg, spec = EvalConfig(n_splits=2), {"LogisticRegression": ModelSpec("LogisticRegression", {"max_iter": 5})}
    out = flows.run_end_to_end(df, cfg, "id", "t", spec, score_cols=["s"])
    assert len(ranked) == 1
    order = ["model_name", "threshold_type"]
    alone = flows.score_column_eval(df, cfg, "id", "t", ["s"])["results"].orderBy(order)
    mine = out["results"].filter("model_name = 'kfold_avg_s'").select(alone.columns).orderBy(order)
    assert mine.collect() == alone.collect()
    assert len(ranked) == 2
