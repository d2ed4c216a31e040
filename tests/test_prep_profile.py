"""Preparation and profiling operators on the reference's own fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.operators import folds as W
from quorum.operators import prep as PR
from quorum.operators import profile as P


def test_prepare_F1(spark):
    df = spark.createDataFrame(
        [(1, .1, "A", "Good", "img1.jpg", 1), (2, .2, "B", "Bad", "img2.jpg", 2), (3, .3, "A", "Good", "img3.jpg", 3),
         (4, .4, "B", "Bad", "img4.jpg", 4), (5, .5, "A", "Good", "img5.jpg", 5)],
        "feature1 long, feature2 double, categorical string, GT_Label string, Image string, ID long")
    lab = PR.encode_target(df, "GT_Label", "Good", "Bad")
    assert [r[0] for r in lab.orderBy("ID").select("label").collect()] == [0, 1, 0, 1, 0]
    x = PR.project_features(lab.drop("label"), "GT_Label", ["Image", "ID", "absent"])
    enc, dummies = PR.one_hot_drop_first(x)
    assert enc.columns == ["feature1", "feature2", "categorical_B"] and dummies == ["categorical_B"]


def test_unmapped_target_F2(spark):
    df = spark.createDataFrame([("Invalid",), ("Good",)], "GT_Label string")
    with pytest.raises(Exception, match="Found unmapped values"):
        PR.encode_target(df, "GT_Label", "Good", "Bad").collect()


def test_variance_F3(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 1, 2), (5, 1, 2)],
                               "high_var long, low_var long, medium_var long")
    rep = PR.variance_filter(df, df.columns, 0.1)
    assert PR.kept_features(rep, df.columns) == ["high_var", "medium_var"]


def test_correlation_F4(spark):
    df = spark.createDataFrame([(1., 1.1, 5.), (2., 2.1, 4.), (3., 3.1, 3.), (4., 4.1, 2.), (5., 5.1, 1.)],
                               "feature1 double, feature2 double, feature3 double")
    rep = {r["feature"]: r["kept"] for r in PR.correlation_filter(df, df.columns, 0.9).collect()}
    assert rep == {"feature1": True, "feature2": False, "feature3": False}


def test_correlation_constant_and_nulls_E8(spark):
    df = spark.createDataFrame([(1.0, 7.0, None), (2.0, 7.0, None), (3.0, 7.0, 1.0)], "a double, c double, n double")
    rep = {r["feature"]: (r["kept"], r["max_abs_corr_earlier"]) for r in PR.correlation_filter(df, df.columns).collect()}
    assert rep["c"] == (True, None) and rep["n"][0] is True
    const = {r["column_name"]: r["is_constant"] for r in P.constant_columns(df).collect()}
    assert const == {"a": False, "c": True, "n": True}


def test_split_F5(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "id long, label int")
    s = W.stratified_split(df, "id", "label", 0.2, 42)
    counts = {(r["split"], r["label"]): r["count"] for r in s.groupBy("split", "label").count().collect()}
    assert counts == {("Test", 0): 10, ("Test", 1): 10, ("Train", 0): 40, ("Train", 1): 40}


def test_folds_F6_E12(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "id long, label int")
    f = W.stratified_kfold(df, "id", "label", 5, 42)
    per = {(r["fold"], r["label"]): r["count"] for r in f.groupBy("fold", "label").count().collect()}
    assert all(v == 5 for v in per.values()) and len(per) == 10
    assert f.select("id").distinct().count() == 50
    odd = spark.createDataFrame([(i, int(i < 4)) for i in range(11)], "id long, label int")
    sizes = [r["count"] for r in W.stratified_kfold(odd, "id", "label", 5).groupBy("fold", "label").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    with pytest.warns(UserWarning, match="fewer than 5"):
        W.check_fold_sizes(odd, "label", 5)


def test_hash_rank_matches_global_order(spark):
    df = spark.createDataFrame([(str(i), i % 3) for i in range(3000)], "id string, g int")
    ranked = W.hash_rank(df, ["g"], "id", 42, bucket_hex=1)
    rows = ranked.select("id", "g", "_rank", W.hash_key("id", 42).alias("h")).collect()
    for g in range(3):
        part = sorted([r for r in rows if r["g"] == g], key=lambda r: (r["h"], r["id"]))
        assert [r["_rank"] for r in part] == list(range(1, len(part) + 1))


def test_class_balance_F9(spark):
    for labels, want in [([0, 0, 0, 1, 1], (3, 2, 60.0, 40.0)), ([0] * 90 + [1] * 10, (90, 10, 90.0, 10.0)),
                         ([0, 0, 0, 0], (4, 0, 100.0, 0.0))]:
        df = spark.createDataFrame([(y,) for y in labels], "label int")
        r = {x["class_value"]: x for x in P.class_balance(df).collect()}
        assert (r[0]["count"], r[1]["count"], r[0]["percentage"], r[1]["percentage"]) == want


def test_one_hot_edges_E9(spark):
    df = spark.createDataFrame([("a", True, "x"), (None, False, "x"), ("b", None, "x")],
                               "c string, flag boolean, single string")
    enc, names = PR.one_hot_drop_first(df)
    assert names == ["c_b", "flag_True"]
    rows = enc.collect()
    assert [r["c_b"] for r in rows] == [0, 0, 1] and [r["flag_True"] for r in rows] == [1, 0, 0]
    prev, names2 = PR.one_hot_preview(df.withColumn("GT", F.lit("Good")), "GT")
    assert "flag" in prev.columns and names2 == ["c_b"]


def test_type_cascade_E10(spark):
    rows = [(str(i), "2024-01-0%d" % (i % 9 + 1), "cat%d" % (i % 3), "t%d" % i, None) for i in range(60)]
    df = spark.createDataFrame(rows, "num string, dt string, cat string, txt string, empty string")
    got = {r["column_name"]: r["inferred_type"] for r in P.infer_column_types(df).collect()}
    assert got == {"num": "numeric", "dt": "datetime", "cat": "categorical", "txt": "problematic",
                   "empty": "problematic"}


def test_duplicates_E11(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a")], "a int, b string")
    assert P.duplicate_rows(df).collect()[0]["duplicates"] == 2


def test_wrong_decision_tag_E13(spark):
    df = spark.createDataFrame([("Good",), ("Bad",), ("Maybe",)], "d string")
    offenders = PR.invalid_decisions(df, ["d"], "Good", "Bad").collect()
    assert [(r["column_name"], r["value"]) for r in offenders] == [("d", "Maybe")]
    with pytest.raises(Exception, match="is neither Good nor Bad"):
        df.select(PR.encode_decision("d", "Good", "Bad")).collect()


def test_empty_table_E15(spark, tmp_path):
    from quorum.sources.tables import scan_table
    p = tmp_path / "empty.csv"
    p.write_text("")
    with pytest.raises(ValueError):
        scan_table(spark, str(p), "csv")
    with pytest.raises(FileNotFoundError):
        scan_table(spark, str(tmp_path / "missing.parquet"))


def test_distinct_values_and_detection(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y", f"v{i:03d}", f"{i / 10}") for i in range(80)],
                               "id long, decision_col string, many string, prob_text string")
    dv = {r["column_name"]: r for r in P.distinct_values(df, ["decision_col", "many"]).collect()}
    assert dv["decision_col"]["values"] == ["x", "y"] and dv["many"]["n_distinct"] == 80
    assert dv["many"]["values"] == [f"v{i:03d}" for i in range(10)]
    dec = [r["column_name"] for r in P.detect_decision_columns(df, "id").collect()]
    assert dec == ["decision_col"]
    scores = {r["column_name"] for r in P.detect_score_columns(df, "id", [], ["decision_col"]).collect()}
    assert scores == {"prob_text"}


def test_order_statistics_small_limit(spark):
    import random
    rng = random.Random(5)
    xs = [rng.choice([1.0, 2.0, 2.0, 2.0]) if i % 3 == 0 else rng.random() * 100 for i in range(5000)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = P.exact_quantiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0], limit=50, accuracy=100)
    s = sorted(xs)
    for p, val in got.items():
        at = p * (len(s) - 1)
        lo = int(at)
        hi = min(lo + 1, len(s) - 1)
        assert val == pytest.approx(s[lo] + (s[hi] - s[lo]) * (at - lo), rel=1e-12)


def test_order_statistics_heavy_ties(spark):
    xs = [1.0] * 3000 + [2.0] * 3000 + [float(i) for i in range(3, 40)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = P.exact_quantiles(df, "v", [0.1, 0.4999, 0.5, 0.52, 0.99], limit=20, accuracy=50)
    s = sorted(xs)
    for p, val in got.items():
        at = p * (len(s) - 1)
        lo = int(at)
        hi = min(lo + 1, len(s) - 1)
        assert val == pytest.approx(s[lo] + (s[hi] - s[lo]) * (at - lo), rel=1e-12)


def test_unique_ids(spark):
    ok = spark.createDataFrame([("a",), ("b",)], "id string")
    W.check_unique_ids(ok, "id")
    bad = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    with pytest.raises(ValueError, match="a \\(x2\\)"):
        W.check_unique_ids(bad, "id")


def test_hash_folds_mode(spark):
    df = spark.createDataFrame([(str(i), i % 2) for i in range(2000)], "id string, label int")
    f = W.stratified_kfold(df, "id", "label", 5, 42, mode="hash")
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 2000 and min(sizes) > 300
    with pytest.raises(ValueError):
        W.stratified_kfold(df, "id", "label", 5, 42, mode="nope")


def test_one_hot_of_many_levels(spark):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(5000)], "c string")
    enc, names = PR.one_hot_drop_first(df)
    assert len(names) == 4999 and names[0] == "c_v0001"
    assert enc.agg(F.sum("c_v0001"), F.sum("c_v4999")).first() == (1, 1)


def test_correlation_blocks_with_missing_values_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 7)) + np.array([0, 1e6, -3, 0, 0, 5, 0])
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=400) * 0.1
    x[:, 5] = 7.0
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)) for r in x],
                               ", ".join(f"c{k} double" for k in range(7))).repartition(5)
    got = {(r["i"], r["j"]): r["abs_corr"] for r in PR.correlation_pairs(df, df.columns, block=3).collect()}
    assert len(got) == 21
    for (i, j), r in got.items():
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        want = None if 5 in (i, j) else abs(np.corrcoef(x[ok, i], x[ok, j])[0, 1])
        assert (r is None) if want is None else r == pytest.approx(want, abs=1e-9)
    plan = PR.correlation_pairs(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_folds_need_one_class_with_enough_rows(spark):
    small = spark.createDataFrame([(i, int(i < 3)) for i in range(7)], "id long, label int")
    with pytest.raises(Exception, match="exceeds the number of rows of every class"):
        W.stratified_kfold(small, "id", "label", 5).collect()
    with pytest.raises(ValueError):
        W.check_fold_sizes(small, "label", 5)


def test_ranking_of_many_groups_forces_no_broadcast(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as id", "id % 300 as g")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = W.hash_rank(df, ["g"], "id", 42, bucket_hex=6)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastExchange" not in plan


def test_scratch_needs_a_shared_folder_off_local(monkeypatch):
    from types import SimpleNamespace

    from quorum.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None)
    for master, fails in (("local-cluster[2,1,1024]", True), ("yarn", True), ("local[4]", False), ("local", False)):
        context = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
        spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None))
        if fails:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                ensure_checkpoint_dir(spark)
        else:
            ensure_checkpoint_dir(spark)


def test_duplicates_are_exact_when_fingerprints_collide(spark, monkeypatch):
    rows = [(i % 40, None if i % 3 else "a", float("nan") if i % 5 else 0.0) for i in range(300)] + [(1000 + i, "x", 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, b string, `c.d` double")
    seen, want = set(), 0
    for r in rows:
        want += repr(r) in seen
        seen.add(repr(r))
    colliding = [F.pmod(F.xxhash64("a"), F.lit(3))]
    assert P.duplicate_rows(df).first()[0] == want
    assert P.duplicate_rows(df, colliding).first()[0] == want
    monkeypatch.setattr(P, "_BROADCAST_PRINTS", 1)  # joined by shuffle
    assert P.duplicate_rows(df).first()[0] == want
    assert P.duplicate_rows(df.limit(0)).first()[0] == 0


def test_smallest_values_merge_tasks(spark):
    df = spark.range(20_000).select(F.concat(F.lit("v"), F.pmod(F.col("id") * 7919, F.lit(5000)).cast("string")).alias("many"),
                                    F.when(F.col("id") % 5 > 0, (F.col("id") % 51).cast("string")).alias("few"),
                                    F.lit(None).cast("string").alias("none")).repartition(90)
    got = P.smallest_values(df, ["many", "few", "none"], 51)
    assert got["many"] == sorted({f"v{i}" for i in range(5000)})[:51]
    assert got["few"] == sorted(str(i) for i in range(51)) and got["none"] == []
    dv = {r["column_name"]: r for r in P.distinct_values(df, ["many", "few", "none"]).collect()}
    assert set(dv) == {"many", "few"} and dv["many"]["n_distinct"] == 5000 and dv["few"]["n_distinct"] == 51
    assert len(dv["few"]["values"]) == 10
    kinds = {r["column_name"]: r for r in P.infer_column_types(df.withColumn("t", F.concat(F.lit("t"), "few")), count_distinct=False).collect()}
    assert kinds["few"]["inferred_type"] == "numeric" and kinds["many"]["inferred_type"] == "problematic"
    assert kinds["t"]["inferred_type"] == "problematic" and kinds["none"]["n_distinct"] == 0 and kinds["many"]["n_distinct"] is None


@pytest.mark.parametrize("limit, points", [(10_000, 2000), (100, 100), (20, 30)])
def test_two_pass_quantiles_equal_numpy(spark, limit, points):
    rng = np.random.default_rng(6)
    cols = {"skewed": np.exp(rng.normal(size=30_000) * 5), "ties": rng.integers(0, 4, 30_000).astype(float),
            "half": np.where(rng.random(30_000) < 0.5, 7.0, rng.normal(size=30_000)), "one": np.full(30_000, 3.0)}
    df = spark.createDataFrame(__import__("pandas").DataFrame(cols)).repartition(7)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = P.exact_quantiles(df, list(cols), probs, limit=limit, accuracy=points)
    for c, x in cols.items():
        for p in probs:
            assert got[c][p] == pytest.approx(np.quantile(x, p), rel=1e-12), (c, p)


def test_summaries_keep_ranks(spark):
    """Many chunks in one task, and reductions of reductions, keep every rank within the bracket's margin."""
    import pyarrow as pa
    rng = np.random.default_rng(8)
    x = np.exp(rng.normal(size=200_000) * 3)
    batches = [pa.RecordBatch.from_arrays([pa.array(part)], names=["c0"]) for part in np.array_split(x, 50)]
    out = list(P._summaries(1, 500, chunk=2000, held=16)(iter(batches)))
    values, weight = out[0].column(2)[0].as_py(), out[0].column(1)[0].as_py()
    assert weight * len(values) == pytest.approx(len(x))
    ranks = np.searchsorted(np.sort(x), values) / len(x)
    assert np.abs(ranks - (np.arange(500) + 0.5) / 500).max() < 5 / 500


def test_describe_of_columns_with_missing_values(spark):
    df = spark.createDataFrame([(float(i % 977), None if i % 7 else float("nan"), i) for i in range(30_000)], "a double, b double, k long")
    rows = {r["feature"]: r for r in P.describe(df, ["a", "b", "k"]).collect()}
    assert rows["a"]["q50"] == float(np.quantile([i % 977 for i in range(30_000)], 0.5))
    assert rows["b"]["count"] == 0 and rows["b"]["q50"] is None and rows["k"]["q25"] == 29_999 / 4
    rough = {r["feature"]: r for r in P.describe(df, ["a", "b", "k"], approx=True).collect()}
    assert abs(rough["k"]["q50"] - 15_000) < 30 and rough["b"]["q50"] is None


def test_sparse_one_hot_of_a_million_levels(spark, monkeypatch):
    """No list of levels reaches the driver: collects of more than 1000 rows fail here."""
    n = 1_000_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lpad(F.col("id").cast("string"), 7, "0"))
                               .alias("c"), F.when(F.col("id") % 2 == 0, F.lpad((F.col("id") * 7 % n).cast("string"), 7, "0")).alias("d"))
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: [r for k, r in enumerate(real(self.limit(1001))) if k < 1000 or pytest.fail("collect")])
    got = PR.one_hot_sparse(df, "id", ["c", "d"])
    n_c, n_d = n // 3 + 1, n // 2  # levels: numbers and 'hot', the largest
    first = got.filter("id in (0, 1, 4, 5, 8)").collect()
    cells = {r["id"]: list(r["indices"]) for r in first}
    d_rank = {i: (i * 7 % n) // 2 for i in (0, 4, 8)}  # the even numbers in order
    assert {r["size"] for r in first} == {n_c - 1 + n_d - 1}
    assert cells[0] == [n_c - 2] and cells[1] == [] and cells[5] == []
    assert cells[4] == [0, n_c - 1 + d_rank[4] - 1] and cells[8] == [n_c - 1 + d_rank[8] - 1]
    assert got.agg(F.count("id"), F.sum(F.size("indices"))).first() == (n, n - n // 3 - 1 - 1 + n // 2 + 0)


def test_sparse_one_hot_edges(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, None, "x"), (3, "a", None), (4, "c", "x"), (5, None, None)], "id long, s string, t string")
    got = {r["id"]: (r["size"], list(r["indices"])) for r in PR.one_hot_sparse(df, "id", ["s", "t"]).collect()}
    assert got == {1: (2, [0]), 2: (2, []), 3: (2, []), 4: (2, [1]), 5: (2, [])}
    levels = PR.level_dictionary(df, ["s", "t"])
    other = spark.createDataFrame([(9, "c", "unseen")], "id long, s string, t string")
    assert [list(r["indices"]) for r in PR.one_hot_sparse(other, "id", ["s", "t"], levels).collect()] == [[1]]
    assert PR.one_hot_sparse(df.limit(0), "id", ["s", "t"]).collect() == []
    with pytest.raises(ValueError):
        PR.category_levels(df, ["s"], limit=2)


def test_correlation_of_many_tasks_merges_as_a_tree(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 5)) + [0, 1e4, 3, -5, 0]
    x[:, 4] = x[:, 0] * 2 + rng.normal(size=3000) * 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(5))).repartition(150)
    merged = PR.merged_blocks(df, 5, 2)
    sizes = merged.groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("most"), F.sum("blocks").alias("all")).collect()
    assert all(r["n"] <= 32 and r["most"] <= 32 for r in sizes)
    for r in PR.correlation_pairs(df, df.columns, block=2).collect():
        a, b = x[:, r["i"]], x[:, r["j"]]
        ok = ~np.isnan(a) & ~np.isnan(b)
        assert r["abs_corr"] == pytest.approx(abs(np.corrcoef(a[ok], b[ok])[0, 1]), abs=1e-9)
