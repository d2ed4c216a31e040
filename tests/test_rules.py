"""Rule operators (E6 truth tables, E7 validation) and combined runs."""

import itertools

import pytest
from pyspark.sql import functions as F

from quorum.config import Costs
from quorum.functions.rules import combine
from quorum.operators import rules as R

MEANING = {
    "OR": lambda b: int(any(b)), "AND": lambda b: int(all(b)), "XOR": lambda b: sum(b) % 2,
    "NOR": lambda b: int(not any(b)), "NAND": lambda b: int(not all(b)), "NXOR": lambda b: 1 - sum(b) % 2,
}


@pytest.mark.parametrize("n", [2, 3, 4])
def test_truth_tables_E6(spark, n):
    rows = list(itertools.product([0, 1], repeat=n))
    cols = [f"c{i}" for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    out = df.select(*cols, *[combine(op, [F.col(c) for c in cols]).alias(op) for op in MEANING]).collect()
    for r in out:
        bits = [r[c] for c in cols]
        for op, fn in MEANING.items():
            assert r[op] == fn(bits), (op, bits)


def test_aliases():
    from quorum.functions.rules import canonical_logic
    assert canonical_logic("|") == "OR" and canonical_logic("&") == "AND" and canonical_logic("^") == "XOR"
    with pytest.raises(ValueError):
        canonical_logic("IMPLIES")


def test_validation_E7():
    avail = ["kfold_avg_X", "D"]
    with pytest.raises(ValueError, match="without columns"):
        R.validate_rules([R.Rule("r", [], "OR")], avail)
    with pytest.raises(ValueError, match="unknown rule logic"):
        R.validate_rules([R.Rule("r", ["X"], "BAD")], avail)
    with pytest.raises(ValueError, match="no run is named"):
        R.validate_rules([R.Rule("r", ["Y"], "OR")], avail)
    with pytest.raises(ValueError, match="several rules"):
        R.validate_rules([R.Rule("r", ["X"]), R.Rule("r", ["D"])], avail)
    assert R.resolve_columns([R.Rule("r", ["X", "kfold_avg_X", "D"])], avail) == {
        "X": "kfold_avg_X", "kfold_avg_X": "kfold_avg_X", "D": "D"}
    assert R.validate_rules([R.Rule("off", [], "OR", enabled=False)], avail) == []


def _preds(spark):
    rows = []
    for i in range(8):
        rows.append(("kfold_avg_S", "oof", str(i), i / 8))
        rows.append(("kfold_avg_S", "Full", str(i), 0.0))  # must lose against oof
        rows.append(("D", "Full", str(i), float(i % 2)))
    return spark.createDataFrame(rows, "model_name string, kind string, id string, score double")


def test_pick_and_classify(spark):
    preds = _preds(spark)
    picked = {r["model_name"]: r["kind"] for r in R.pick_scores(preds).collect()}
    assert picked == {"kfold_avg_S": "oof", "D": "Full"}
    kinds = {r["model_name"]: r["model_kind"] for r in R.classify_models(preds.filter("kind = 'oof' or "
                                                                                     "model_name = 'D'")).collect()}
    assert kinds == {"kfold_avg_S": "meta", "D": "decision"}


def test_combined_runs_long_and_wide_agree(spark):
    preds = _preds(spark)
    labels = spark.createDataFrame([(str(i), int(i >= 4)) for i in range(8)], "id string, label int")
    rules = [R.Rule("a", ["S", "D"], "AND"), R.Rule("o", ["S", "D"], "OR"), R.Rule("x", ["S", "D"], "NXOR")]
    long_res = {r["model_name"]: r for r in R.combined_runs(preds, labels, rules, Costs(), 5, {"S": 0.4})[0].collect()}
    wide = spark.createDataFrame([(str(i), int(i >= 4), i / 8, float(i % 2)) for i in range(8)],
                                 "id string, label int, s double, d double")
    wide_res = {r["model_name"]: r for r in R.combined_runs_wide(
        wide, "label", {"kfold_avg_S": "s", "D": "d"}, rules, Costs(), 5, {"S": 0.4})[0].collect()}
    for name in ["a", "o", "x"]:
        for f in ["tp", "fp", "tn", "fn", "cost"]:
            assert long_res[name][f] == wide_res[name][f]
    # brute force for AND: S >= 0.4 <=> i >= 4 (3.2), D = i odd
    tp = sum(1 for i in range(8) if i / 8 >= 0.4 and i % 2 == 1 and i >= 4)
    assert long_res["a"]["tp"] == tp and long_res["a"]["threshold_type"] == "combined"
    assert long_res["a"]["is_base_model"] is True and long_res["a"]["threshold"] is None


def test_rule_problems_B8(spark):
    preds = _preds(spark).filter("not (model_name = 'D' and cast(id as int) >= 6)")
    rc = spark.createDataFrame([("r", "S"), ("r", "D"), ("bad", "Nope")], "rule_name string, column_name string")
    got = {(r["rule_name"], r["problem"], r["detail"]) for r in R.rule_problems(preds, rc).collect()}
    assert got == {("r", "unequal_ids", "2"), ("bad", "unknown_model", "Nope")}


def test_apply_rules_chain_B10(spark, tmp_path):
    from quorum.config import EvalConfig
    from quorum.plans.flows import apply_rules
    from quorum.sources.tables import ResultsStore
    store = ResultsStore(spark, str(tmp_path / "store"))
    labels = spark.createDataFrame([(str(i), int(i >= 4)) for i in range(8)], "id string, label int")
    base = spark.createDataFrame([("m", 1.0)], "model_name string, cost double").limit(0)
    store.save("run", {"predictions": _preds(spark), "labels": labels, "model_metrics": base})
    cfg = EvalConfig()
    first = apply_rules(store, "run", [R.Rule("r1", ["S", "D"], "AND")], cfg, {"S": 0.4})
    assert [r["model_name"] for r in first.collect()] == ["r1"]
    # a later call can build on the stored combined model
    second = apply_rules(store, "run", [R.Rule("r2", ["r1", "D"], "OR")], cfg)
    row = second.collect()[0]
    assert row["model_name"] == "r2" and row["tp"] + row["fn"] == 4
    # within one call a rule cannot see another rule of the same call
    with pytest.raises(ValueError, match="no run is named"):
        apply_rules(store, "run", [R.Rule("r3", ["D"], "OR"), R.Rule("r4", ["r3"], "OR")], cfg)
    assert apply_rules(store, "run", [R.Rule("off", [], "OR", enabled=False)], cfg).count() == 0
    # a rule applied again replaces what it stored before, in every target
    apply_rules(store, "run", [R.Rule("r1", ["S", "D"], "OR")], cfg, {"S": 0.4})
    for name, n in (("model_metrics", 1), ("confusion_matrices", 1), ("model_summary", 1), ("predictions", 8)):
        assert store.load(name, "run").filter("model_name = 'r1'").count() == n
    assert store.load("predictions", "run").filter("model_name = 'r2'").count() == 8
    assert store.load("model_summary", "run").filter("model_name = 'r1'").first()["total_samples"] == 8


def test_runs_of_different_ids_are_an_error(spark):
    labels = spark.createDataFrame([(str(i), int(i >= 4)) for i in range(8)], "id string, label int")
    preds = _preds(spark).filter("not (model_name = 'D' and cast(id as int) >= 6)")
    rule = [R.Rule("r", ["S", "D"], "AND")]
    with pytest.raises(Exception, match="cover different ids"):
        R.combined_runs(preds, labels, rule, Costs(), 5)[0].collect()
    # a rule over runs that all leave out the same ids only counts the others
    alone = R.combined_runs(preds, labels, [R.Rule("d", ["D"], "OR"), R.Rule("s", ["S"], "OR")], Costs(), 5)[0].collect()
    assert {r["model_name"]: r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in alone} == {"d": 6, "s": 8}


def test_scores_of_an_id_meet_in_one_shuffle_F12_F13(spark):
    from quorum.config import EvalConfig
    from quorum.plans.flows import base_predictions
    df = spark.createDataFrame([(str(i), i / 8, "Bad" if i % 2 else "Good") for i in range(8)], "id string, S double, D string")
    preds = base_predictions(df, EvalConfig(), "id", ["S"], ["D"])
    wide = R.scores_by_id(preds, ["kfold_avg_S", "D"])
    assert sorted(tuple(r) for r in wide.collect()) == [(str(i), i / 8, float(i % 2)) for i in range(8)]
    for frame in (wide, R.rule_inputs(preds, ["kfold_avg_S", "D"])):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "pivotfirst" not in plan and "Union" not in plan
    got = R.rule_inputs(preds, ["kfold_avg_S", "D"]).filter("id = '3'").first()
    assert tuple(got) == ("3", 3 / 8, False, 1.0, True)


def test_rule_problems_with_many_runs_F4_F5(spark):
    """Runs beyond one number's bits; ids are grouped once, not once a rule."""
    import re
    rows = [(f"m{j:03d}", "Full", str(i), 1.0) for j in range(150) for i in range(6) if i < 4 or j != 149]
    preds = spark.createDataFrame(rows, "model_name string, kind string, id string, score double")
    rc = spark.createDataFrame([("a", "m000"), ("a", "m149"), ("b", "m001"), ("b", "m100"), ("c", "m149"), ("d", "none")],
                               "rule_name string, column_name string")
    out = R.rule_problems(preds, rc)
    assert {tuple(r) for r in out.collect()} == {("a", "unequal_ids", "2"), ("d", "unknown_model", "none")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[id#\d+\]", plan) and not re.search(r"Aggregate \[rule_name#\d+, id#\d+", plan)
    assert R.rule_problems(preds.limit(0), rc).filter("problem = 'unequal_ids'").count() == 0


def test_rules_are_applied_from_one_row_an_id_F2_F8(spark, tmp_path, monkeypatch):
    from quorum.config import EvalConfig
    from quorum.plans import flows
    from quorum.sources.tables import ResultsStore
    frames = []
    keep = flows.written
    monkeypatch.setattr(flows, "written", lambda df, tag: frames.append(keep(df, tag)) or frames[-1])
    store = ResultsStore(spark, str(tmp_path / "store"))
    labels = spark.createDataFrame([(str(i), int(i >= 4)) for i in range(8)], "id string, label int")
    base = spark.createDataFrame([("m", 1.0)], "model_name string, cost double").limit(0)
    store.save("run", {"predictions": _preds(spark), "labels": labels, "model_metrics": base})
    rules = [R.Rule("and", ["S", "D"], "AND"), R.Rule("a.b", ["S", "D"], "OR")]
    got = {r["model_name"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in flows.apply_rules(store, "run", rules, EvalConfig()).collect()}
    want = {n: tuple(sum(1 for i in range(8) if (int(i >= 4), int(f(i >= 4, i % 2 == 1))) == c) for c in ((1, 1), (0, 1), (0, 0), (1, 0)))
            for n, f in (("and", lambda s, d: s and d), ("a.b", lambda s, d: s or d))}
    assert got == want
    assert [f.count() for f in frames] == [8]  # not one row a rule
    stored = store.load("predictions", "run").filter("model_name = 'a.b'")
    assert {r["id"]: r["score"] for r in stored.collect()} == {str(i): float(i >= 4 or i % 2) for i in range(8)}
