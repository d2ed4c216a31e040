"""Registered queries over the driver tables and their SQL oracles.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame; the matching
oracle (when the computation is SQL-expressible) is a DuckDB statement over
the same tables. Column names are identical on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorum.config import EvalConfig
from quorum.plans import sql as S
from quorum.plans import views as V
from quorum.plans.flows import score_column_eval

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

CFG = EvalConfig()


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --- M7: flagship -------------------------------------------------------------------------------

@register("m7_score_column_eval", S.score_eval_sql(CFG, V.SCORE_COLUMNS))
def m7_score_column_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_column_eval(V.scored(spark, sf_dir), CFG, V.ID, V.TARGET, V.SCORE_COLUMNS)["results"]


# --- A1-A8, M8: evaluation ------------------------------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from quorum.functions import metrics as M  # noqa: E402
from quorum.functions.rules import sql_combine  # noqa: E402
from quorum.operators import evaluation as E  # noqa: E402
from quorum.operators import rules as R  # noqa: E402
from quorum.operators.folds import auto_bucket_hex, stratified_kfold, stratified_split  # noqa: E402
from quorum.operators.prep import encode_decision, encode_target, invalid_decisions  # noqa: E402
from quorum.session import written  # noqa: E402
from quorum.plans.flows import (  # noqa: E402
    apply_rules, base_predictions, decision_column_eval, decision_long, folded, labels_of, long_scores,
    run_end_to_end, score_column_sweeps)

_SC = V.SCORE_COLUMNS
_DC = V.DECISION_COLUMNS
_SCORED_FOLDS = S.with_(V.SCORED_SQL, S.folds_cte(CFG))
_M7_CTES = [V.SCORED_SQL, S.folds_cte(CFG), S.long_cte(_SC), S.sweep_cte(CFG)]
_DEC_CTES = [V.SCORED_SQL, S.decision_long_cte(CFG, _DC), S.counts_cte("dlong")]


def _dlong(spark, sf_dir):
    return decision_long(V.scored(spark, sf_dir), CFG, V.ID, V.TARGET, _DC)


@register("a1_confusion_counts", S.with_(*_DEC_CTES) + "SELECT model_name, tp, fp, tn, fn FROM counts")
def a1_confusion_counts(spark, sf_dir):
    return E.confusion_counts(_dlong(spark, sf_dir), ["model_name"], "label", "pred")


@register("a2_classification_metrics", S.with_(*_DEC_CTES) + f"""
SELECT model_name, tp, fp, tn, fn, {S.metrics(CFG)}, {S.cost(CFG)} AS cost, {S.cost(CFG)} AS cost_total FROM counts""")
def a2_classification_metrics(spark, sf_dir):
    return E.with_metrics(a1_confusion_counts(spark, sf_dir), CFG.costs)


@register("a3_threshold_sweep", S.with_(*_M7_CTES) + "SELECT * FROM sweep")
def a3_threshold_sweep(spark, sf_dir):
    return score_column_sweeps(V.scored(spark, sf_dir), CFG, V.ID, V.TARGET, _SC)


@register("a4_best_threshold", S.with_(*_M7_CTES, S.best_cte()) + """
SELECT model_name, 'Fold' || fold AS split, threshold_type, threshold, precision, recall, f1_score, accuracy,
       cost, tp, fp, tn, fn, false AS is_base_model, cost AS cost_total FROM best""")
def a4_best_threshold(spark, sf_dir):
    return E.fold_results(E.best_thresholds(a3_threshold_sweep(spark, sf_dir), ["model_name", "fold"]))


@register("a5_average_fold_results", S.score_eval_sql(CFG, _SC))
def a5_average_fold_results(spark, sf_dir):
    best = E.best_thresholds(a3_threshold_sweep(spark, sf_dir), ["model_name", "fold"])
    return E.average_fold_results(best, CFG.costs)


@register("a6_average_fold_sweep", S.with_(*_M7_CTES) + f"""
SELECT 'kfold_avg_' || model_name AS model_name, 'Full' AS split, threshold, tp, fp, tn, fn, cost,
       {S.metrics(CFG)}
FROM (SELECT model_name, threshold, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp,
             CAST(sum(tn) AS DOUBLE) AS tn, CAST(sum(fn) AS DOUBLE) AS fn, CAST(sum(cost) AS DOUBLE) AS cost
      FROM sweep GROUP BY model_name, threshold) s""")
def a6_average_fold_sweep(spark, sf_dir):
    return E.average_fold_sweep(a3_threshold_sweep(spark, sf_dir))


@register("a7_positional_mean", S.with_(V.SCORED_SQL, S.folds_cte(CFG), S.long_cte(_SC)) + f"""
, ranked AS (
  SELECT model_name, fold, score,
         row_number() OVER (PARTITION BY model_name, fold ORDER BY md5(concat_ws(':', id, '{CFG.seed}')), id) AS position,
         count(*) OVER (PARTITION BY model_name, fold) AS fold_n
  FROM long),
shortest AS (SELECT model_name, min(fold_n) AS min_n FROM ranked GROUP BY model_name)
SELECT r.model_name, r.position,
       list_reduce(list(CASE WHEN isnan(score) THEN NULL ELSE score END ORDER BY fold), lambda a, x: a + x)
         / count(*) AS mean_score
FROM ranked r JOIN shortest s ON r.model_name = s.model_name AND r.position <= s.min_n
GROUP BY r.model_name, r.position""")
def a7_positional_mean(spark, sf_dir):
    # both rankings read their rows twice, so the folds are written; all models score the same rows, which are ranked once
    rows = written(folded(V.scored(spark, sf_dir), CFG, V.ID, V.TARGET).select(V.ID, "label", "fold", *_SC), "folded")
    hexd = CFG.fold_bucket_hex or auto_bucket_hex(rows.count(), CFG.n_splits)
    ranked = E.fold_positions(rows, V.ID, CFG.seed, bucket_hex=hexd)
    long = long_scores(ranked, V.ID, _SC, keep=("label", "fold", "position", "_min_n"))
    return E.positional_mean(long, V.ID, CFG.seed)


@register("m8_decision_column_eval", S.with_(*_DEC_CTES) + S.decision_results_select(CFG, "base"))
def m8_decision_column_eval(spark, sf_dir):
    return decision_column_eval(V.scored(spark, sf_dir), CFG, V.ID, V.TARGET, _DC)


@register("a8_normalised_cost", S.with_(*_DEC_CTES) + f"""
SELECT model_name, {S.cost(CFG)} / {CFG.n_splits} AS cost, {S.cost(CFG)} AS cost_total FROM counts""")
def a8_normalised_cost(spark, sf_dir):
    return m8_decision_column_eval(spark, sf_dir).select("model_name", "cost", "cost_total")


# --- W1, W2, P2-P4, P7 ---------------------------------------------------------------------------

@register("w1_stratified_kfold", _SCORED_FOLDS + "SELECT id, label, fold FROM folds")
def w1_stratified_kfold(spark, sf_dir):
    return folded(V.scored(spark, sf_dir), CFG, V.ID, V.TARGET).select(V.ID, "label", "fold")


@register("w2_stratified_split", S.with_(V.SCORED_SQL) + f"""
SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', id, '{CFG.seed}')), id)
                        <= ceil({CFG.test_size!r}::DOUBLE * count(*) OVER (PARTITION BY label))
                   THEN 'Test' ELSE 'Train' END AS split
FROM scored""")
def w2_stratified_split(spark, sf_dir):
    lab = encode_target(V.scored(spark, sf_dir), V.TARGET, CFG.good_tag, CFG.bad_tag)
    return stratified_split(lab, V.ID, "label", CFG.test_size, CFG.seed, CFG.fold_bucket_hex).select(
        V.ID, "label", "split")


@register("p2_encode_target", S.with_(V.SCORED_SQL) + "SELECT id, label FROM scored")
def p2_encode_target(spark, sf_dir):
    return encode_target(V.scored(spark, sf_dir), V.TARGET, CFG.good_tag, CFG.bad_tag).select(V.ID, "label")


@register("p3_validate_decisions", """
SELECT column_name, value, count(*) AS n FROM (
  SELECT 'l_returnflag' AS column_name, l_returnflag AS value FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem) t
WHERE value IS NULL OR value NOT IN ('N', 'R')
GROUP BY column_name, value""")
def p3_validate_decisions(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return invalid_decisions(li, ["l_returnflag", "l_linestatus"], "N", "R")


@register("p4_encode_decision", S.with_(V.SCORED_SQL) + "SELECT id, " + ", ".join(
    f"CASE WHEN {c} = 'Bad' THEN 1 ELSE 0 END AS {c}" for c in _DC) + " FROM scored")
def p4_encode_decision(spark, sf_dir):
    return V.scored(spark, sf_dir).select(V.ID, *[encode_decision(c, CFG.good_tag, CFG.bad_tag).alias(c)
                                                  for c in _DC])


@register("p7_apply_threshold", S.with_(V.SCORED_SQL) + "SELECT id, " + ", ".join(
    f"{S.threshold_decision(c, 0.5)} AS {c}" for c in _SC) + " FROM scored")
def p7_apply_threshold(spark, sf_dir):
    return V.scored(spark, sf_dir).select(V.ID, *[M.apply_threshold(c, 0.5).alias(c) for c in _SC])


# --- B1-B10, J3, J4, P19, P20, U1 ----------------------------------------------------------------

RULES = [
    R.Rule("or_status_qty", ["d_status", "d_bigqty"], "OR"),
    R.Rule("and_discount_status", ["s_discount", "d_status"], "AND"),
    R.Rule("xor_three", ["d_status", "d_bigqty", "s_qty"], "XOR"),
    R.Rule("nor_three", ["kfold_avg_s_tax", "d_status", "d_bigqty"], "NOR"),
    R.Rule("nand_two", ["s_tax", "s_qty"], "NAND"),
    R.Rule("nxor_four", ["s_discount", "s_tax", "s_qty", "d_bigqty"], "NXOR"),
]
RULE_THRESHOLDS = {"s_tax": 0.35, "kfold_avg_s_tax": 0.35, "s_qty": 0.6}
_OP_RULES = {
    op: [R.Rule(f"{op.lower()}_two", ["d_status", "s_qty"], op),
         R.Rule(f"{op.lower()}_three", ["d_status", "d_bigqty", "s_discount"], op)]
    for op in ["OR", "AND", "XOR", "NOR", "NAND", "NXOR"]
}


def _rule_col_sql(c: str, thresholds: dict[str, float]) -> str:
    base = c.replace("kfold_avg_", "")
    if base in _DC:
        return f"(CASE WHEN {base} = 'Bad' THEN 1 ELSE 0 END)"
    return f"({S.threshold_decision(base, thresholds.get(c, 0.5))})"


def _rules_sql(rules, thresholds) -> str:
    exprs = ", ".join(f"{sql_combine(r.logic, [_rule_col_sql(c, thresholds) for c in r.columns])} AS {r.name}"
                      for r in rules)
    longs = " UNION ALL ".join(f"SELECT id, label, '{r.name}' AS model_name, {r.name} AS pred FROM ruled"
                               for r in rules)
    return S.with_(V.SCORED_SQL, f"ruled AS (SELECT id, label, {exprs} FROM scored)", f"rlong AS ({longs})",
                   S.counts_cte("rlong")) + S.decision_results_select(CFG, "combined")


def _wide_scored(spark, sf_dir):
    """The scored table as a wide prediction frame: one 0/1-or-score column per run, plus label."""
    df = encode_target(V.scored(spark, sf_dir), V.TARGET, CFG.good_tag, CFG.bad_tag)
    wide = df.select(V.ID, "label", *[F.col(c).alias(f"kfold_avg_{c}") for c in _SC],
                     *[encode_decision(c, CFG.good_tag, CFG.bad_tag).cast("double").alias(c) for c in _DC])
    cols = {**{f"kfold_avg_{c}": f"kfold_avg_{c}" for c in _SC}, **{c: c for c in _DC}}
    return wide, cols


def _combined(spark, sf_dir, rules, thresholds):
    """B9 on the scored table itself (wide path: no pivot); B10 exercises the stored long path."""
    wide, cols = _wide_scored(spark, sf_dir)
    return R.combined_runs_wide(wide, "label", cols, rules, CFG.costs, CFG.n_splits, thresholds, V.ID)


for _i, (_op, _rules) in enumerate(_OP_RULES.items(), start=1):
    def _make(rules):
        return lambda spark, sf_dir: _combined(spark, sf_dir, rules, {})[0]
    register(f"b{_i}_rule_{_op.lower()}", _rules_sql(_rules, {}))(_make(_rules))


@register("b7_rule_thresholds", S.with_(V.SCORED_SQL) + "SELECT id, " + ", ".join(
    [f"{_rule_col_sql(c, RULE_THRESHOLDS)} AS \"{c}\"" for c in ["kfold_avg_s_discount", "kfold_avg_s_tax",
                                                                 "kfold_avg_s_qty"]]
    + [f"{_rule_col_sql(c, {})} AS {c}" for c in _DC]) + " FROM scored")
def b7_rule_thresholds(spark, sf_dir):
    wide, cols = _wide_scored(spark, sf_dir)
    return R.decisions_wide(wide, cols, RULE_THRESHOLDS, V.ID)


@register("b7b_rule_thresholds_long", ORACLES["b7_rule_thresholds"])
def b7b_rule_thresholds_long(spark, sf_dir):
    """B7 over stored long predictions (J3 pivot + P19 + P20), the form used for stored runs."""
    df = V.scored(spark, sf_dir)
    models = [f"kfold_avg_{c}" for c in _SC] + _DC
    wide = R.rule_inputs(base_predictions(df, CFG, V.ID, _SC, _DC), models)
    return wide.select(F.col("id"), *[R.decision_of(m, RULE_THRESHOLDS.get(m, 0.5)).alias(m) for m in models])


@register("b9_combined_runs", _rules_sql(RULES, RULE_THRESHOLDS))
def b9_combined_runs(spark, sf_dir):
    return _combined(spark, sf_dir, RULES, RULE_THRESHOLDS)[0]


@register("j3_assemble_predictions", S.with_(V.SCORED_SQL) + "SELECT id, label AS GT, " + ", ".join(
    [f"{c} AS kfold_avg_{c}" for c in _SC] + [f"CAST(CASE WHEN {c} = 'Bad' THEN 1 ELSE 0 END AS DOUBLE) AS {c}"
                                             for c in _DC]) + " FROM scored")
def j3_assemble_predictions(spark, sf_dir):
    df = V.scored(spark, sf_dir)
    preds = base_predictions(df, CFG, V.ID, _SC, _DC)
    models = [f"kfold_avg_{c}" for c in _SC] + _DC
    wide = R.scores_by_id(preds, models)
    return labels_of(df, CFG, V.ID, V.TARGET).withColumnRenamed("label", "GT").join(wide, "id", "left")


def _rule_columns_frame(spark):
    rows = [(r.name, c) for r in RULES for c in r.columns] + [("broken", "no_such_model")]
    return spark.createDataFrame(rows, "rule_name string, column_name string")


def _j4_sql() -> str:
    rc = ", ".join(f"('{r}', '{c}')" for r, c in [(r.name, c) for r in RULES for c in r.columns]
                   + [("broken", "no_such_model")])
    runs = ", ".join(f"('{m}')" for m in [f"kfold_avg_{c}" for c in _SC] + _DC)
    return S.with_(V.SCORED_SQL, f"rc(rule_name, column_name) AS (VALUES {rc})",
                   f"runs AS (SELECT r.m AS run FROM (VALUES {runs}) r(m) WHERE EXISTS (SELECT 1 FROM scored))",
                   "keys AS (SELECT run AS key FROM runs UNION SELECT replace(run, 'kfold_avg_', '') FROM runs)") + \
        "SELECT rule_name, column_name FROM rc WHERE column_name NOT IN (SELECT key FROM keys) " \
        "AND 'kfold_avg_' || column_name NOT IN (SELECT key FROM keys)"


@register("j4_unresolved_rule_columns", _j4_sql())
def j4_unresolved_rule_columns(spark, sf_dir):
    preds = base_predictions(V.scored(spark, sf_dir), CFG, V.ID, _SC, _DC)
    return R.unresolved_columns(_rule_columns_frame(spark), preds)


@register("p19_pick_scores", S.with_(V.SCORED_SQL) + """
SELECT model_name, kind, n FROM (
  SELECT 'kfold_avg_' || m AS model_name, 'oof' AS kind, count(*) AS n FROM scored, (VALUES ('s_discount'), ('s_tax'), ('s_qty')) v(m) GROUP BY m
  UNION ALL
  SELECT m AS model_name, 'Full' AS kind, count(*) AS n FROM scored, (VALUES ('d_status'), ('d_bigqty')) v(m) GROUP BY m)""")
def p19_pick_scores(spark, sf_dir):
    return R.pick_scores(base_predictions(V.scored(spark, sf_dir), CFG, V.ID, _SC, _DC))


@register("p20_classify_model_kind", S.with_(V.SCORED_SQL) + """
SELECT model_name, CASE WHEN count(s) > 0 AND bool_and(coalesce(s IN (0.0, 1.0), true)) THEN 'decision' ELSE 'meta' END
       AS model_kind
FROM (""" + " UNION ALL ".join(
    [f"SELECT 'kfold_avg_{c}' AS model_name, CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS s FROM scored" for c in _SC]
    + [f"SELECT '{c}', CASE WHEN {c} = 'Bad' THEN 1.0 ELSE 0.0 END FROM scored" for c in _DC]) + """) t
GROUP BY model_name""")
def p20_classify_model_kind(spark, sf_dir):
    return R.classify_models(base_predictions(V.scored(spark, sf_dir), CFG, V.ID, _SC, _DC))


# --- A9-A16, A25, P9-P11, M18: profiling --------------------------------------------------------

from quorum.operators import profile as P  # noqa: E402

_UC = V.UNTYPED_COLUMNS


@register("a9_class_balance", S.with_(V.SCORED_SQL, """c AS (
  SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM scored)""") + """
SELECT 0 AS class_value, 'Good (0)' AS class_label, n0 AS count,
       CASE WHEN n0 + n1 > 0 THEN n0 / (n0 + n1) * 100 ELSE 0.0::DOUBLE END AS percentage, n0 + n1 AS total FROM c
UNION ALL
SELECT 1, 'Bad (1)', n1, CASE WHEN n0 + n1 > 0 THEN n1 / (n0 + n1) * 100 ELSE 0.0::DOUBLE END, n0 + n1 FROM c""")
def a9_class_balance(spark, sf_dir):
    return P.class_balance(p2_encode_target(spark, sf_dir))


@register("a10_value_distribution", """
SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def a10_value_distribution(spark, sf_dir):
    return P.value_distribution(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority")


@register("a11_missing_values", S.with_(V.UNTYPED_ORDERS_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM untyped" for c in _UC))
def a11_missing_values(spark, sf_dir):
    return P.missing_values(V.untyped_orders(spark, sf_dir))


_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]


@register("a12_duplicate_rows", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM lineitem GROUP BY """ + ", ".join(_LINEITEM) + """) g""")
def a12_duplicate_rows(spark, sf_dir):
    return P.duplicate_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@register("a13_constant_columns", S.with_(V.UNTYPED_ORDERS_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c}) IS NOT DISTINCT FROM max({c}) AS is_constant FROM untyped" for c in _UC))
def a13_constant_columns(spark, sf_dir):
    return P.constant_columns(V.untyped_orders(spark, sf_dir))


_A14_COLS = _UC


@register("a14_distinct_values", S.with_(V.UNTYPED_ORDERS_SQL) + """
SELECT column_name, count(*) AS n_distinct,
       CASE WHEN count(*) <= 50 THEN list(value ORDER BY value)[1:50] ELSE list(value ORDER BY value)[1:10] END AS values
FROM (""" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM untyped WHERE {c} IS NOT NULL" for c in _A14_COLS)
    + ") d GROUP BY column_name")
def a14_distinct_values(spark, sf_dir):
    return P.distinct_values(V.untyped_orders(spark, sf_dir), _A14_COLS)


_ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
                "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@register("a15_column_info", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, "
    + (f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value"
       if t in ("bigint", "double") else "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value")
    + " FROM orders" for c, t in _ORDER_TYPES.items()))
def a15_column_info(spark, sf_dir):
    return P.column_info(spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_ORDER_TYPES))


_A16_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("a16_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, "
    f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, "
    f"max({c}) AS max FROM lineitem" for c in _A16_COLS))
def a16_describe(spark, sf_dir):
    return P.describe(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _A16_COLS)


@register("a25_table_shape", "SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def a25_table_shape(spark, sf_dir):
    return P.table_shape(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


_P9_CANDS = ["id", "s_discount", "s_tax", "s_qty", "d_status", "d_bigqty"]


@register("p9_detect_decision_columns", S.with_(V.SCORED_SQL) + "SELECT column_name, 'few_values' AS reason FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT CAST({c} AS VARCHAR)) AS n FROM scored"
                               for c in _P9_CANDS) + ") t WHERE n <= 10")
def p9_detect_decision_columns(spark, sf_dir):
    return P.detect_decision_columns(V.scored(spark, sf_dir), V.TARGET)


@register("p10_detect_score_columns", S.with_(V.UNTYPED_ORDERS_SQL) + "SELECT column_name, 'numeric' AS reason FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NOT NULL AND "
                               f"TRY_CAST({c} AS DOUBLE) IS NULL) AS bad FROM untyped"
                               for c in _UC if c != "o_orderstatus") + ") t WHERE bad = 0")
def p10_detect_score_columns(spark, sf_dir):
    return P.detect_score_columns(V.untyped_orders(spark, sf_dir), "o_orderstatus")


@register("p11_infer_column_types", S.with_(V.UNTYPED_ORDERS_SQL) + """
SELECT column_name,
       CASE WHEN n > 0 AND n_num = n THEN 'numeric' WHEN n > 0 AND n_ts = n THEN 'datetime'
            WHEN n_distinct > 0 AND n_distinct <= 50 THEN 'categorical' ELSE 'problematic' END AS inferred_type,
       n_distinct
FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count(TRY_CAST({c} AS DOUBLE)) AS n_num, "
    f"count(TRY_CAST({c} AS TIMESTAMP)) AS n_ts, count(DISTINCT {c}) AS n_distinct FROM untyped" for c in _UC)
    + ") t")
def p11_infer_column_types(spark, sf_dir):
    return P.infer_column_types(V.untyped_orders(spark, sf_dir))


@register("m18_dataset_profile", "SELECT rows, 6 AS columns, column_name, dtype, non_null, rows - non_null AS missing, "
          "column_name = 'o_orderstatus' AS is_target FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS rows FROM orders"
              for c, t in _ORDER_TYPES.items()) + ") t")
def m18_dataset_profile(spark, sf_dir):
    return P.dataset_profile(spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_ORDER_TYPES), "o_orderstatus")


# --- P1, P6, P6b, A17, A17b, A18, M17, P12, P13: preparation --------------------------------------

from quorum.operators import prep as PR  # noqa: E402

_EV_NUM = ["value", "k", "hour", "value_lin"]
_EV_LEVELS = [str(i) for i in range(7)]


@register("p1_project_features", S.with_(V.EVENTS_X_SQL) + "SELECT value, k, hour, user_group, value_lin FROM events_x")
def p1_project_features(spark, sf_dir):
    return PR.project_features(V.events_x(spark, sf_dir), V.TARGET, excludes=[V.ID, "not_a_column"])


@register("p6_one_hot_drop_first", S.with_(V.EVENTS_X_SQL) + "SELECT value, k, hour, value_lin, " + ", ".join(
    f"CASE WHEN user_group = '{v}' THEN 1 ELSE 0 END AS user_group_{v}" for v in _EV_LEVELS[1:]) + " FROM events_x")
def p6_one_hot_drop_first(spark, sf_dir):
    feats = PR.project_features(V.events_x(spark, sf_dir), V.TARGET, excludes=[V.ID])
    return PR.one_hot_drop_first(feats)[0]


@register("p6b_one_hot_preview", """
SELECT CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(l.toxic AS DOUBLE) AS toxic, """
          + ", ".join([*(f"CASE WHEN d.lang = '{v}' THEN 1 ELSE 0 END AS lang_{v}" for v in ["en", "es", "fr"]),
                       *(f"CASE WHEN d.source = '{v}' THEN 1 ELSE 0 END AS source_{v}"
                         for v in sorted(f"src{i}" for i in range(20))[1:])]) + """
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def p6b_one_hot_preview(spark, sf_dir):
    return PR.one_hot_preview(V.docs_x(spark, sf_dir), V.TARGET, excludes=[V.ID])[0]


_LEVELS_SQL = """
levels AS (
  SELECT column_name, value, count(*) AS rows,
         dense_rank() OVER (PARTITION BY column_name ORDER BY value) - 1 AS level
  FROM (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value FROM orders
        UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
        UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders) v
  WHERE value IS NOT NULL GROUP BY column_name, value),
dictionary AS (
  SELECT column_name, value, rows, level,
         CASE WHEN level > 0 THEN level - 1 + CASE column_name WHEN 'o_orderpriority' THEN 0
           WHEN 'o_custkey' THEN (SELECT count(*) - 1 FROM levels WHERE column_name = 'o_orderpriority')
           ELSE (SELECT count(*) - 2 FROM levels WHERE column_name <> 'o_orderstatus') END END AS index
  FROM levels)"""
_LEVEL_COLS = ["o_orderpriority", "o_custkey", "o_orderstatus"]


@register("p6s_level_dictionary", "WITH " + _LEVELS_SQL + " SELECT * FROM dictionary")
def p6s_level_dictionary(spark, sf_dir):
    return PR.level_dictionary(spark.read.parquet(f"{sf_dir}/orders.parquet"), _LEVEL_COLS)


@register("p6s_one_hot_sparse", "WITH " + _LEVELS_SQL + """
SELECT o_orderkey, (SELECT max(index) + 1 FROM dictionary) AS size, list_sort([x FOR x IN [p.index, c.index, s.index] IF x IS NOT NULL]) AS indices
FROM orders o LEFT JOIN dictionary p ON p.column_name = 'o_orderpriority' AND p.value = o_orderpriority
LEFT JOIN dictionary c ON c.column_name = 'o_custkey' AND c.value = CAST(o_custkey AS VARCHAR)
LEFT JOIN dictionary s ON s.column_name = 'o_orderstatus' AND s.value = o_orderstatus""")
def p6s_one_hot_sparse(spark, sf_dir):
    return PR.one_hot_sparse(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", _LEVEL_COLS)


def _variance_sql(fn: str, threshold: float) -> str:
    return S.with_(V.EVENTS_X_SQL) + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {fn}({c}) AS variance, coalesce({fn}({c}) > {threshold!r}::DOUBLE, false) AS kept "
        f"FROM events_x" for c in _EV_NUM)


@register("a17_variance_filter", _variance_sql("var_pop", 0.01))
def a17_variance_filter(spark, sf_dir):
    return PR.variance_filter(V.events_x(spark, sf_dir), _EV_NUM, 0.01, population=True)


@register("a17b_variance_filter_preview", _variance_sql("var_samp", 0.01))
def a17b_variance_filter_preview(spark, sf_dir):
    return PR.variance_filter(V.events_x(spark, sf_dir), _EV_NUM, 0.01, population=False)


def _corr_sql(a: str, b: str) -> str:
    return (f"abs(covar_pop({a}, {b}) / CASE WHEN stddev_pop({a}) * stddev_pop({b}) <> 0 "
            f"THEN stddev_pop({a}) * stddev_pop({b}) END)")


@register("a18_correlation_filter", S.with_(V.EVENTS_X_SQL, "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{_EV_NUM[j]}' AS feature_j, {_corr_sql(_EV_NUM[i], _EV_NUM[j])} AS r FROM events_x"
    for j in range(len(_EV_NUM)) for i in range(j)) + ")") + """
SELECT f.feature, f.position, max(p.r) AS max_abs_corr_earlier, coalesce(count(*) FILTER (WHERE p.r > 0.95), 0) = 0 AS kept
FROM (VALUES """ + ", ".join(f"('{c}', {k})" for k, c in enumerate(_EV_NUM)) + """) f(feature, position)
LEFT JOIN pairs p ON p.feature_j = f.feature
GROUP BY f.feature, f.position""")
def a18_correlation_filter(spark, sf_dir):
    return PR.correlation_filter(V.events_x(spark, sf_dir), _EV_NUM, 0.95)


def _m17_sql(var_threshold: float = 0.01, corr_threshold: float = 0.95) -> str:
    feats = _EV_NUM + [f"user_group_{v}" for v in _EV_LEVELS[1:]]
    enc = ("enc AS (SELECT value, k, hour, value_lin, " + ", ".join(
        f"CASE WHEN user_group = '{v}' THEN 1 ELSE 0 END AS user_group_{v}" for v in _EV_LEVELS[1:])
        + " FROM events_x)")
    var = "v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS f, {i} AS pos, var_samp({c}) AS var FROM enc"
                                        for i, c in enumerate(feats)) + ")"
    pairs = "pairs AS (" + " UNION ALL ".join(
        f"SELECT '{feats[i]}' AS fi, '{feats[j]}' AS fj, {_corr_sql(feats[i], feats[j])} AS r FROM enc"
        for j in range(len(feats)) for i in range(j)) + ")"
    return S.with_(V.EVENTS_X_SQL, enc, var, pairs,
                   f"kept AS (SELECT * FROM v WHERE coalesce(var > {var_threshold!r}::DOUBLE, false))",
                   f"dropped AS (SELECT DISTINCT p.fj AS f FROM pairs p JOIN kept a ON p.fi = a.f "
                   f"JOIN kept b ON p.fj = b.f WHERE p.r > {corr_threshold!r}::DOUBLE)",
                   "final AS (SELECT * FROM kept WHERE f NOT IN (SELECT f FROM dropped))") + f"""
SELECT 5 AS original_features, {len(feats)} AS after_one_hot,
       CAST({len(feats)} - (SELECT count(*) FROM kept) AS INTEGER) AS removed_by_variance,
       CAST((SELECT count(*) FROM kept) - (SELECT count(*) FROM final) AS INTEGER) AS removed_by_correlation,
       CAST((SELECT count(*) FROM final) AS INTEGER) AS final_features,
       (SELECT list(f ORDER BY pos) FROM final) AS final_names"""


@register("m17_feature_selection_report", _m17_sql())
def m17_feature_selection_report(spark, sf_dir):
    return PR.feature_selection_report(V.events_x(spark, sf_dir), V.TARGET, [V.ID], 0.01, 0.95)


@register("p12_coerce_numeric", S.with_(*_DEC_CTES) + """
SELECT model_name, split, threshold_type, threshold, precision, recall, f1_score, accuracy, cost,
       tp, fp, tn, fn, 'true' AS is_base_model, cost_total FROM (""" + S.decision_results_select(CFG, "base") + ") r")
def p12_coerce_numeric(spark, sf_dir):
    res = m8_decision_column_eval(spark, sf_dir)
    as_text = PR.stringify(res, res.columns)
    return PR.coerce_numeric(as_text, metric_cols=("threshold", "precision", "recall", "f1_score", "accuracy",
                                                   "cost", "cost_total"))


@register("p13_stringify", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS "
          "o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderstatus FROM orders")
def p13_stringify(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate",
                                                               "o_orderstatus")
    return PR.stringify(o, ["o_orderkey", "o_totalprice", "o_orderdate"])


# --- A19-A21: curves ----------------------------------------------------------------------------

from quorum.operators import curves as C  # noqa: E402


def _score_long(spark, sf_dir):
    lab = encode_target(V.scored(spark, sf_dir), V.TARGET, CFG.good_tag, CFG.bad_tag)
    return long_scores(lab, V.ID, _SC, keep=("label",))


_CURVE_CTES = [V.SCORED_SQL, "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS model_name, CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS score, label FROM scored"
    for c in _SC) + ")", """c AS (
  SELECT model_name, score, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg
  FROM long WHERE score IS NOT NULL GROUP BY model_name, score)""", """cum AS (
  SELECT *, CAST(sum(pos) OVER (PARTITION BY model_name ORDER BY score DESC) AS BIGINT) AS cum_pos,
            CAST(sum(neg) OVER (PARTITION BY model_name ORDER BY score DESC) AS BIGINT) AS cum_neg,
            CAST(sum(pos) OVER (PARTITION BY model_name) AS BIGINT) AS P,
            CAST(sum(neg) OVER (PARTITION BY model_name) AS BIGINT) AS N
  FROM c)"""]


@register("a19_roc_curve", S.with_(*_CURVE_CTES) + """
SELECT model_name, score, CASE WHEN N > 0 THEN cum_neg / N ELSE 0.0::DOUBLE END AS fpr,
       CASE WHEN P > 0 THEN cum_pos / P ELSE 0.0::DOUBLE END AS tpr FROM cum
UNION ALL SELECT DISTINCT model_name, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM cum""")
def a19_roc_curve(spark, sf_dir):
    return C.roc_curve(_score_long(spark, sf_dir))


@register("a19r_roc_curve_reduced", S.with_(*_CURVE_CTES) + """
SELECT model_name, score, CASE WHEN N > 0 THEN cum_neg / N ELSE 0.0::DOUBLE END AS fpr,
       CASE WHEN P > 0 THEN cum_pos / P ELSE 0.0::DOUBLE END AS tpr
FROM (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS place
      FROM cum WINDOW w AS (PARTITION BY model_name ORDER BY score DESC))
WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT DISTINCT model_name, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM cum""")
def a19r_roc_curve_reduced(spark, sf_dir):
    return C.roc_curve_reduced(_score_long(spark, sf_dir))


@register("a19b_roc_auc", S.with_(*_CURVE_CTES) + """
SELECT model_name, CASE WHEN 2.0::DOUBLE * P * N > 0 THEN
         CAST(sum(CAST(neg AS HUGEINT) * (2 * cum_pos - pos)) AS DOUBLE) / (2.0::DOUBLE * P * N) END AS roc_auc
FROM cum GROUP BY model_name, P, N""")
def a19b_roc_auc(spark, sf_dir):
    return C.roc_auc(_score_long(spark, sf_dir))


_PR_POINTS = """pr AS (
  SELECT model_name, score, pos, P,
         CASE WHEN cum_pos + cum_neg > 0 THEN cum_pos / (cum_pos + cum_neg) ELSE 0.0::DOUBLE END AS precision,
         CASE WHEN P > 0 THEN cum_pos / P ELSE 1.0::DOUBLE END AS recall,
         CASE WHEN (cum_pos - pos) + cum_neg - neg > 0 THEN (cum_pos - pos) / ((cum_pos - pos) + cum_neg - neg)
              ELSE 1.0::DOUBLE END AS prev_precision
  FROM cum)"""


@register("a20_pr_curve", S.with_(*_CURVE_CTES, _PR_POINTS) + """
SELECT model_name, score, precision, recall FROM pr
UNION ALL SELECT DISTINCT model_name, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM pr""")
def a20_pr_curve(spark, sf_dir):
    return C.pr_curve(_score_long(spark, sf_dir))


@register("a20b_pr_auc", S.with_(*_CURVE_CTES, _PR_POINTS) + """
SELECT model_name, sum(CASE WHEN P > 0 THEN pos / P ELSE 0.0::DOUBLE END * (precision + prev_precision) / 2) AS pr_auc
FROM pr GROUP BY model_name""")
def a20b_pr_auc(spark, sf_dir):
    return C.pr_auc(_score_long(spark, sf_dir))


@register("a21_score_histogram", S.with_(*_CURVE_CTES[:2]) + """
SELECT model_name, CAST(least(greatest(floor(score * 50), 0), 49) AS INTEGER) AS bin, count(*) AS count,
       CAST(least(greatest(floor(score * 50), 0), 49) AS INTEGER) / 50.0::DOUBLE AS bin_start
FROM long WHERE score IS NOT NULL GROUP BY 1, 2""")
def a21_score_histogram(spark, sf_dir):
    return C.score_histogram(_score_long(spark, sf_dir))


# --- U1-U4, P8, P14-P18, P21-P23, M12-M15, W4, O4, O5, A22-A24, J7, J9: results and reports ------

from quorum.functions.labels import normalise_model_name  # noqa: E402
from quorum.functions.metrics import RESULT_COLUMNS  # noqa: E402
from quorum.operators import report as RP  # noqa: E402

_RCOLS = RESULT_COLUMNS + ["cost_total"]
_RSEL = ", ".join(_RCOLS)
_META_MODELS = list(_SC)
RESULTS_SQL = "results AS (" + " UNION ALL ".join(
    f"SELECT {_RSEL} FROM ({q}) q{i}" for i, q in enumerate([
        S.score_eval_sql(CFG, _SC),
        ORACLES["a4_best_threshold"],
        ORACLES["m8_decision_column_eval"],
        ORACLES["b9_combined_runs"]])) + ")"
SWEEP_AVG_SQL = "sweep_avg AS (" + ORACLES["a6_average_fold_sweep"] + ")"


_STORED: dict[tuple, str] = {}  # (application, table, input folder) -> where this session has written it


def _stored(spark, sf_dir, name, build) -> DataFrame:
    """A derived table, written to the shared folder when the session first needs it and read from then on."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _STORED:
        path = _scratch(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def results_table(spark, sf_dir) -> DataFrame:
    """The stored results of one run, which the report queries read."""
    return _stored(spark, sf_dir, "results", all_results)


def all_results(spark, sf_dir) -> DataFrame:
    """U1 over this build's result families: k-fold averages, fold bests, decisions, combined rules.
    The k-fold averages and the fold bests come from one sweep, written once: else each ranks all rows."""
    m7 = score_column_eval(V.scored(spark, sf_dir), CFG, V.ID, V.TARGET, V.SCORE_COLUMNS).stored()
    return RP.union_runs(m7.results, m7.fold_results,
                         m8_decision_column_eval(spark, sf_dir), b9_combined_runs(spark, sf_dir)).select(*_RCOLS)


@register("u1_union_runs", S.with_(RESULTS_SQL) + "SELECT * FROM results")
def u1_union_runs(spark, sf_dir):
    return all_results(spark, sf_dir)


@register("p8_filter_results", S.with_(RESULTS_SQL) + "SELECT * FROM results WHERE split = 'Full' AND "
          "threshold_type = 'cost' AND model_name IN ('kfold_avg_s_tax', 'kfold_avg_s_qty')")
def p8_filter_results(spark, sf_dir):
    return RP.filter_results(results_table(spark, sf_dir), "Full", "cost", ["kfold_avg_s_tax", "kfold_avg_s_qty"])


@register("p14_normalise_model_name", S.with_(RESULTS_SQL) +
          "SELECT DISTINCT model_name, replace(model_name, 'kfold_avg_', '') AS base_name FROM results")
def p14_normalise_model_name(spark, sf_dir):
    return results_table(spark, sf_dir).select("model_name", normalise_model_name("model_name").alias("base_name")) \
        .distinct()


@register("p15_display_label", S.with_(RESULTS_SQL) + "SELECT model_name, split, threshold_type, threshold, "
          "CASE WHEN threshold IS NULL THEN model_name ELSE printf('%s (τ=%.2f)', model_name, threshold) END AS label "
          "FROM results")
def p15_display_label(spark, sf_dir):
    return RP.with_display_label(results_table(spark, sf_dir)).select(
        "model_name", "split", "threshold_type", "threshold", "label")


@register("p16_melt_metrics", S.with_(RESULTS_SQL) + " UNION ALL ".join(
    f"SELECT model_name, split, threshold_type, '{m}' AS metric, {m} AS score FROM results" for m in RP.METRICS))
def p16_melt_metrics(spark, sf_dir):
    return RP.melt_metrics(results_table(spark, sf_dir))


@register("p17_round_threshold", S.with_(RESULTS_SQL) +
          "SELECT model_name, threshold_type, round(threshold, 4) AS threshold FROM results")
def p17_round_threshold(spark, sf_dir):
    return results_table(spark, sf_dir).select("model_name", "threshold_type", F.round("threshold", 4).alias("threshold"))


@register("p17b_cost_view", S.with_(RESULTS_SQL) + "SELECT threshold_type, model_name, cost FROM results "
          "WHERE split = 'Full'")
def p17b_cost_view(spark, sf_dir):
    return RP.filter_results(results_table(spark, sf_dir), "Full").select("threshold_type", "model_name", "cost")


@register("p18_confusion_view", S.with_(RESULTS_SQL) +
          "SELECT model_name, split, threshold_type, tp, fp, tn, fn, tp + fp + tn + fn AS total_samples FROM results")
def p18_confusion_view(spark, sf_dir):
    return RP.confusion_view(results_table(spark, sf_dir))


@register("p21_sweep_projection", S.with_(SWEEP_AVG_SQL) + "SELECT model_name, 'costs' AS data_type, "
          "list(threshold ORDER BY threshold) AS thresholds, list(cost ORDER BY threshold) AS values "
          "FROM sweep_avg GROUP BY model_name")
def p21_sweep_projection(spark, sf_dir):
    return RP.sweep_projection(a6_average_fold_sweep(spark, sf_dir), "costs")


@register("p22_radar_projection", S.with_(RESULTS_SQL) +
          "SELECT model_name, split, threshold_type, [accuracy, precision, recall, f1_score] AS metrics FROM results")
def p22_radar_projection(spark, sf_dir):
    return RP.radar_projection(results_table(spark, sf_dir))


@register("p23_confusion_layout", S.with_(RESULTS_SQL) + " UNION ALL ".join(
    f"SELECT model_name, split, threshold_type, {a} AS actual, {p} AS predicted, {c} AS n FROM results"
    for a, p, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]))
def p23_confusion_layout(spark, sf_dir):
    return RP.confusion_layout(results_table(spark, sf_dir))


def _first_match_sql(split: str, ttype: str) -> str:
    return f"""fm AS (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY
              CASE WHEN threshold_type = '{ttype}' THEN 0 ELSE 1 END, threshold_type) AS r
  FROM results WHERE split = '{split}' AND (threshold_type = '{ttype}' OR is_base_model))"""


@register("w4_first_match", S.with_(RESULTS_SQL, _first_match_sql("Full", "accuracy")) +
          f"SELECT {_RSEL} FROM fm WHERE r = 1")
def w4_first_match(spark, sf_dir):
    return RP.first_match(results_table(spark, sf_dir), "Full", "accuracy").select(*_RCOLS)


@register("m12_model_comparison", S.with_(RESULTS_SQL, _first_match_sql("Full", "cost")) + """
SELECT model_name, coalesce(precision, 0.0::DOUBLE) AS precision, coalesce(recall, 0.0::DOUBLE) AS recall,
       coalesce(f1_score, 0.0::DOUBLE) AS f1_score, coalesce(accuracy, 0.0::DOUBLE) AS accuracy,
       coalesce(cost, 0.0::DOUBLE) AS cost, threshold, 'Full' AS split_name, 'cost' AS threshold_type
FROM fm WHERE r = 1""")
def m12_model_comparison(spark, sf_dir):
    return RP.model_comparison(results_table(spark, sf_dir), "cost", "full")


_SERIES = ["threshold", "precision", "recall", "f1_score", "accuracy", "cost"]


@register("m13_sweep_series", S.with_(SWEEP_AVG_SQL, """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY cost, threshold) AS rc,
            row_number() OVER (PARTITION BY model_name ORDER BY tp + tn DESC, threshold) AS ra FROM sweep_avg)""") +
          "SELECT model_name, " + ", ".join(f"list({f} ORDER BY threshold) AS {f}" for f in _SERIES) +
          ", max(threshold) FILTER (WHERE rc = 1) AS cost_optimal_threshold, "
          "max(threshold) FILTER (WHERE ra = 1) AS accuracy_optimal_threshold FROM ranked GROUP BY model_name")
def m13_sweep_series(spark, sf_dir):
    return RP.sweep_series(a6_average_fold_sweep(spark, sf_dir))


def _report_sql() -> str:
    metas = ", ".join(f"'{m}'" for m in _META_MODELS)
    cols = ("model_name, split, threshold_type, round(accuracy, 1) AS accuracy, round(precision, 1) AS precision, "
            "round(recall, 1) AS recall, round(threshold, 3) AS threshold, cost, tp, fp, tn, fn")
    norm = "replace(model_name, 'kfold_avg_', '')"
    return S.with_(RESULTS_SQL) + f"""
SELECT 'meta' AS section, {cols} FROM results WHERE {norm} IN ({metas}) AND split IN ('Train', 'Test', 'Full')
  AND threshold_type IN ('cost', 'accuracy')
UNION ALL SELECT 'base', {cols} FROM results WHERE {norm} NOT IN ({metas}) AND split IN ('Train', 'Test', 'Full')
  AND threshold_type = 'base'
UNION ALL SELECT 'kfold', {cols} FROM results WHERE starts_with(model_name, 'kfold_avg_')"""


@register("m14_performance_report", _report_sql())
def m14_performance_report(spark, sf_dir):
    return RP.performance_report(results_table(spark, sf_dir), _META_MODELS)


@register("m15_sweep_compare", S.with_(SWEEP_AVG_SQL) + " UNION ALL ".join(
    f"SELECT model_name, threshold, '{m}' AS metric, {m} AS value FROM sweep_avg "
    f"WHERE model_name IN ('kfold_avg_s_discount', 'kfold_avg_s_qty')" for m in ["cost", "accuracy", "f1_score"]))
def m15_sweep_compare(spark, sf_dir):
    return RP.sweep_compare(a6_average_fold_sweep(spark, sf_dir), ["kfold_avg_s_discount", "kfold_avg_s_qty"])


@register("o4_head", S.with_(V.SCORED_SQL) + "SELECT id, gt_label, s_discount, s_tax, s_qty, d_status, d_bigqty "
          "FROM scored ORDER BY id LIMIT 5")
def o4_head(spark, sf_dir):
    return V.scored(spark, sf_dir).orderBy(V.ID).limit(5)


@register("o5_sorted_thresholds", S.with_(*_M7_CTES) + "SELECT DISTINCT threshold FROM sweep")
def o5_sorted_thresholds(spark, sf_dir):
    return a3_threshold_sweep(spark, sf_dir).select("threshold").distinct().orderBy("threshold")


@register("u2_except_models", S.with_(RESULTS_SQL) + "SELECT DISTINCT model_name FROM results WHERE "
          "replace(model_name, 'kfold_avg_', '') NOT IN (" + ", ".join(f"'{m}'" for m in _META_MODELS) + ")")
def u2_except_models(spark, sf_dir):
    return RP.except_models(results_table(spark, sf_dir), _META_MODELS)


@register("u3_union_keys", S.with_(*_M7_CTES) + "SELECT DISTINCT model_name, threshold FROM sweep")
def u3_union_keys(spark, sf_dir):
    """The keys of the folds' sweeps together: the sweep has the fold as a column, so the union is its distinct."""
    return a3_threshold_sweep(spark, sf_dir).select("model_name", "threshold").distinct()


@register("u4_subset_test", ORACLES["p20_classify_model_kind"].replace(
    "CASE WHEN count(s) > 0 AND bool_and(coalesce(s IN (0.0, 1.0), true)) THEN 'decision' ELSE 'meta' END\n       AS model_kind",
    "coalesce(bool_and(s IN (0.0, 1.0)), true) AS is_subset"))
def u4_subset_test(spark, sf_dir):
    preds = base_predictions(V.scored(spark, sf_dir), CFG, V.ID, _SC, _DC)
    s = M.nan_to_null("score")
    return preds.groupBy("model_name").agg(F.coalesce(F.bool_and(s.isin(0.0, 1.0)), F.lit(True)).alias("is_subset"))


@register("a22_group_by_model", S.with_(RESULTS_SQL) + "SELECT model_name, count(*) AS n_records, " + ", ".join(
    f"list({f} ORDER BY split, threshold_type, threshold NULLS FIRST) AS {f}s"
    for f in ["split", "threshold_type", "threshold", "accuracy", "cost", "tp", "fp", "tn", "fn"])
    + " FROM results GROUP BY model_name")
def a22_group_by_model(spark, sf_dir):
    return RP.group_by_model(results_table(spark, sf_dir))


@register("a23_log_loss", S.with_(V.SCORED_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS model_name, avg(-(label * ln(greatest(least({c}, 1 - 1e-15), 1e-15)) + (1 - label) * "
    f"ln(1 - greatest(least({c}, 1 - 1e-15), 1e-15)))) AS log_loss FROM scored" for c in _SC))
def a23_log_loss(spark, sf_dir):
    return _log_losses(V.scored(spark, sf_dir), _SC)


def _log_losses(df, cols):
    """Mean log loss of each column against the target, in one aggregate."""
    lab = encode_target(df, V.TARGET, CFG.good_tag, CFG.bad_tag)
    return lab.agg(*[F.avg(M.log_loss_expr("label", c)).alias(c) for c in cols]).unpivot([], cols, "model_name", "log_loss")


# the same operators where numbers are missing (NULL and NaN); the oracles only know NULL and filter it themselves
_N_CTES = (V.EVENTS_X_SQL, V.EVENTS_N_SQL)
_N_TYPES = {V.ID: "string", V.TARGET: "string", **{c: "double" for c in V.EVENTS_N_COLUMNS}}


@register("a15n_column_info_missing", S.with_(*_N_CTES) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'double' AS dtype, count(*) FILTER (WHERE {c} IS NOT NULL) AS non_null, "
    f"min({c}) AS min_value, max({c}) AS max_value FROM events_n" for c in V.EVENTS_N_COLUMNS))
def a15n_column_info_missing(spark, sf_dir):
    return P.column_info(V.events_n(spark, sf_dir), V.EVENTS_N_COLUMNS)


@register("a16n_describe_missing", S.with_(*_N_CTES) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, "
    f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, "
    f"max({c}) AS max FROM events_n WHERE {c} IS NOT NULL" for c in V.EVENTS_N_COLUMNS))
def a16n_describe_missing(spark, sf_dir):
    return P.describe(V.events_n(spark, sf_dir), V.EVENTS_N_COLUMNS)


def _variance_n_sql(fn: str) -> str:
    return S.with_(*_N_CTES) + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, v AS variance, coalesce(v > 0.01::DOUBLE, false) AS kept "
        f"FROM (SELECT {fn}({c}) AS v FROM events_n WHERE {c} IS NOT NULL)" for c in V.EVENTS_N_COLUMNS)


@register("a17n_variance_filter_missing", _variance_n_sql("var_pop"))
def a17n_variance_filter_missing(spark, sf_dir):
    return PR.variance_filter(V.events_n(spark, sf_dir), V.EVENTS_N_COLUMNS, 0.01)


@register("a17bn_variance_preview_missing", _variance_n_sql("var_samp"))
def a17bn_variance_preview_missing(spark, sf_dir):
    return PR.variance_filter(V.events_n(spark, sf_dir), V.EVENTS_N_COLUMNS, 0.01, population=False)


_N_VARYING = [c for c in V.EVENTS_N_COLUMNS if c not in ("four", "never")]  # no other column has a correlation


@register("a18n_correlation_filter_missing", S.with_(*_N_CTES, "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{b}' AS feature_j, abs(corr({a}, {b})) AS r FROM events_n WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for j, b in enumerate(_N_VARYING) for a in _N_VARYING[:j]) + ")") + """
SELECT f.feature, f.position, max(p.r) AS max_abs_corr_earlier, coalesce(count(*) FILTER (WHERE p.r > 0.95), 0) = 0 AS kept
FROM (VALUES """ + ", ".join(f"('{c}', {k})" for k, c in enumerate(V.EVENTS_N_COLUMNS)) + """) f(feature, position)
LEFT JOIN pairs p ON p.feature_j = f.feature
GROUP BY f.feature, f.position""")
def a18n_correlation_filter_missing(spark, sf_dir):
    return PR.correlation_filter(V.events_n(spark, sf_dir), V.EVENTS_N_COLUMNS, 0.95)


@register("a23n_log_loss_missing", S.with_(*_N_CTES) + """
SELECT 'p' AS model_name, avg(CASE WHEN label = 1 THEN -ln(greatest(least(p, 1 - 1e-15), 1e-15))
                              ELSE -ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END) AS log_loss
FROM events_n WHERE p IS NOT NULL""")
def a23n_log_loss_missing(spark, sf_dir):
    return _log_losses(V.events_n(spark, sf_dir), ["p"])


@register("m18n_dataset_profile_missing", S.with_(*_N_CTES) + f"SELECT rows, {len(_N_TYPES)} AS columns, column_name, dtype, "
          "non_null, rows - non_null AS missing, column_name = 'gt_label' AS is_target FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS rows FROM events_n"
              for c, t in _N_TYPES.items()) + ") t")
def m18n_dataset_profile_missing(spark, sf_dir):
    return P.dataset_profile(V.events_n(spark, sf_dir), V.TARGET)


@register("a24_store_summary", S.with_(RESULTS_SQL, V.SCORED_SQL) + """
SELECT 'results' AS dataset, count(*) AS rows, list(DISTINCT model_name ORDER BY model_name) AS models FROM results
UNION ALL
SELECT 'predictions', count(*) * 5, ['d_bigqty', 'd_status', 'kfold_avg_s_discount', 'kfold_avg_s_qty', 'kfold_avg_s_tax']
FROM scored""")
def a24_store_summary(spark, sf_dir):
    preds = base_predictions(V.scored(spark, sf_dir), CFG, V.ID, _SC, _DC)
    return RP.store_summary({"results": results_table(spark, sf_dir), "predictions": preds})


@register("j7_metrics_scores_join", S.with_(RESULTS_SQL, V.SCORED_SQL) + f"""
SELECT r.*, p.n_predictions, p.n_kinds FROM results r LEFT JOIN (
  SELECT m AS model_name, count(*) AS n_predictions, CAST(1 AS BIGINT) AS n_kinds FROM scored,
  (VALUES ('d_bigqty'), ('d_status'), ('kfold_avg_s_discount'), ('kfold_avg_s_qty'), ('kfold_avg_s_tax')) v(m)
  GROUP BY m) p ON r.model_name = p.model_name""")
def j7_metrics_scores_join(spark, sf_dir):
    preds = base_predictions(V.scored(spark, sf_dir), CFG, V.ID, _SC, _DC)
    return RP.metrics_scores_join(results_table(spark, sf_dir), preds)


@register("j9_tag_membership", S.with_(RESULTS_SQL, V.SCORED_SQL) + """
SELECT * FROM results WHERE model_name IN (SELECT 'kfold_avg_' || m FROM (VALUES ('s_discount'), ('s_tax'), ('s_qty')) v(m)
                                           UNION ALL SELECT 'd_status' UNION ALL SELECT 'd_bigqty')""")
def j9_tag_membership(spark, sf_dir):
    preds = base_predictions(V.scored(spark, sf_dir), CFG, V.ID, _SC, _DC)
    return results_table(spark, sf_dir).join(preds.select("model_name").distinct(), "model_name", "left_semi")


# --- W3, O1-O3, J6: importance tables -------------------------------------------------------------

from quorum.operators.importance import univariate_importance  # noqa: E402

_IMP_NUM = ["value", "k", "hour"]
_IMP_FEATS = _IMP_NUM + [f"user_group_{v}" for v in _EV_LEVELS[1:]]


def _encoded_events(spark, sf_dir):
    ev = encode_target(V.events_x(spark, sf_dir), V.TARGET, CFG.good_tag, CFG.bad_tag)
    return PR.one_hot_drop_first(ev.drop("value_lin"), ["user_group"])[0]


def _importances(spark, sf_dir):
    enc = _encoded_events(spark, sf_dir)
    return {"corr": univariate_importance(enc, _IMP_FEATS, "label", "corr"),
            "covar": univariate_importance(enc, _IMP_NUM, "label", "covar")}


_ENC_EVENTS_SQL = ("enc AS (SELECT *, CASE WHEN gt_label = 'Bad' THEN 1 ELSE 0 END AS label, " + ", ".join(
    f"CASE WHEN user_group = '{v}' THEN 1 ELSE 0 END AS user_group_{v}" for v in _EV_LEVELS[1:]) + " FROM events_x)")
_IMP_SQL = [V.EVENTS_X_SQL, _ENC_EVENTS_SQL, "imp_corr AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_corr_sql(c, 'label')} AS importance, {i} AS position FROM enc"
    for i, c in enumerate(_IMP_FEATS)) + ")", "imp_covar AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(covar_pop({c}, label)) AS importance, {i} AS position FROM enc"
    for i, c in enumerate(_IMP_NUM)) + ")"]


@register("w3_importance_rank", S.with_(*_IMP_SQL) + "SELECT feature, importance, position, "
          "row_number() OVER (ORDER BY importance DESC, position, feature) AS rank FROM imp_corr")
def w3_importance_rank(spark, sf_dir):
    return RP.importance_rank(_importances(spark, sf_dir)["corr"])


@register("o1_sort_importance", S.with_(*_IMP_SQL) + "SELECT feature, importance FROM imp_corr "
          "ORDER BY importance DESC")
def o1_sort_importance(spark, sf_dir):
    return _importances(spark, sf_dir)["corr"].select("feature", "importance").orderBy(F.desc("importance"))


_OUTER_SQL = ("SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.importance, 0.0::DOUBLE) AS corr, "
              "coalesce(b.importance, 0.0::DOUBLE) AS covar FROM imp_corr a FULL OUTER JOIN imp_covar b "
              "ON a.feature = b.feature")


@register("j6_importance_outer", S.with_(*_IMP_SQL) + _OUTER_SQL)
def j6_importance_outer(spark, sf_dir):
    return RP.importance_outer(_importances(spark, sf_dir))


@register("o2_importance_diff", S.with_(*_IMP_SQL) + "SELECT feature, corr, covar, corr - covar AS difference FROM ("
          + _OUTER_SQL + ") j")
def o2_importance_diff(spark, sf_dir):
    return RP.importance_diff(_importances(spark, sf_dir))


@register("o3_topk_features", S.with_(*_IMP_SQL, """rk AS (
  SELECT 'corr' AS m, feature, row_number() OVER (ORDER BY importance DESC, position, feature) AS rank FROM imp_corr
  UNION ALL
  SELECT 'covar', feature, row_number() OVER (ORDER BY importance DESC, position, feature) FROM imp_covar)""") + """
SELECT r.rank, coalesce(a.feature, 'N/A') AS corr, coalesce(b.feature, 'N/A') AS covar
FROM range(1, 6) r(rank) LEFT JOIN rk a ON a.m = 'corr' AND a.rank = r.rank
LEFT JOIN rk b ON b.m = 'covar' AND b.rank = r.rank""")
def o3_topk_features(spark, sf_dir):
    return RP.topk_features(_importances(spark, sf_dir), 5)


# --- J8, M3: neighbours and oversampling -----------------------------------------------------------

from quorum.operators.neighbours import knn_join, smote  # noqa: E402


@register("j8_knn_join", """
SELECT qid, rid, distance, rank FROM (
  SELECT CAST(a.vec_id AS VARCHAR) AS qid, CAST(b.vec_id AS VARCHAR) AS rid,
         list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]),
                            CAST(b.embedding AS DOUBLE[])), CAST(b.vec_id AS VARCHAR)) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) t
WHERE rank <= 5""")
def j8_knn_join(spark, sf_dir):
    vec = V.vectors(spark, sf_dir)
    return knn_join(vec, vec, 5, V.ID, "embedding", exclude_self=True)


@register("j8p_knn_join_pruned", ORACLES["j8_knn_join"])
def j8p_knn_join_pruned(spark, sf_dir):
    """J8 over many small tiles, most of which are pruned where the vectors cluster."""
    vec = V.vectors(spark, sf_dir)
    return knn_join(vec, vec, 5, V.ID, "embedding", exclude_self=True, tile_rows=256)


def _draw_sql(i: int) -> str:
    return f"('0x' || substr(md5(concat_ws(':', n, '{CFG.seed}', {i})), 1, 13))::BIGINT"


@register("m3_smote", f"""
WITH m AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS x,
         row_number() OVER (ORDER BY md5(concat_ws(':', vec_id, '{CFG.seed}')), CAST(vec_id AS VARCHAR)) AS idx
  FROM embeddings WHERE label = 0),
s AS (SELECT count(*) FILTER (WHERE label = 0) AS n_min, count(*) FILTER (WHERE label <> 0) AS n_maj FROM embeddings),
nn AS (
  SELECT a.id, b.x AS nx, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS nn_rank
  FROM m a JOIN m b ON a.id <> b.id),
d AS (
  SELECT n, {_draw_sql(0)} % n_min + 1 AS idx, {_draw_sql(1)} % least(5, n_min - 1) + 1 AS nn_rank, {_draw_sql(2)} / (1::BIGINT << 52)::DOUBLE AS lam
  FROM s, LATERAL (SELECT unnest(range(greatest(0, CAST(floor(0.5::DOUBLE * n_maj) AS BIGINT) - n_min))) AS n) r),
rows_of AS (SELECT n, x, nx, lam FROM d JOIN m USING (idx) JOIN nn ON nn.id = m.id AND nn.nn_rank = d.nn_rank)
SELECT 'smote-' || n AS id, 1 AS label, place, x[place + 1] + lam * (nx[place + 1] - x[place + 1]) AS value
FROM (SELECT *, unnest(range(len(x))) AS place FROM rows_of) t""")
def m3_smote(spark, sf_dir):
    """Every synthetic row, one value of its vector a row."""
    rows = smote(V.vectors(spark, sf_dir), V.ID, "label", "embedding", ratio=0.5, k=5, seed=CFG.seed)
    return rows.select(V.ID, "label", F.posexplode("embedding").alias("place", "value")).withColumn("place", F.col("place").cast("long"))


# --- M2, M4-M6, M9-M11, M16, S9, S10: models -----------------------------------------------------

import uuid  # noqa: E402
from concurrent.futures import ThreadPoolExecutor  # noqa: E402

from quorum.operators import forest as FO  # noqa: E402
from quorum.operators import models as ML  # noqa: E402
from quorum.operators.importance import model_importance  # noqa: E402
from quorum.session import cut_lineage, ensure_checkpoint_dir, spread  # noqa: E402
from quorum.sources import tables as IO  # noqa: E402

_LR = ML.ModelSpec("LogisticRegression", {"max_iter": 50, "C": 10.0}, CFG.seed)
_RF = ML.ModelSpec("RandomForest", {"n_estimators": 20, "max_depth": 5, "min_samples_leaf": 5}, CFG.seed)


def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quorum-io/{name}-{uuid.uuid4().hex}"


def _events_folded(spark, sf_dir):
    return stratified_kfold(_encoded_events(spark, sf_dir), V.ID, "label", CFG.n_splits, CFG.seed)


# one specification of each kind of model, small enough to fit often
_KINDS = {s.name: s for s in (
    ML.ModelSpec("XGBoost", {"n_estimators": 5, "max_depth": 3, "scale_pos_weight": 4.0}, CFG.seed),
    ML.ModelSpec("RandomForest", {"n_estimators": 10, "max_depth": 5, "class_weight": "balanced"}, CFG.seed),
    ML.ModelSpec("LogisticRegression", {"max_iter": 20, "C": 1.0}, CFG.seed),
    ML.ModelSpec("SVM", {"max_iter": 20, "C": 1.0}, CFG.seed),
    ML.ModelSpec("MLP", {"hidden_layer_sizes": [8], "max_iter": 20}, CFG.seed),
    ML.ModelSpec("KNN", {"n_neighbors": 5}, CFG.seed))}
_HOLDOUT_SQL = (V.EVENTS_X_SQL, f"""holdout AS (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', id, '{CFG.seed}')), id)
                    <= ceil({CFG.test_size!r}::DOUBLE * count(*) OVER (PARTITION BY label)) AS held
  FROM (SELECT id, CASE WHEN gt_label = 'Bad' THEN 1 ELSE 0 END AS label FROM events_x))""")


@register("m2_model_kinds", S.with_(*_HOLDOUT_SQL) + " UNION ALL ".join(
    f"SELECT '{n}' AS model_name, count(*) AS n_scored, count(*) AS n_in_range, sum(label) AS n_bad FROM holdout WHERE held"
    for n in _KINDS))
def m2_model_kinds(spark, sf_dir):
    """Every kind of model, with the class weights of its parameters, trained on one part and scored on the other."""
    enc = cut_lineage(stratified_split(_encoded_events(spark, sf_dir), V.ID, "label", CFG.test_size, CFG.seed))
    out = [ML.train_and_score(spec, enc.filter("split = 'Train'"), {"Test": enc.filter("split = 'Test'")}, _IMP_FEATS, V.ID)["Test"]
           .select(F.lit(name).alias("model_name"), "label", "score") for name, spec in _KINDS.items()]
    return RP.union_runs(*out).groupBy("model_name").agg(
        F.count("score").alias("n_scored"), F.count_if(F.col("score").between(0, 1)).alias("n_in_range"),
        F.sum(F.col("label").cast("long")).alias("n_bad"))


@register("m3_oversampled_counts", S.with_(V.EVENTS_X_SQL) + """
SELECT 1 AS label, CAST(greatest(n1, floor(0.5 * n0)) AS BIGINT) AS n FROM (
  SELECT count(*) FILTER (WHERE gt_label = 'Bad') AS n1, count(*) FILTER (WHERE gt_label <> 'Bad') AS n0 FROM events_x)
UNION ALL SELECT 0, count(*) FILTER (WHERE gt_label <> 'Bad') FROM events_x""")
def m3_oversampled_counts(spark, sf_dir):
    """Rows of each class after oversampling the training frame."""
    enc = _encoded_events(spark, sf_dir)
    return ML.oversample(enc, _IMP_FEATS, V.ID, 0.5, CFG.seed).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("m4_weights_of_models", S.with_(V.EVENTS_X_SQL) + """
SELECT 'XGBoost' AS model_name, label, CASE WHEN label = 1 THEN 4.0 ELSE 1.0 END::DOUBLE AS weight, n FROM c
UNION ALL SELECT 'RandomForest', label, sum(n) OVER () / (2.0::DOUBLE * n), n FROM c""".replace("FROM c", """FROM (
  SELECT CASE WHEN gt_label = 'Bad' THEN 1 ELSE 0 END AS label, count(*) AS n FROM events_x GROUP BY 1) c"""))
def m4_weights_of_models(spark, sf_dir):
    """The weights that the models' parameters put on the rows of each class."""
    enc = _encoded_events(spark, sf_dir)
    out = [ML.prepare_training(_KINDS[n], enc, _IMP_FEATS, V.ID, False, 0.5, CFG.seed).groupBy("label", "weight")
           .agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("model_name"), "label", "weight", "n")
           for n in ("XGBoost", "RandomForest")]
    return RP.union_runs(*out)


_N_BAGS = 10
_BAGS_SQL = (V.EVENTS_X_SQL, f"""bags AS (
  SELECT id, tree, label, {" + ".join(f"(h >= {c})::INT" for c in FO.bag_cuts())} AS n FROM (
    SELECT id, tree, CASE WHEN gt_label = 'Bad' THEN 1 ELSE 0 END AS label,
           ('0x' || substr(md5(concat_ws(':', id, '{CFG.seed}', tree)), 1, {FO.HASH_HEX}))::BIGINT AS h
    FROM events_x, range({_N_BAGS}) t(tree)) x)""")


@register("m4_bag_weights", S.with_(*_BAGS_SQL, "c AS (SELECT tree, label, sum(n) AS n_bag FROM bags GROUP BY ALL)") + """
SELECT CAST(tree AS INTEGER) AS tree, label, CAST(n_bag AS BIGINT) AS n_bag, sum(n_bag) OVER w / (count(*) OVER w * CAST(n_bag AS DOUBLE)) AS weight
FROM c WHERE n_bag > 0 WINDOW w AS (PARTITION BY tree)""")
def m4_bag_weights(spark, sf_dir):
    """Class weights of each bag of a forest."""
    return FO.bag_weights(_encoded_events(spark, sf_dir), _N_BAGS, CFG.seed, V.ID)


@register("m1_out_of_bag", S.with_(*_BAGS_SQL) + """
SELECT id, label, CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS n_out, count(*) FILTER (WHERE n = 0) > 0 AS scored
FROM bags GROUP BY id, label""")
def m1_out_of_bag(spark, sf_dir):
    """How many trees of a fitted forest vote on each row out of bag, and whether their score is a share."""
    spec = ML.ModelSpec("RandomForest", {"n_estimators": _N_BAGS, "max_depth": 5, "class_weight": "balanced_subsample",
                                         "oob_score": True}, CFG.seed)
    enc = cut_lineage(_encoded_events(spark, sf_dir).select(V.ID, "label", *_IMP_FEATS))
    return ML.fit(spec, enc, _IMP_FEATS, id_col=V.ID).out_of_bag(enc).select(
        V.ID, "label", "n_out", F.coalesce(F.col("oob_score").between(0, 1), F.lit(False)).alias("scored"))


@register("m2_train_and_score", None)
def m2_train_and_score(spark, sf_dir):
    enc = stratified_split(_encoded_events(spark, sf_dir), V.ID, "label", CFG.test_size, CFG.seed)
    out = ML.train_and_score(_LR, enc.filter("split = 'Train'"), {"Test": enc.filter("split = 'Test'")}, _IMP_FEATS,
                             V.ID)
    return out["Test"]


@register("m4_class_weights", S.with_(*_IMP_SQL[:2]) + "SELECT label, CAST(count(*) OVER () AS DOUBLE) / "
          "(2 * count(*) OVER (PARTITION BY label)) AS weight, id FROM enc")
def m4_class_weights(spark, sf_dir):
    return ML.class_weights(_encoded_events(spark, sf_dir)).select("label", "weight", V.ID)


@register("m5_hyperparam_search", None)
def m5_hyperparam_search(spark, sf_dir):
    space = {"C": [0.1, 1.0, 10.0], "max_iter": [20, 50]}
    return ML.hyperparam_search(_LR, _events_folded(spark, sf_dir), _IMP_FEATS, space, n_trials=3,
                                seed=CFG.seed, n_folds=CFG.n_splits, id_col=V.ID)[1]


@register("m5_trials_of_kinds", " UNION ALL ".join(
    f"SELECT '{n}' AS model_name, CAST(2 AS BIGINT) AS n_trials, CAST({v} AS BIGINT) AS n_valid FROM (SELECT count(*) FROM events)"
    for n, v in (("SVM", 2), ("RandomForest", 1))))
def m5_trials_of_kinds(spark, sf_dir):
    """Trials of a search and how many of them were valid; a depth beyond Spark's limit isn't."""
    spaces = {"SVM": {"C": [0.1, 10.0]}, "RandomForest": {"max_depth": [3, 50]}}
    folded_df = stratified_kfold(_encoded_events(spark, sf_dir), V.ID, "label", 2, CFG.seed)
    out = []
    for name, space in spaces.items():
        trials = ML.hyperparam_search(_KINDS[name], folded_df, _IMP_FEATS, space, n_trials=2, seed=CFG.seed, n_folds=2, id_col=V.ID)[1]
        out.append(trials.agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(F.col("neg_log_loss") > -10).alias("n_valid"))
                   .select(F.lit(name).alias("model_name"), "n_trials", "n_valid"))
    return RP.union_runs(*out)


@register("m6_fold_totals", S.with_(V.EVENTS_X_SQL) + """
SELECT 'kfold_avg_' || m AS model_name, t AS threshold_type, count(*) FILTER (WHERE gt_label = 'Bad') AS n_bad, count(*) AS n_rows
FROM events_x, (VALUES ('XGBoost'), ('LogisticRegression')) a(m), (VALUES ('cost'), ('accuracy')) b(t) GROUP BY ALL""")
def m6_fold_totals(spark, sf_dir):
    """Cross-validation with oversampling and class weights: every row is counted once, in its test fold."""
    specs = {n: _KINDS[n] for n in ("XGBoost", "LogisticRegression")}
    folded_df = stratified_kfold(_encoded_events(spark, sf_dir), V.ID, "label", 2, CFG.seed)
    cfg = EvalConfig(n_splits=2)
    res = ML.cv_evaluate(folded_df, specs, _IMP_FEATS, cfg, V.ID, use_smote=True)["results"]
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return res.select("model_name", "threshold_type", (F.col("tp") + F.col("fn")).cast("long").alias("n_bad"),
                      total.cast("long").alias("n_rows"))


@register("m6_cv_evaluate", None)
def m6_cv_evaluate(spark, sf_dir):
    cv = ML.cv_evaluate(_events_folded(spark, sf_dir), {"LogisticRegression": _LR, "RandomForest": _RF},
                        _IMP_FEATS, CFG, V.ID)
    return cv["results"]


@register("m9_final_model", None)
def m9_final_model(spark, sf_dir):
    return ML.final_model(_RF, _encoded_events(spark, sf_dir), _IMP_FEATS, CFG, V.ID)[1]


@register("m10_batch_predict", None)
def m10_batch_predict(spark, sf_dir):
    enc = _encoded_events(spark, sf_dir)
    path = _scratch(spark, "model")
    model = ML.fit(_LR, enc, _IMP_FEATS, id_col=V.ID)
    ML.save_model(model, path)
    contract = IO.feature_contract(enc, _IMP_FEATS, [f for f in _IMP_FEATS if f.startswith("user_group_")], V.ID)
    return ML.batch_predict(path, enc.select(V.ID, *_IMP_FEATS), contract)


@register("m11_feature_importance", None)
def m11_feature_importance(spark, sf_dir):
    model = ML.fit(_RF, _encoded_events(spark, sf_dir), _IMP_FEATS)
    return RP.importance_rank(model_importance(model.stages[-1], _IMP_FEATS, spark))


@register("s10_feature_contract", S.with_(*_IMP_SQL[:2], "first AS (SELECT * FROM enc ORDER BY id LIMIT 1)") +
          " UNION ALL ".join(
              f"SELECT {i} AS position, '{c}' AS name, 'f{i}' AS alias, "
              f"'{'double' if c in _IMP_NUM else 'int'}' AS dtype, {str(c.startswith('user_group_')).lower()} AS "
              f"is_encoded, CAST({c} AS VARCHAR) AS sample, '[]' AS filters FROM first"
              for i, c in enumerate(_IMP_FEATS)))
def s10_feature_contract(spark, sf_dir):
    enc = _encoded_events(spark, sf_dir)
    return IO.feature_contract(enc, _IMP_FEATS, [f for f in _IMP_FEATS if f.startswith("user_group_")], V.ID)


@register("m16_end_to_end", None)
def m16_end_to_end(spark, sf_dir):
    out = run_end_to_end(V.scored(spark, sf_dir), CFG, V.ID, V.TARGET, {"LogisticRegression": _LR}, score_cols=_SC,
                         decision_cols=_DC, rules=RULES, final_models=True, model_path=_scratch(spark, "final"))
    return out["results"]


# --- S1-S8, B10: scans, sinks and stores ------------------------------------------------------------

@register("s1_scan_table", "SELECT * FROM lineitem")
def s1_scan_table(spark, sf_dir):
    return IO.scan_table(spark, f"{sf_dir}/lineitem.parquet")


@register("s2_scan_sample", None)
def s2_scan_sample(spark, sf_dir):
    return IO.scan_sample(IO.scan_table(spark, f"{sf_dir}/orders.parquet"), 5)


@register("s2_sample_rows", "SELECT least(5, count(*)) AS n_rows, least(5, count(*)) AS n_known FROM orders")
def s2_sample_rows(spark, sf_dir):
    """The sample has as many rows as asked for, and all of them are rows of the table."""
    orders = IO.scan_table(spark, f"{sf_dir}/orders.parquet")
    sample = IO.scan_sample(orders, 5)
    known = orders.dropDuplicates().withColumn("_known", F.lit(1))
    return sample.join(known, list(orders.columns), "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count("_known").alias("n_known"))


@register("p5_split_dtypes", S.with_(V.EVENTS_X_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS kind, count({c}) AS non_null FROM events_x"
    for c, k in ((V.ID, "categorical"), (V.TARGET, "categorical"), ("value", "numeric"), ("k", "numeric"), ("hour", "numeric"),
                 ("user_group", "categorical"), ("value_lin", "numeric"))))
def p5_split_dtypes(spark, sf_dir):
    ev = V.events_x(spark, sf_dir)
    numeric, categorical = PR.split_dtypes(ev)
    kinds = F.create_map(*[F.lit(x) for c, k in [*((c, "numeric") for c in numeric), *((c, "categorical") for c in categorical)]
                           for x in (c, k)])
    counts = ev.agg(*[F.count(c).alias(c) for c in numeric + categorical]).unpivot([], numeric + categorical, "column_name", "non_null")
    return counts.select("column_name", kinds[F.col("column_name")].alias("kind"), "non_null")


@register("u5_intersect_columns", S.with_(V.EVENTS_X_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null FROM events_x" for c in ("hour", "value")))
def u5_intersect_columns(spark, sf_dir):
    """The names that a configured list and the table have in common, and no others."""
    ev = V.events_x(spark, sf_dir)
    common = PR.common_columns(ev, ["hour", "absent", "value", "Value"])
    return ev.agg(*[F.count(c).alias(c) for c in common]).unpivot([], common, "column_name", "non_null")


@register("s3_scan_untyped", ORACLES["p11_infer_column_types"])
def s3_scan_untyped(spark, sf_dir):
    path = _scratch(spark, "untyped")
    IO.sink_csv(V.untyped_orders(spark, sf_dir), path)
    return P.infer_column_types(IO.scan_untyped(spark, path))


_SCORED_SCHEMA = ("id string, gt_label string, s_discount double, s_tax double, s_qty double, d_status string, "
                  "d_bigqty string")


@register("s4_sink_csv", S.with_(V.SCORED_SQL) + "SELECT id, gt_label, s_discount, s_tax, s_qty, d_status, d_bigqty "
          "FROM scored")
def s4_sink_csv(spark, sf_dir):
    path = _scratch(spark, "scored-csv")
    IO.sink_csv(V.scored(spark, sf_dir), path)
    return IO.scan_table(spark, path, "csv", _SCORED_SCHEMA)


@register("s5_scan_result_csvs", S.with_(RESULTS_SQL) + f"""
SELECT *, tp + fp + tn + fn AS summary_samples, tp + fp + tn + fn AS total_samples,
       CASE WHEN model_name IN ({", ".join(f"'kfold_avg_{c}'" for c in _SC)}) THEN CAST({len(CFG.grid)} AS BIGINT) END AS n_thresholds
FROM results""")
def s5_scan_result_csvs(spark, sf_dir):
    base = _scratch(spark, "result-csvs")
    res = results_table(spark, sf_dir)
    for name, rows in IO.run_datasets(res).items():
        IO.sink_csv(rows, f"{base}/{name}")
    IO.sink_csv(_stored(spark, sf_dir, "sweep", a6_average_fold_sweep).select(
        "model_name", "threshold", "cost", "accuracy", "f1_score"), f"{base}/sweep")
    read = IO.scan_result_csvs(spark, base)
    counts = read["confusion_matrices"].select("model_name", "split", "threshold_type", "total_samples")
    sweeps = read["sweep"].groupBy("model_name").agg(F.count(F.lit(1)).alias("n_thresholds"))
    return read["model_summary"].withColumnRenamed("total_samples", "summary_samples") \
        .join(counts, ["model_name", "split", "threshold_type"]).join(sweeps, "model_name", "left").select(
            *_RCOLS, "summary_samples", "total_samples", "n_thresholds")


@register("s6_scan_sweep_json", S.with_(SWEEP_AVG_SQL) + "SELECT model_name, threshold, cost, accuracy, f1_score "
          "FROM sweep_avg")
def s6_scan_sweep_json(spark, sf_dir):
    path = _scratch(spark, "sweep-json")
    IO.write_sweep_json(a6_average_fold_sweep(spark, sf_dir), path)
    return IO.scan_sweep_json(spark, path)


@register("s7_scan_metrics_json", S.with_(RESULTS_SQL) + "SELECT * FROM results")
def s7_scan_metrics_json(spark, sf_dir):
    path = _scratch(spark, "metrics-json")
    IO.write_metrics_json(results_table(spark, sf_dir), path)
    return IO.scan_metrics_json(spark, path).select(*_RCOLS)


def _stored_run(spark, sf_dir):
    store = IO.ResultsStore(spark, _scratch(spark, "store"))
    df = V.scored(spark, sf_dir)
    base = RP.union_runs(m7_score_column_eval(spark, sf_dir), m8_decision_column_eval(spark, sf_dir))
    store.save_results("run1", cut_lineage(base.select(*_RCOLS)), predictions=base_predictions(df, CFG, V.ID, _SC, _DC),
                       labels=labels_of(df, CFG, V.ID, V.TARGET), sweep=_stored(spark, sf_dir, "sweep", a6_average_fold_sweep))
    return store


@register("s7_confusion_json", S.with_(RESULTS_SQL) + "SELECT model_name, split, threshold_type, tp, fp, tn, fn, "
          "tp + fp + tn + fn AS total_samples FROM results")
def s7_confusion_json(spark, sf_dir):
    path = _scratch(spark, "metrics-json")
    IO.write_metrics_json(results_table(spark, sf_dir), path)
    return IO.scan_metrics_json(spark, path, "confusion_matrices")


@register("p21_probabilities", S.with_(V.SCORED_SQL) + "SELECT 'kfold_avg_s_tax' AS model_name, id, s_tax AS score FROM scored")
def p21_probabilities(spark, sf_dir):
    return RP.sweep_projection(_stored(spark, sf_dir, "sweep", a6_average_fold_sweep), "probabilities", "kfold_avg_s_tax",
                               base_predictions(V.scored(spark, sf_dir), CFG, V.ID, _SC, _DC))


@register("m18_target_distribution", S.with_(V.SCORED_SQL) + "SELECT gt_label AS value, count(*) AS count FROM scored GROUP BY 1")
def m18_target_distribution(spark, sf_dir):
    return P.dataset_overview(V.scored(spark, sf_dir), V.TARGET)["target_distribution"]


@register("s8_results_store", S.with_(RESULTS_SQL) + "SELECT *, 'run1' AS run_id FROM results WHERE "
          "split = 'Full' AND threshold_type IN ('cost', 'accuracy', 'base')")
def s8_results_store(spark, sf_dir):
    store = _stored_run(spark, sf_dir)
    return store.load("model_metrics", "run1")


@register("b10_apply_rules", ORACLES["b9_combined_runs"])
def b10_apply_rules(spark, sf_dir):
    store = _stored_run(spark, sf_dir)
    return apply_rules(store, "run1", RULES, CFG, RULE_THRESHOLDS).select(*_RCOLS)


@register("b10_apply_rules_twice", S.with_(V.SCORED_SQL) + " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, '{r.name}' AS model_name, CAST({n} AS BIGINT) AS n FROM scored"
    for r in RULES for d, n in (("model_metrics", "1 + 0 * count(*)"), ("confusion_matrices", "1 + 0 * count(*)"),
                                ("model_summary", "1 + 0 * count(*)"), ("predictions", "count(*)"))))
def b10_apply_rules_twice(spark, sf_dir):
    """Applying the same rules again leaves one result and one prediction per row, in all four targets."""
    store = _stored_run(spark, sf_dir)
    for _ in range(2):
        apply_rules(store, "run1", RULES, CFG, RULE_THRESHOLDS)
    names = [r.name for r in RULES]
    return RP.union_runs(*[
        store.load(d, "run1").filter(F.col("model_name").isin(names)).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(d).alias("dataset"), "model_name", "n")
        for d in ("model_metrics", "confusion_matrices", "model_summary", "predictions")])


# --- J1, J2, S9 ---------------------------------------------------------------------------------

@register("j1_align_labels", S.with_(V.SCORED_SQL) + " UNION ALL ".join(
    f"SELECT id, label, '{c}' AS model_name, CAST(CASE WHEN {c} = 'Bad' THEN 1 ELSE 0 END AS DOUBLE) AS score "
    f"FROM scored" for c in _DC))
def j1_align_labels(spark, sf_dir):
    df = V.scored(spark, sf_dir)
    preds = base_predictions(df, CFG, V.ID, [], _DC)
    return labels_of(df, CFG, V.ID, V.TARGET).join(preds.drop("kind"), "id", "inner")


@register("j2_scatter_oof", S.with_(V.SCORED_SQL) + " UNION ALL ".join(
    f"SELECT id, 'kfold_avg_{c}' AS model_name, {c} AS score FROM scored" for c in _SC))
def j2_scatter_oof(spark, sf_dir):
    """Every row gets its score from the one test fold that holds it: rows carry their fold, so that is a projection."""
    long = long_scores(folded(V.scored(spark, sf_dir), CFG, V.ID, V.TARGET), V.ID, _SC)
    return long.select(V.ID, F.concat(F.lit("kfold_avg_"), F.col("model_name")).alias("model_name"),
                       F.when(F.col("fold").between(1, CFG.n_splits), F.col("score")).alias("score"))


@register("s9_model_store", S.with_(V.EVENTS_X_SQL) + " UNION ALL ".join(
    f"SELECT '{n}' AS model_name, count(*) AS n_rows, count(*) AS n_equal FROM events_x" for n in _KINDS))
def s9_model_store(spark, sf_dir):
    """Save a fitted model of each kind, load it back and score with both: every score must be the same."""
    # dealt and sorted by id once, as the checkpoint keeps both: the joins of the scores need neither
    enc = cut_lineage(spread(_encoded_events(spark, sf_dir).select(V.ID, "label", *_IMP_FEATS), V.ID).sortWithinPartitions(V.ID))

    def stored(kind):
        name, spec = kind
        model = ML.fit(spec, enc, _IMP_FEATS, id_col=V.ID)
        path = _scratch(spark, "model-store")
        ML.save_model(model, path)
        a = ML.score(model, enc).select(V.ID, F.col("score").alias("fitted"))
        b = ML.score(ML.load_model(spark, path), enc).select(V.ID, F.col("score").alias("loaded"))
        return a.join(b, V.ID).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("fitted") == F.col("loaded")).alias("n_equal")) \
            .select(F.lit(name).alias("model_name"), "n_rows", "n_equal")

    # the kinds are independent jobs of many short stages; the neighbour vote, the longest, goes first
    with ThreadPoolExecutor(max_workers=3) as pool:
        out = list(pool.map(stored, reversed(_KINDS.items())))
    return RP.union_runs(*reversed(out))


# --- W5, O6, B8 ---------------------------------------------------------------------------------

@register("w5_cumulative_counts", S.with_(*_CURVE_CTES) + "SELECT model_name, score, pos, neg, cum_pos, cum_neg FROM cum")
def w5_cumulative_counts(spark, sf_dir):
    """Descending cumulative positives / negatives per distinct score (the suffix sums behind A19/A20)."""
    return C.score_label_counts(_score_long(spark, sf_dir)).select(
        "model_name", "score", "pos", "neg", "cum_pos", "cum_neg")


@register("o6_argmin_argmax", S.with_(SWEEP_AVG_SQL, """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY cost, threshold) AS rc,
            row_number() OVER (PARTITION BY model_name ORDER BY accuracy DESC, threshold) AS ra FROM sweep_avg)""") +
          "SELECT model_name, max(threshold) FILTER (WHERE rc = 1) AS argmin_cost, "
          "max(threshold) FILTER (WHERE ra = 1) AS argmax_accuracy FROM ranked GROUP BY model_name")
def o6_argmin_argmax(spark, sf_dir):
    sweep = a6_average_fold_sweep(spark, sf_dir)
    return sweep.groupBy("model_name").agg(
        F.min_by("threshold", F.struct("cost", "threshold")).alias("argmin_cost"),
        F.max_by("threshold", F.struct(F.col("accuracy"), -F.col("threshold"))).alias("argmax_accuracy"))


def _b8_sql(where: str = "") -> str:
    rc = ", ".join(f"('{r}', '{c}')" for r, c in [(r.name, c) for r in RULES for c in r.columns]
                   + [("broken", "no_such_model")])
    covers = " UNION ALL ".join([f"SELECT 'kfold_avg_{c}' AS run, id FROM scored" for c in _SC]
                                + [f"SELECT '{c}', id FROM scored{where}" for c in _DC])
    return S.with_(V.SCORED_SQL, f"rc(rule_name, column_name) AS (VALUES {rc})", f"covers AS ({covers})",
                   "keys AS (SELECT run AS key, run FROM covers UNION SELECT replace(run, 'kfold_avg_', ''), run "
                   "FROM covers)") + """
SELECT rule_name, 'unknown_model' AS problem, column_name AS detail FROM rc
WHERE column_name NOT IN (SELECT key FROM keys) AND 'kfold_avg_' || column_name NOT IN (SELECT key FROM keys)
UNION ALL
SELECT u.rule_name, 'unequal_ids', CAST(count(*) AS VARCHAR)
FROM (SELECT rule_name, id, count(DISTINCT covers.run) AS n FROM rc JOIN keys ON rc.column_name = keys.key
      JOIN covers ON keys.run = covers.run GROUP BY ALL) u
JOIN (SELECT rule_name, count(DISTINCT run) AS n FROM rc JOIN keys ON rc.column_name = keys.key GROUP BY ALL) w
  ON u.rule_name = w.rule_name AND u.n < w.n
GROUP BY u.rule_name"""


@register("b8_unequal_ids", _b8_sql(" WHERE s_tax > 0"))
def b8_unequal_ids(spark, sf_dir):
    """The decisions cover only a part of the scored ids: every rule that combines both kinds has a problem."""
    df = V.scored(spark, sf_dir)
    preds = base_predictions(df, CFG, V.ID, _SC, []).unionByName(base_predictions(df.filter("s_tax > 0"), CFG, V.ID, [], _DC))
    return R.rule_problems(preds, _rule_columns_frame(spark))


@register("b8_rule_validation", _b8_sql())
def b8_rule_validation(spark, sf_dir):
    preds = base_predictions(V.scored(spark, sf_dir), CFG, V.ID, _SC, _DC)
    return R.rule_problems(preds, _rule_columns_frame(spark))
