"""Evaluation views over the driver tables, plus their SQL twins.

``scored``   lineitem: one row per line item; Bad = returned ('R');
             score columns and two string decision columns. The id joins the
             four keys and the ship date: the four keys alone repeat in the
             smallest table, and every operator requires a unique row id.
``events_x`` events: Bad = event_type 'error'; features for prep / training.
``events_n`` events_x with NaN and NULL in its numbers; its SQL twin has NULL for both.
``vectors``  embeddings: Bad = label 0; 64 floats.
``docs_x``   documents joined to labels: Bad = quality 0.

Every view is a projection of the given tables, so the work of each query
grows with them. Only the needed parquet columns are read (pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.session import read_table

SCORE_COLUMNS = ["s_discount", "s_tax", "s_qty"]
DECISION_COLUMNS = ["d_status", "d_bigqty"]
TARGET = "gt_label"
ID = "id"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    tag = lambda cond: F.when(cond, F.lit("Bad")).otherwise(F.lit("Good"))
    return li.select(
        F.concat_ws("-", *[F.col(k).cast("string") for k in keys],
                    F.date_format("l_shipdate", "yyyyMMdd")).alias(ID),
        tag(F.col("l_returnflag") == "R").alias(TARGET),
        (F.col("l_discount") * 10).alias("s_discount"),
        (F.col("l_tax") / F.lit(0.08)).alias("s_tax"),
        (F.col("l_quantity") / 50).alias("s_qty"),
        tag(F.col("l_linestatus") == "O").alias("d_status"),
        tag(F.col("l_quantity") > 25).alias("d_bigqty"),
    )


SCORED_SQL = """scored AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS id,
         CASE WHEN l_returnflag = 'R' THEN 'Bad' ELSE 'Good' END AS gt_label,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         l_discount * 10 AS s_discount,
         l_tax / 0.08::DOUBLE AS s_tax,
         l_quantity / 50 AS s_qty,
         CASE WHEN l_linestatus = 'O' THEN 'Bad' ELSE 'Good' END AS d_status,
         CASE WHEN l_quantity > 25 THEN 'Bad' ELSE 'Good' END AS d_bigqty
  FROM lineitem)"""


def events_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("string").alias(ID),
        F.when(F.col("event_type") == "error", F.lit("Bad")).otherwise(F.lit("Good")).alias(TARGET),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hour"),
        (F.col("user_id") % 7).cast("string").alias("user_group"),
        (F.col("value") * 2 + 1).alias("value_lin"),
    )


EVENTS_X_SQL = """events_x AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CASE WHEN event_type = 'error' THEN 'Bad' ELSE 'Good' END AS gt_label,
         value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(hour(ts) AS DOUBLE) AS hour,
         CAST(user_id % 7 AS VARCHAR) AS user_group,
         value * 2 + 1 AS value_lin
  FROM events)"""


def events_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events_x with missing numbers of both kinds: NaN and NULL, chosen by the event's id."""
    x = events_x(spark, sf_dir)
    e = F.col(ID).cast("long")
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    return x.select(
        ID, TARGET,
        F.when(e % 7 == 0, nan).when(e % 11 == 0, none).otherwise(F.col("value")).alias("value"),
        F.when(e % 5 == 0, none).otherwise(F.col("k")).alias("k"),
        F.when(e % 13 == 0, nan).otherwise(F.col("hour")).alias("hour"),
        F.when(e % 3 == 0, nan).otherwise(F.lit(4.0)).alias("four"),
        nan.alias("never"),
        F.when(e % 17 == 0, nan).when(e % 19 == 0, none).otherwise(F.pmod(e, F.lit(101)) / 100).alias("p"),
        F.when(e % 2 == 0, F.col("value_lin")).otherwise(nan).alias("value_lin"))


EVENTS_N_SQL = """events_n AS (
  SELECT id, gt_label, CASE WHEN gt_label = 'Bad' THEN 1 ELSE 0 END AS label,
         CASE WHEN e % 7 <> 0 AND e % 11 <> 0 THEN value END AS value,
         CASE WHEN e % 5 <> 0 THEN k END AS k,
         CASE WHEN e % 13 <> 0 THEN hour END AS hour,
         CASE WHEN e % 3 <> 0 THEN 4.0::DOUBLE END AS four,
         NULL::DOUBLE AS never,
         CASE WHEN e % 17 <> 0 AND e % 19 <> 0 THEN (e % 101) / 100::DOUBLE END AS p,
         CASE WHEN e % 2 = 0 THEN value_lin END AS value_lin
  FROM (SELECT *, CAST(id AS BIGINT) AS e FROM events_x))"""
EVENTS_N_COLUMNS = ["value", "k", "hour", "four", "never", "p", "value_lin"]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = read_table(spark, sf_dir, "embeddings")
    return em.select(
        F.col("vec_id").alias(ID),
        F.when(F.col("label") == 0, F.lit(1)).otherwise(F.lit(0)).alias("label"),
        F.col("embedding"),
    )


def docs_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias(ID),
        F.when(F.col("quality") == 0, F.lit("Bad")).otherwise(F.lit("Good")).alias(TARGET),
        F.col("n_chars").cast("double").alias("n_chars"),
        "lang", "source", F.col("toxic").cast("double").alias("toxic"),
    )


ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def untyped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders read as text (the shape of an untyped CSV scan), plus a column with
    missing values and a constant column, for profiling."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        *[F.col(c).cast("string").alias(c) for c in ORDERS_COLUMNS],
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status_np"),
        F.lit("orders").alias("source_table"),
    )


UNTYPED_ORDERS_SQL = "untyped AS (SELECT " + ", ".join(
    [f"CAST({c} AS VARCHAR) AS {c}" for c in ORDERS_COLUMNS]
    + ["CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status_np", "'orders' AS source_table"]
) + " FROM orders)"
UNTYPED_COLUMNS = ORDERS_COLUMNS + ["status_np", "source_table"]
