"""Benchmark the headline queries and print ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed in full with the ``noop`` sink (no collect), after one
warm-up run of the flagship on the same session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quorum.operators.prep import correlation_filter  # noqa: E402
from quorum.plans import catalog  # noqa: E402
from quorum.session import build_session, read_table  # noqa: E402

HEADLINE = [
    "m7_score_column_eval",   # 3 score columns x 5 folds x 21 thresholds (flagship)
    "a3_threshold_sweep",
    "m8_decision_column_eval",
    "b9_combined_runs",       # 6 rules
    "w1_stratified_kfold",
    "a19b_roc_auc",
    "a20b_pr_auc",
    "j8_knn_join",
    "a16_describe",
    "p11_infer_column_types",
]


def a18_ten_columns(spark, sf_dir):
    """A18 over 10 numeric columns of lineitem (45 pair correlations in one aggregate)."""
    li = read_table(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
    df = li.select(*cols, F.hour("l_shipdate").alias("ship_hour"), F.dayofyear("l_shipdate").alias("ship_day"))
    return correlation_filter(df, cols + ["ship_hour", "ship_day"], 0.95)


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    queries = {name: catalog.QUERIES[name] for name in HEADLINE}
    queries["a18_correlation_filter_10"] = a18_ten_columns
    run(catalog.QUERIES["m7_score_column_eval"](spark, sf_dir))  # warm-up
    times = {}
    for name, fn in queries.items():
        t0 = time.perf_counter()
        run(fn(spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
