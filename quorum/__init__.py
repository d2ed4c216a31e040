"""quorum — classifier evaluation and decision combination on Spark.

The library reads labelled tables that already hold score and decision
columns (or trains Spark ML models to produce them), sweeps decision
thresholds under a false-positive / false-negative cost matrix, merges
cross-validation folds exactly from confusion counts, combines decisions of
several models with n-ary boolean rules and builds report tables.

Everything is expressed with DataFrames and native column functions; the
only Python inside tasks is the NumPy distance kernel of the tiled kNN join
(co-grouped Arrow batches).

Layout:
  functions/  column expressions (metrics, thresholds, rules, labels)
  operators/  DataFrame -> DataFrame operators (folds, sweep, rules, prep,
              profiling, curves, neighbours, models, reports)
  sources/    scans, sinks, result / model / feature-contract stores
  plans/      compositions (end-to-end flows, views over the driver tables, the
              query catalogue used by ``__spark_entry__``)
"""

from quorum.config import EvalConfig, Costs  # noqa: F401

__all__ = ["EvalConfig", "Costs"]
