"""Every registered query runs on sf0.001 and agrees with its DuckDB oracle."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF0001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "model_name" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF0001)
    recs = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(df.columns) > 0
        return
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, recs) == _rows(dcols, cur.fetchall())


def test_entry_loads_by_path_from_any_cwd(tmp_path, monkeypatch):
    import importlib.util
    import os
    import sys
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(sys, "path", [p for p in sys.path if os.path.abspath(p or ".") != here])
    for mod in [m for m in sys.modules if m == "quorum" or m.startswith("quorum.")]:
        monkeypatch.delitem(sys.modules, mod)
    spec = importlib.util.spec_from_file_location("entry_by_path", os.path.join(here, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    assert len(m.queries()) == len(QUERIES) and set(m.oracle_sql()) == set(ORACLES)
