import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quorum.session import build_session
    s = build_session("local[*]", 4, "quorum-llm-tests")
    yield s


@pytest.fixture(scope="session")
def documents(spark):
    from quorum.llm.common import read
    return read(spark, SF, "documents")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents frame from texts or (id, text) rows, with columns whose names clash with the operators' own."""
    def build(rows, extra=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
        if extra:
            for name in ("id", "kept", "score", "n", "component_id", "spans", "bucket", "length", "piece", "_text", "hot"):
                from pyspark.sql import functions as F
                df = df.withColumn(name, F.lit("clash"))
        return df
    return build
