import corpus_pipeline as pipeline
from quorum.llm.language_id import UNKNOWN, predict, train
from tests.llm.conftest import SF
from tests.llm.test_exact_dedup import LOWER
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_packing import check as packing_check
from tests.llm.test_span_dedup import brute as span_brute


def test_stages_equal_brute_force(spark, documents):
    """Every stage on its predecessor's rows."""
    docs = documents
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "span_dedup", "packing"]
    for name, stage in pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = pipeline.scratch(stage(spark, docs, SF), "test")
        got = out.collect()
        if name == "packing":
            packing_check(got, rows)
            break
        assert out.columns == documents.columns
        have = {r.doc_id: r.text for r in got}
        assert len(have) == len(got)
        if name == "language_id":
            judged = predict(docs, train(docs)).collect()
            assert set(have) == {r.doc_id for r in judged if r.lang_pred != UNKNOWN and r.score >= 0.5}
        elif name == "exact_dedup":
            last = {}
            for i, t in rows:
                key = (t or "").translate(LOWER)
                last[key] = max(i, last.get(key, i))
            assert set(have) == set(last.values())
        elif name == "near_dedup":
            _, root = near_brute(rows, pipeline.SHINGLE_WORDS)
            assert set(have) == set(root.values())
        else:
            want = {i: t for i, t, n in span_brute(rows) if not n or t}
            assert have == want and all(r.n_chars == len(r.text) for r in got)
        docs = out


def test_edges(spark, make):
    odd = make([(None, None), (1, ""), (2, "123"), (3, "word " * 60), (3, "word " * 60), (None, "word x")], extra=False)
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF).collect()
            assert name in ("packing", "near_dedup") or len(out) <= docs.count()


def test_query_is_registered(spark):
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"] is pipeline.run
    assert pipeline.run(spark, SF).count() > 0
