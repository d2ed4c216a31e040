import numpy as np

from quorum.llm import language_id as op
from quorum.llm.catalog import QUERIES
from tests.llm.conftest import SF


def test_held_out_accuracy(spark, documents):
    got = QUERIES["op10_language_id"](spark, SF).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == documents.count() and len(held) > 40
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_equal_brute_force(documents):
    model = op.train_on_learnable(documents)
    texts = ["Hello there", "der die das", "x"]
    names, scores = op.score_texts(texts, model)
    for text, name, score in zip(texts, names, scores):
        framed = f" {text.lower()} "
        codes = np.array([*map(ord, framed), 0, 0], dtype=np.uint32)  # NULs after the end
        total = model["prior"].copy()
        for hashes, _ in op.gram_hashes(codes, op.SIZES, op.N_BUCKETS):
            total = total + model["logs"][hashes[:len(framed)]].sum(axis=0, dtype=np.float64)
        chance = np.exp(total - total.max())
        chance /= chance.sum()
        assert name == model["langs"][int(chance.argmax())] and abs(chance.max() - score) < 1e-6


def test_slices_of_long_texts_lose_no_gram(monkeypatch):
    text = "abc déf ghi " * 40
    def count(limit):
        monkeypatch.setattr(op, "SLICE", limit)
        total = np.zeros(op.N_BUCKETS, dtype=int)
        for codes, owners in op.slices([text, "", text], op.SIZES):
            for hashes, _ in op.gram_hashes(codes, op.SIZES, op.N_BUCKETS):
                total += np.bincount(hashes[owners[:len(hashes)] >= 0], minlength=op.N_BUCKETS)
        return total
    whole, cut = count(1 << 18), count(50)
    assert abs(int(whole.sum()) - int(cut.sum())) <= 6 and np.abs(whole - cut).max() <= 6


def test_edges(make, documents):
    model = op.train_on_learnable(documents)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "The of and"), (4, "The of and"), (None, "x")]
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in op.predict(make(rows), model).collect()), key=repr)
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3 and len(got) == 6
    empty = op.train(make(["x"]).limit(0))
    assert {r.lang_pred for r in op.predict(make(rows), empty).collect()} == {"und"}
    assert op.predict(make(rows).limit(0), model).count() == 0
