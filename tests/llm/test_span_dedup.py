import random
from itertools import pairwise

from quorum.llm import span_dedup as op
from quorum.llm.catalog import QUERIES
from quorum.llm.common import ARROW_BYTES
from tests.llm.conftest import SF


def brute(rows, run=op.RUN, min_words=op.MIN_WORDS):
    """Spans in order of id and place; what came before is cut."""
    seen, out = set(), []
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        _, counts, norm = op.sentences((text or "").translate(op._LOWER))
        places = []
        for a, z in op._runs(counts, run, min_words):
            key = tuple(norm[a:z])
            if key in seen:
                places.append(a)
            seen.add(key)
        new, n = op.cut(text, places)
        out.append((i, new if n else text, n))
    return out


def check(df, rows):
    assert sorted((r.doc_id, r.text, r.n_removed) for r in df.collect()) == sorted(brute(rows))


def passage(k):
    return " ".join(f"{w}{k}x{i}" + "." * (i % 9 == 8) for i, w in enumerate(["alpha", "beta", "gamma"] * 20))


ROWS = [(1, f"Opening words here. {passage(1)}. Closing words."), (2, f"Another start. {passage(1)}. Another end of it."),
        (3, f"{passage(2)}. {passage(2)}."), (4, None), (5, ""), (6, "No. Yes. No. Yes. No. Yes."), (7, "No. Yes. No. Yes."),
        (8, passage(3).upper()), (9, passage(3).replace(" ", "\n ")), (10, "x" * 50000), (11, "one " * 20000)]


def test_spans_equal_brute_force(make):
    check(op.span_dedup(make(ROWS)), ROWS)
    got = {r.doc_id: r for r in op.span_dedup(make(ROWS)).collect()}
    assert got[1].text == ROWS[0][1] and "alpha1" not in got[2].text and got[2].text.startswith("Another start.")
    assert got[3].text.count("alpha2") < ROWS[2][1].count("alpha2") and not got[6].changed and not got[7].changed


def test_long_sentences_make_spans(make):
    text = " ".join(f"w{i}" for i in range(52))
    rows = [(1, text + "."), (2, f"Before it.\n{text}.\nAfter it.")]
    got = {r.doc_id: r.text for r in op.span_dedup(make(rows)).collect()}
    assert got[1] == text + "." and "w30" not in got[2] and got[2].startswith("Before it.") and got[2].endswith("After it.")


def test_hot_spans_and_edges(make, monkeypatch):
    monkeypatch.setattr("quorum.llm.common.HOT_SHARE", 10)
    rows = [(i, f"Start {i}. {passage(7)}. End {i}.") for i in range(300)]
    check(op.span_dedup(make(rows)), rows)
    odd = op.span_dedup(make([(None, passage(1)), (None, passage(1)), (1, passage(1))])).collect()
    assert len(odd) == 3 and not any(r.changed for r in odd)
    assert op.span_dedup(make(rows).limit(0)).count() == 0


def test_query(spark, documents):
    check(QUERIES["op9_span_dedup"](spark, SF), [(r.doc_id, r.text) for r in documents.collect()])


def pieces_by_definition(words, size=op.MAX_WORDS):
    """A sentence's words cut after the last smallest hash of every window before its last word."""
    keys = [op.xxhash.xxh32_intdigest(w) for w in words[:-1]]
    cuts = {max(range(at, at + size), key=lambda i: (-keys[i], i)) + 1 for at in range(len(keys) - size + 1)}
    edges = [0, *sorted(cuts), len(words)]
    return [" ".join(words[a:z]) for a, z in pairwise(edges)]


def test_long_sentences_are_cut_by_their_own_words():
    rnd = random.Random(1)
    for n in [*range(1, 40), 500]:
        for vocabulary in (1, 3, 1000):
            words = [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]
            starts, counts, norm = op.sentences("  ".join(words))
            assert norm == pieces_by_definition(words) and max(counts) <= op.MAX_WORDS and sum(counts) == n


def planted(rnd, n):
    """Two texts of other words that hold one passage of ``n`` words, each from a random word on, and the passage."""
    def words(tag, count):
        return [f"{tag}{rnd.randrange(10 ** 9)}" + "." * (rnd.random() < ends) for _ in range(count)]
    ends = rnd.choice([0, 0.02, 0.1, 0.3])
    shared = words("p", n)
    return [" ".join(words(tag, rnd.randrange(40)) + shared + words(tag, rnd.randrange(40))) for tag in "ab"], shared


def test_passages_that_start_in_mid_sentence(make):
    rnd = random.Random(2)
    cases = [planted(rnd, n) for n in [49, 50, 51, 52, 60, 80, 150] * 40]
    rows = [(2 * k + j, text) for k, (texts, _) in enumerate(cases) for j, text in enumerate(texts)]
    got = {r.doc_id: r.text for r in op.span_dedup(make(rows)).collect()}
    for k, (texts, shared) in enumerate(cases):
        assert got[2 * k] == texts[0]
        kept, own = set(got[2 * k + 1].split()), set(texts[1].split()) - set(shared)
        # what stays are words whose cuts the surroundings decide, and an end too short for a span
        assert len(kept & set(shared)) < 2 * op.MAX_WORDS + op.MIN_WORDS, (len(shared), texts)
        assert own <= kept


def test_text_without_spaces(make):
    rnd = random.Random(3)
    letters = {"zh": range(0x4e00, 0x9fa0), "ja": range(0x3041, 0x3090), "th": range(0x0e01, 0x0e2f)}
    for tag, span in letters.items():
        def run(n, stop):
            return "".join(chr(rnd.choice(span)) + stop * (rnd.random() < 0.05) for _ in range(n))
        for stop in ("。", ""):
            shared = run(120, stop)
            rows = [(1, run(17, stop) + shared + run(40, stop)), (2, run(30, stop) + shared + run(25, stop)), (3, run(400, stop))]
            df = op.span_dedup(make(rows))
            check(df, rows)
            got = {r.doc_id: r.text for r in df.collect()}
            assert got[1] == rows[0][1] and got[3] == rows[2][1]
            assert shared[40:80] not in got[2] and got[2].startswith(rows[1][1][:10]), (tag, stop)
            # what stays of the passage are its ends
            assert len(got[2]) < 30 + 25 + 2 * op.MAX_WORDS + op.MIN_WORDS + 10


def test_spaces_beside_unspaced_letters():
    words = [f"w{i}" for i in range(40)]
    _, counts, norm = op.sentences("漢字。かな！ " + " ".join(words))
    assert norm[:2] == ["漢 字 。", "か な ！"] and sum(counts) == 46 and " ".join(norm[2:]) == " ".join(words)


def test_query_sends_few_texts_at_a_time(spark, make, tmp_path, monkeypatch):
    """A batch of 10 000 long texts would stand in the JVM and in Python several times for every running task."""
    cut_small = op.small_batches

    def bounded(batches, rows=500):
        for batch in batches:
            assert batch.nbytes < 10_000_000
            yield from cut_small([batch], rows)

    monkeypatch.setattr(op, "small_batches", bounded)
    rows = [(i, f"word{i} " * 12_500) for i in range(200)]  # 20 MB
    make(rows, extra=False).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.unset(ARROW_BYTES)
    assert QUERIES["op9_span_dedup"](spark, str(tmp_path)).count() == 200
