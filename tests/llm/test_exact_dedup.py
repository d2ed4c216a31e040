import hashlib
from collections import defaultdict

from quorum.llm import exact_dedup as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = defaultdict(int)
    for r in got:
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) <= {1}


ROWS = [(1, "Same"), (2, "sAME"), (3, "other"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "É"), (9, "é" * 3000), (10, "É" * 3000)]


def test_groups_and_clashing_columns(make):
    check(op.exact_dedup(make(ROWS)), ROWS)
    check(op.exact_dedup(make(ROWS), columns=["doc_id"]), ROWS)
    assert op.exact_dedup(make(ROWS)).columns[:2] == ["doc_id", "text"]


def test_repeated_rows_keep_one(make):
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, "b"), (3, "b")]
    check(op.exact_dedup(make(rows)), rows)


def test_hot_group_and_full_filter(make, monkeypatch):
    monkeypatch.setattr(op, "MAX_SLOTS", 1 << 15)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}") for i in range(6000)]
    check(op.exact_dedup(make(rows)), rows)


def test_empty_table(make):
    assert op.exact_dedup(make(["x"]).limit(0)).count() == 0


def test_hot_group_whose_id_repeats(make, monkeypatch):
    """A third of the rows with a null id and no text: their copies are numbered in a table, not in one task."""
    tags = []
    write = op.scratch
    monkeypatch.setattr(op, "scratch", lambda df, tag: tags.append(tag) or write(df, tag))
    rows = [(None, "") if i % 3 == 0 else (i % 50, f"text {i // 2}") for i in range(6000)] + [(7, "Seven"), (7, "seven")] * 400
    for columns in (None, ["doc_id"]):
        df = op.exact_dedup(make(rows).repartition(5), columns=columns)
        check(df, rows)
        assert df.filter("kept").groupBy("text_sha256").count().filter("count <> 1").count() == 0
    assert tags.count("dedup-copies") == 2
    tags.clear()
    check(op.exact_dedup(make(ROWS)), ROWS)
    assert "dedup-copies" not in tags
