import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from quorum.llm import bpe
from quorum.llm.catalog import QUERIES, tokenizer_path
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(tokenizer_path()) as f:
        return bpe.WordBpe(f.read())


EDGES = ["", " ", "\n\t", "a", "ΑΣ ΣΑΣ", "İstanbul", "a\x1c\x1db\x1fc \x85d\xa0e", "don't we'VE 12³Ⅷ½ x_y", "a" * 5000,
         "漢字かな 😀👍🏽 ﬁ", "éé", "<|endoftext|>x <|startoftext|>", "<|endoftext", "...!!!###", "　wide space"]


@pytest.mark.parametrize("queue_from", [0, 32])
def test_encode_and_decode_as_the_library(reference, queue_from):
    with open(tokenizer_path()) as f:
        own = bpe.WordBpe(f.read(), queue_from)
    rnd = random.Random(5)
    texts = EDGES + ["".join(rnd.choice("abcéñΣß İ'.,!12\n ") for _ in range(300)) for _ in range(50)]
    for text in texts:
        want = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == reference.decode(want, skip_special_tokens=False)


def test_cache_starts_anew_and_stays_right(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    text = "one two three four five six one two seven eight nine, ten. one"
    assert own.encode(text) == reference.encode(text, add_special_tokens=False).ids
    assert len(own.cache) <= 3 or len(own.cache.old) > 0


def test_byte_symbols_are_the_vocabulary():
    assert len(set(bpe.byte_symbols())) == 256 and bpe.byte_symbols()[ord("a")] == "a" and bpe.byte_symbols()[0] == "Ā"


def test_operators_round_trip(make, own):
    rows = [(1, "Hello there"), (1, "Hello there"), (None, None), (3, ""), (4, "x" * 3000)]
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(make(rows), tokenizer_path()).collect()}
    assert got == {(i, tuple(own.encode(t or ""))) for i, t in rows}
    back = bpe.decode(bpe.encode(make(rows), tokenizer_path()), tokenizer_path()).collect()
    assert sorted(r.text for r in back) == sorted(own.decode(own.encode(t or "")) for _, t in rows)
    assert bpe.encode(make(rows).limit(0), tokenizer_path()).count() == 0


def test_query_matches_the_library(spark, documents, reference):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in QUERIES["op1_bpe"](spark, SF).collect():
        ids = reference.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
