"""Registered queries of the corpus operators, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorum.llm import bpe, html_text, language_id, packing, periodic, quality, spelling, url_filter
from quorum.llm.common import held_out, plain_reads, read
from quorum.llm.exact_dedup import exact_dedup
from quorum.llm.near_dedup import near_dedup
from quorum.llm.quality_rules import quality_rules
from quorum.llm.simhash import simhash_dedup
from quorum.llm.span_dedup import span_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The tokenizer of the encoding and packing queries.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def _register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


@_register("op1_bpe")
def op1_bpe(spark, sf_dir):
    """Encode and decode every whole text."""
    return bpe.round_trip_digest(read(spark, sf_dir, "documents"), tokenizer_path())


@_register("op2_exact_dedup", """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n""")
def op2_exact_dedup(spark, sf_dir):
    """Exact copies of every document."""
    return exact_dedup(read(spark, sf_dir, "documents"), columns=["doc_id"])


@_register("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    """Quality scores of every document, learned from the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id", held_out().alias("held_out")])


@_register("op10_language_id")
def op10_language_id(spark, sf_dir):
    """Predicted language of every document, learned from the rows that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    model = language_id.train_on_learnable(docs)
    return language_id.predict(docs, model, keep=["doc_id", held_out().alias("held_out")])


@_register("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    """Base counts and risk-controlled verdict of every document."""
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_register("op3_html_text")
def op3_html_text(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


#: (host, path, verdict) rules that come before the mined ones.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


@_register("op5_url_filter")
def op5_url_filter(spark, sf_dir):
    """Verdict on every page's url."""
    return url_filter.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)


@_register("op6_packing")
def op6_packing(spark, sf_dir):
    """Sequences of at most 2048 tokens that hold every document."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


@_register("op9_span_dedup")
def op9_span_dedup(spark, sf_dir):
    """Every document without the sentences that an earlier document or place holds in the same run."""
    plain_reads(spark)
    return span_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


@_register("op7_minhash")
def op7_minhash(spark, sf_dir):
    """Components of near-duplicate documents."""
    return near_dedup(read(spark, sf_dir, "documents"))


@_register("op12_simhash")
def op12_simhash(spark, sf_dir):
    """Components of documents whose fingerprints differ in at most four bits."""
    return simhash_dedup(read(spark, sf_dir, "documents"))


@_register("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """Runs of periodic words in every whole text, some of which are made periodic first."""
    return periodic.periodic_runs(read(spark, sf_dir, "documents"), rewrite=periodic.planted_repeats, texts=False)


@_register("op11_spelling")
def op11_spelling(spark, sf_dir):
    """Near words and forms of every word of the corpus, some of which lose a letter first."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"), rewrite=spelling.dropped_letter)
