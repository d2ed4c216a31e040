"""A training-corpus pipeline over ``documents``.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared
folder and reads again as the next stage's docs. All but the last stage return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm.catalog import tokenizer_path
from quorum.llm.common import plain_reads, read, scratch
from quorum.llm.exact_dedup import exact_dedup
from quorum.llm.language_id import UNKNOWN, predict, train
from quorum.llm.near_dedup import near_dedup
from quorum.llm.packing import pack
from quorum.llm.span_dedup import span_dedup

#: A document stays if its best language is at least this likely.
MIN_LANGUAGE_SCORE = 0.5
#: Words of a shingle of the near-duplicate stage; the similarity is 80 % as in the operator.
SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and the few whose best language is less likely than ``MIN_LANGUAGE_SCORE``.

    The score is a share among the learned languages, which for anything longer than a few words is close to
    1 for one of them: a text in a language that was not learned is not recognised as such, and stays.

    The classifier learns from the documents that come with a language; if none
    does, there is nothing to judge by, and only those without a letter go.
    """
    plain_reads(spark)
    model = train(docs)
    if not model["langs"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = predict(docs, model)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    plain_reads(spark)
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    plain_reads(spark)
    dropped = near_dedup(docs, shingle=SHINGLE_WORDS).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that stand in an earlier place in the same run go; documents of nothing else go with them."""
    plain_reads(spark)
    cut = span_dedup(docs)
    left = cut.filter(~F.col("changed") | (F.col("text") != ""))
    n_chars = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences that hold every document left."""
    plain_reads(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("span_dedup", repeated_spans),
    ("packing", packing),
]

#: The stages hold a learned model and a search for packings, which SQL can't express.
ORACLE_SQL = None


def remove(spark: SparkSession, files: list[str]) -> None:
    """Delete the folder of a stage's files in the shared folder."""
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last one's result.

    A stage's table is deleted when the next one's is written.
    """
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(spark, before)
        before = docs.inputFiles()
    return docs
