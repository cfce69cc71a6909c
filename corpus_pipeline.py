"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, secrets, tokens.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and is written and read
again before the next. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.llm import quality
from siftworks.llm.decontamination import contained_items
from siftworks.llm.near_dedup import near_duplicates
from siftworks.llm.queries import PIECES
from siftworks.llm.secret_ledger import redact_secrets
from siftworks.llm.sentencepiece_bpe import encode_texts, read_model
from siftworks.session import staged, work_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a null or empty text is judged like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Rows with one id stay or go together: they stay if any of them would. Rows without an id stay.
    """
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows without an id stay."""
    found = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets masked and ``n_chars`` counted again where a text changed."""
    return redact_secrets(docs, work_dir(spark, "ledger"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_ids, lossless)`` of every document."""
    return encode_texts(docs, read_model(PIECES))


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("sentencepiece_encoding", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# the classifier, the dropout and the groups of near-duplicates are beyond SQL
ORACLE_SQL = None
