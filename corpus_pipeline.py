"""A training-data pipeline: language, quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import dedup, langid, packing, quality, secrets
from matchloom.llm.common import materialize, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a known language; their ``lang`` stays as it was."""
    small_batches(spark)
    judged = langid.identify(docs.select(*COLUMNS), langid.fit(docs))
    return judged.where(~F.col("rejected")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are more likely good than the rejection threshold."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.score(docs.select(*COLUMNS), model, out_col="_ml_score")
    return judged.where(F.col("_ml_score") >= 0.3).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float | None = None) -> DataFrame:
    """Keep one row of each group of near-duplicates: that of the smallest id."""
    small_batches(spark)
    return dedup.keep_one(docs.select(*COLUMNS), similarity)


def near_text_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``near_dedup`` with a similarity of 0.8 of five-word shingles."""
    return near_dedup(spark, docs, sf_dir, 0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; ``n_chars`` follows the text."""
    clean = secrets.redact_secrets(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences, with their ids."""
    small_batches(spark)
    return packing.pack_documents(docs, cache_pieces=200_000)


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_text_dedup),
    ("secret scans", redact),
    ("packing", pack),
]

#: Models and XXH64 fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{number}")
    return docs
