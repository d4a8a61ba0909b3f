"""Registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_tokens, best_fit, bpe, centroids, langid, native_queries, packing, quality, simhash, spelling, tiff
from .common import crc32_text, table


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff.read_pages(tiff.encode_texts(table(spark, sf_dir, "documents")))
    return pages.select(
        "doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(crc32_text(F.col("doc_id")), F.lit(5)) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), allowed=~held_out)
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents")))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc32_text(F.col("doc_id")), F.lit(4)) == 2
    model = langid.fit(docs, allowed=~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_length", "step_group",
    )


def op9_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = arrow_tokens.write_tokens(table(spark, sf_dir, "documents"))
    whole = arrow_tokens.read_ids(folder, index.where(F.col("n_ids") == F.col("doc_ids")))
    parts = arrow_tokens.read_ids(folder, index.where(F.col("n_ids") < F.col("doc_ids")))
    # only documents that go over the end of a file are put together
    parts = parts.groupBy("doc_id", (F.col("start") - F.col("piece_start")).alias("start")).agg(
        F.first("doc_ids").alias("doc_ids"), F.sort_array(F.collect_list(F.struct("piece_start", "ids"))).alias("pieces")
    )
    joined = F.aggregate("pieces", F.lit("").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    both = whole.select("doc_id", "start", "doc_ids", "ids").union(
        parts.select("doc_id", "start", "doc_ids", joined.alias("ids"))
    )
    return both.select("doc_id", "start", F.col("doc_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    **native_queries.QUERIES,
    "op2_simhash": op2_simhash,
    "op3_tiff_pages": op3_tiff_pages,
    "op4_quality_knn": op4_quality_knn,
    "op5_byte_bpe": op5_byte_bpe,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_arrow_tokens": op9_arrow_tokens,
    **centroids.QUERIES,
    **best_fit.QUERIES,
    **spelling.QUERIES,
}
ORACLE_SQL = native_queries.ORACLE_SQL | centroids.ORACLE_SQL | spelling.ORACLE_SQL
