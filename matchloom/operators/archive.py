"""Archives of payloads and of row graphs: write, verify, restore, replay.

An object is one payload, gzip-compressed with a fixed header, so that equal
payloads give equal objects.  A graph is a set of anchor rows with the rows of
other tables that belong to them, one Parquet folder per table.
"""

from __future__ import annotations

import gzip
import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retention import first_reason

# ---- snapshots and objects ----------------------------------------------


def write_snapshots(payloads: DataFrame, path: str) -> None:
    """Append payloads (category, payload) with checksum and size, one folder per category."""
    rows = payloads.withColumn("checksum", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows.write.mode("append").partitionBy("category").parquet(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """Rows as gzip-compressed JSON lines."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).write.option("compression", "gzip").text(path)


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def compressed(payload: Column) -> Column:
    """The object of a payload; null stays null."""
    @F.pandas_udf("binary")
    def pack(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: None if p is None else gzip.compress(p.encode("utf-8"), 6, mtime=0))

    return pack(payload)


def decompressed(data: Column) -> Column:
    """The payload of an object; null where it is none."""
    def unpack(raw):
        try:
            return None if raw is None else gzip.decompress(raw).decode("utf-8")
        except (OSError, EOFError, ValueError):
            return None

    @F.pandas_udf("string")
    def run(objects: pd.Series) -> pd.Series:
        return objects.map(unpack)

    return run(data)


def verify_objects(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """The manifest with the first reason that an object fails (null: it holds).

    Manifest: key, object_checksum, original_checksum, live_payload.
    Objects: key, data.
    """
    both = manifest.join(objects.select("key", "data"), "key", "left")
    checked = both.withColumn("_object", F.sha2("data", 256)).withColumn("_payload", F.sha2(decompressed(F.col("data")), 256))
    reason = first_reason(
        ("object_missing", F.col("data").isNull()),
        ("object_checksum_mismatch", F.col("_object") != F.col("object_checksum")),
        ("decompressed_mismatch", ~F.col("_payload").eqNullSafe(F.col("original_checksum"))),
        ("live_payload_mismatch", ~F.sha2("live_payload", 256).eqNullSafe(F.col("original_checksum"))),
    )
    return checked.withColumn("reason", reason).drop("data", "_object", "_payload")


def replay_summary(validated: DataFrame) -> DataFrame:
    """Per category: valid and rejected records; a replay without a valid record fails."""
    return validated.groupBy("category").agg(
        F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("rejected"), F.bool_or("valid").alias("passed"))


def metrics(archives: DataFrame, as_of: Column) -> DataFrame:
    """One row over all archive records: status counts, oldest pending age, sizes, ratio."""
    verified, pending = F.col("status") == "verified", F.col("status") == "pending"
    counts = archives.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "verified", "failed")],
        F.min(F.when(pending, F.col("created_at"))).alias("_oldest"), F.coalesce(F.max("attempts"), F.lit(0)).alias("max_attempts"),
        F.coalesce(F.sum(F.when(verified, F.col("original_bytes"))), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.sum(F.when(verified, F.col("object_bytes"))), F.lit(0)).alias("object_bytes"),
    )
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("_oldest").cast("timestamp"))
    ratio = F.when(F.col("object_bytes") > 0, F.col("original_bytes") / F.col("object_bytes"))
    return counts.withColumn("oldest_pending_s", age).withColumn("ratio", F.round(ratio, 5)).drop("_oldest")


# ---- canonical documents ------------------------------------------------


def canonical_json(document: Column) -> Column:
    """JSON text with sorted keys and no spaces; null where it is no JSON.

    Arbitrary documents have no schema, so this is the one place where a
    vectorised Python function stands in for ``to_json``.
    """
    def canonical(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(canonical)

    return run(document)


def evidence_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def plain_object_hash(payload: str) -> str:
    """What ``compressed`` then ``sha2`` give for one payload; for tests and tools."""
    return hashlib.sha256(gzip.compress(payload.encode("utf-8"), 6, mtime=0)).hexdigest()


# ---- graphs of rows -----------------------------------------------------


@dataclass(frozen=True)
class Family:
    """Which rows of a table may leave the hot store, and after how long."""

    at: str
    days: int
    extended: tuple[str, ...] = ()  # statuses that stay longer
    extended_days: int = 0
    only: str | None = None  # rows that may leave at all
    archive_only: bool = False


#: Hot days of each family of rows.
FAMILIES = {
    "match_graph": Family("occurred_at", 365),
    "match_observations": Family("observed_at", 180),
    "workflow_audit": Family("started_at", 365, ("failed", "held"), 730),
    "fetch_audit": Family("started_at", 365),
    "observed_players": Family("first_observed_at", 60),
    "crawl_batches": Family("completed_at", 90),
    "detected_changes": Family("created_at", 365),
    "data_incidents": Family("resolved_at", 365, only="resolved_at IS NOT NULL"),
    "normalized_snapshots": Family("created_at", 365, only="NOT is_accepted"),
    "player_name_history": Family("recorded_at", 365, archive_only=True),
}


def plan_family(rows: DataFrame, name: str, as_of: Column) -> DataFrame:
    """The rows that may go, with what becomes of them: archived, or deleted as well."""
    family = FAMILIES[name]
    days = F.lit(family.days)
    if family.extended:
        days = F.when(F.col("status").isin(*family.extended), family.extended_days).otherwise(days)
    old = F.col(family.at) < as_of - F.make_interval(days=days)
    may = old if family.only is None else old & F.expr(family.only)
    return rows.where(may).withColumn("action", F.lit("archive" if family.archive_only else "archive_and_delete"))
