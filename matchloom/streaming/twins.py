"""Streaming twins of batch transforms, as incremental runs over landed files.

Each runs all that is available and stops; its checkpoint makes the next run
go on where this one ended, and a run that died is taken up without loss or
repetition.  ``dedup_within`` bounds its state by a watermark: a duplicate that
comes later than that passes again, which the unbounded form does not allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def landed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the Parquet files of that name in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, mode: str, out: str | None = None, checkpoint: str | None = None) -> str:
    """Process what is there; returns the folder of results.

    Appends go to a file sink; complete results replace those of the batch
    before, under the number of the batch, so that a repeated batch overwrites
    only itself.  A run that finds nothing new returns what the one before left,
    and the first one an empty table; read appends with ``results``, as a sink
    that got no rows has no file.
    """
    spark = stream.sparkSession
    out, checkpoint = out or shared_path(spark, "stream"), checkpoint or shared_path(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return out

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer.foreachBatch(store).start().awaitTermination()
    number = _last_batch(spark, out)
    if number is None:  # nothing has come yet
        number = -1
        store(spark.createDataFrame([], stream.schema), number)
    return f"{out}/batch={number}"


def results(spark: SparkSession, schema, out: str) -> DataFrame:
    """What an append sink holds, with the stream's schema: no rows where nothing has come yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


def _last_batch(spark: SparkSession, out: str) -> int | None:
    """The greatest number of a stored batch, of this run or one before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=None)


def outcome_counts(events: DataFrame) -> DataFrame:
    """Running counts by kind."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def hourly_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """Counts by hour and kind.

    With ``late``, for append mode: an hour comes once and for good when the
    newest event is ``late`` beyond its end, and its state is dropped then.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if late else timed
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("hour"), "event_type", "n")


def dedup(events: DataFrame, key: list[str]) -> DataFrame:
    """The keys seen, each once, however late a duplicate comes."""
    return events.select(*key).dropDuplicates()


def dedup_within(events: DataFrame, key: list[str], late: str) -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(key)


def rate_windows(events: DataFrame, seconds: int) -> DataFrame:
    """Requests per scope in fixed windows; these are anchored at the epoch,
    not at a scope's first use."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.groupBy(F.window("at", f"{seconds} seconds").alias("w"), F.col("event_type").alias("scope")).agg(
        F.count("*").alias("used")).select(F.col("w.start").alias("window_start"), "scope", "used")
