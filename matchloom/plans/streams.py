"""Plans: streaming twins run over what has landed, against their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ..streaming import slices, twins, windows
from .base import query
from .ingestion import ANCHORED
from .statistics import rate, rounded


def _events(v):
    return twins.landed(v.spark, v.sf_dir, "events.parquet")


@query("x1_stream_outcome_counts", "SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1")
def x1(v):
    return v.spark.read.parquet(twins.run_available(twins.outcome_counts(_events(v)), "complete"))


def _landed_in_files(v, rows, files: int = 6) -> str:
    """The rows as files of a new folder, to be taken up in slices."""
    path = shared_path(v.spark, "landed")
    rows.repartition(files).write.parquet(path)
    return path


@query("x1_mode_stats_by_slices", f"SELECT entity_id, mode, version, matches, wins, losses, draws, latest, {rate()} AS win_rate FROM mode_stats")
def x1_slices(v):
    path = _landed_in_files(v, v.participations.select("match_id", "entity_id", "team_id"))
    stream = v.spark.readStream.schema(v.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    kept = slices.ModeStatistics(v.spark, shared_path(v.spark, "mode-stats"), lambda: v.matches, lambda: v.teams, merge_every=2)
    kept.run(stream)
    return rounded(kept.read(v.entities), "win_rate")


@query("x2_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def x2(v):
    stream = twins.dedup(_events(v), ["user_id", "event_type"])
    return twins.results(v.spark, stream.schema, twins.run_available(stream, "append"))


@query("x5_stream_rate_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type AS scope, count(*) AS used FROM events GROUP BY 1, 2")
def x5(v):
    rows = v.spark.read.parquet(twins.run_available(twins.rate_windows(_events(v), 21600), "complete"))
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("x5_stream_anchored_windows", f"""WITH {ANCHORED}, used AS (SELECT w.scope, w.begun AS window_start, count(*) AS used FROM events e
  ASOF JOIN windows w ON e.event_type = w.scope AND epoch_us(e.ts) // 1000 >= w.begun GROUP BY 1, 2)
SELECT * FROM used u WHERE window_start < (SELECT max(window_start) FROM used x WHERE x.scope = u.scope)""")
def x5_anchored(v):
    with windows.provider(v.spark):
        stream = windows.ended_windows(_events(v).selectExpr("event_type AS scope", "ts AS at"), 21600)
        return twins.results(v.spark, stream.schema, twins.run_available(stream, "append"))


@query("x7_stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x7(v):
    rows = v.spark.read.parquet(twins.run_available(twins.hourly_counts(_events(v)), "complete"))
    return rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("x7_stream_closed_hours", """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events
WHERE date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1, 2""")
def x7_closed(v):
    stream = twins.hourly_counts(_events(v), "2 hours")
    rows = twins.results(v.spark, stream.schema, twins.run_available(stream, "append"))
    return rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
