"""Capacity growth, forecasts and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import days_between


@dataclass(frozen=True)
class Thresholds:
    days_critical: float = 30
    days_warning: float = 60
    free_critical: float = 20
    free_warning: float = 30
    min_snapshots: int = 3
    min_span_days: float = 2


def growth_rate(history: DataFrame, now: Column, total: Column, target_days: float, tolerance_days: float) -> Column:
    """Aggregate over ``history`` (at, bytes): units a day since the snapshot
    nearest to ``target_days`` ago; of two equally near the newer counts."""
    age = days_between(F.col("at"), now)
    off = F.abs(age - target_days)
    near = (age > 0) & (off <= tolerance_days)
    best = F.min_by(F.struct(age.alias("age"), F.col("bytes").alias("bytes")), F.when(near, F.struct(off, age)))
    return F.try_divide((total - best["bytes"]).cast("double"), best["age"])


def growth_rates(history: DataFrame, now: Column, total: Column) -> DataFrame:
    """One row: growth a day over three horizons and the conservative one."""
    rates = history.agg(*[
        growth_rate(history, now, total, t, tol).alias(n) for n, t, tol in (("g1", 1, 0.5), ("g7", 7, 2), ("g30", 30, 5))
    ])
    far = F.greatest("g7", "g30")
    return rates.withColumn("conservative", F.greatest(F.coalesce(far, "g1"), F.when(F.coalesce(far, "g1").isNotNull(), F.lit(0.0))))


def status(days: Column, free_percent: Column, t: Thresholds = Thresholds()) -> Column:
    """The stricter of both signals."""
    def below(limit_days: float, limit_free: float) -> Column:
        return F.coalesce(days < limit_days, F.lit(False)) | F.coalesce(free_percent < limit_free, F.lit(False))

    return (
        F.when(days.isNull() & free_percent.isNull(), "unknown")
        .when(below(t.days_critical, t.free_critical), "critical")
        .when(below(t.days_warning, t.free_warning), "warning").otherwise("healthy")
    )


def forecast(state: DataFrame, horizons: tuple[int, ...] = (30, 90, 365), t: Thresholds = Thresholds()) -> DataFrame:
    """``state`` rows (total, cap, conservative, snapshots, span_days) at each horizon."""
    days = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    rows = state.select("*", days)
    thin = F.col("conservative").isNull() | (F.col("snapshots") < t.min_snapshots) | (F.col("span_days") < t.min_span_days)
    projected = F.col("total") + F.col("conservative") * F.col("horizon")
    free_now = F.col("cap") - F.col("total")
    return rows.select(
        "horizon", F.when(thin, "insufficient_data").otherwise("ok").alias("status"),
        F.when(~thin, projected).alias("projected_total"), F.when(~thin, F.col("cap") - projected).alias("projected_free"),
        F.when(~thin, (F.col("cap") - projected) / F.col("cap") * 100).alias("projected_free_percent"),
        F.when(~thin & (F.col("conservative") > 0), free_now / F.col("conservative")).alias("days_to_limit"),
    )


def alerts(rows: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(input columns, alert_key, severity) of each rule that fires.

    Rules of one key stand in order; the first that holds gives the severity.
    """
    by_key: dict[str, Column] = {}
    for key, severity, condition in rules:
        held = by_key.get(key)
        by_key[key] = F.when(condition, severity) if held is None else held.when(condition, severity)
    fired = F.filter(
        F.array(*[F.struct(F.lit(k).alias("alert_key"), s.alias("severity")) for k, s in by_key.items()]),
        lambda a: a["severity"].isNotNull())
    return rows.select(*rows.columns, F.explode(fired).alias("a")).select(*rows.columns, "a.alert_key", "a.severity")


def reconcile_alerts(open_alerts: DataFrame, firing: DataFrame) -> DataFrame:
    """Open, bump or resolve: what becomes of each alert key."""
    now = firing.select("alert_key", F.col("severity").alias("new_severity"))
    both = open_alerts.join(now, "alert_key", "full_outer")
    return both.select(
        "alert_key", F.coalesce("new_severity", "severity").alias("severity"),
        F.when(F.col("new_severity").isNull(), F.col("occurrences")).otherwise(F.coalesce("occurrences", F.lit(0)) + 1).alias("occurrences"),
        F.when(F.col("new_severity").isNull(), "resolved").when(F.col("occurrences").isNull(), "opened").otherwise("bumped").alias("action"),
    )


#: What is recommended, in this order, when capacity is critical.  Nothing of it destroys data.
RESPONSES = (
    "raise_critical_capacity_alert", "freeze_rebuildable_producers", "keep_canonical_ingestion_running",
    "request_additional_capacity", "pause_canonical_writers_if_write_safety_threatened", "keep_public_reads_online",
)


def response_plan(levels: DataFrame) -> DataFrame:
    """Recommended actions for each row whose ``level`` is critical."""
    actions = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(a).alias("action")) for i, a in enumerate(RESPONSES)])
    return levels.where(F.col("level") == "critical").select(*levels.columns, F.explode(actions).alias("a")).select(
        *levels.columns, "a.step", "a.action")


def table_sizes(spark, paths: dict[str, str]) -> DataFrame:
    """(name, rows, bytes) of tables by path: sizes from the store's listing, rows by a count."""
    out = None
    for name, path in paths.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        one = spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(size).cast("long").alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out


def days_to_limit(total: Column, limit: Column, growth: Column) -> Column:
    """Null where growth is unknown or not above zero."""
    return F.when(growth > 0, (limit - total) / growth)
