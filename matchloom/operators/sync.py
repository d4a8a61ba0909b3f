"""Incremental reconciliation of a source with a target table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import digests


def page(rows: DataFrame, order: list[str], after: Column | None, upto: Column | None, size: int) -> DataFrame:
    """Rows behind a composite cursor, up to a fixed watermark."""
    key, first = F.struct(*order), F.col(order[0])
    # the first column alone as well: a plain comparison reaches the scan, a struct's does not
    if after is not None:
        rows = rows.where((key > after) & (first >= after.getField("col1")))
    if upto is not None:
        rows = rows.where((key <= upto) & (first <= upto.getField("col1")))
    return rows.orderBy(*order).limit(size)


def key_difference(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row: keys on one side only, with up to ten samples of each.

    Keys meet once; samples are a top-k of what differs, not a collected group.
    """
    s, t = source.select(F.col(key).alias("_s")), target.select(F.col(key).alias("_t"))
    differ = s.join(t, F.col("_s") == F.col("_t"), "full_outer").where("_s IS NULL OR _t IS NULL").where("NOT (_s IS NULL AND _t IS NULL)")
    side, least = F.when(F.col("_t").isNull(), "source").otherwise("target"), F.coalesce("_s", "_t")
    numbered = differ.select(side.alias("_side"), least.alias("_key"))
    place = F.row_number().over(Window.partitionBy("_side").orderBy("_key"))
    counts = numbered.groupBy("_side").agg(F.count("*").alias("_n"))
    first = numbered.withColumn("_place", place).where("_place <= 10").groupBy("_side").agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    both = counts.join(first, "_side")

    def of(name: str) -> list[Column]:
        here = F.col("_side") == name
        sample = F.coalesce(F.array_join(F.max(F.when(here, F.col("_keys"))), ","), F.lit(""))
        return [F.coalesce(F.max(F.when(here, F.col("_n"))), F.lit(0).cast("long")).alias(f"{name}_only"), sample.alias(f"{name}_sample")]

    return both.agg(*of("source"), *of("target"))


def symmetric_difference(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    here = source.select(key).join(target.select(key), key, "left_anti").withColumn("side", F.lit("source"))
    return here.unionByName(target.select(key).join(source.select(key), key, "left_anti").withColumn("side", F.lit("target")))


def value_mismatches(source: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of the source whose value differs in the target, missing rows included; null equals null."""
    t = target.select(key, F.col(value).alias("target_value"))
    return source.select(key, F.col(value).alias("source_value")).join(t, key, "left").where(
        ~F.col("source_value").eqNullSafe(F.col("target_value")))


def verdict(differences: DataFrame) -> DataFrame:
    """(check, problems, passed) of keys and of values, from rows (key, side) of ``digests.find_differences``."""
    other = F.col("side") == "differs"
    counts = differences.agg(F.count_if(~other).alias("keys"), F.count_if(other).alias("values"))
    rows = counts.select(F.expr("stack(2, 'keys', keys, 'values', values) AS (check, problems)"))
    return rows.withColumn("passed", F.col("problems") == 0)


def row_checksum(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)


def merge_plan(source: DataFrame, target: DataFrame, key: str, columns: list[str], immutable: bool = False) -> DataFrame:
    """What each source row needs: insert, update, nothing, or (immutable) a report of divergence."""
    s = source.select(key, row_checksum(source, columns).alias("_s"))
    t = target.select(key, row_checksum(target, columns).alias("_t"))
    action = (
        F.when(F.col("_t").isNull(), "inserted").when(F.col("_s") == F.col("_t"), "matched")
        .otherwise("diverged" if immutable else "updated")
    )
    return s.join(t, key, "left").select(key, action.alias("action"))


def apply_merge(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The target after a merge: source rows, and target rows that the source lacks."""
    return source.unionByName(target.join(source.select(key), key, "left_anti"))


def hourly_reconcile(source: DataFrame, target: DataFrame, at: str, ident: str) -> DataFrame:
    """Hours whose count or bounds differ."""
    def by_hour(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.date_trunc("hour", at).alias("hour")).agg(
            F.count("*").alias(f"{side}_n"), F.min(ident).alias(f"{side}_min"), F.max(ident).alias(f"{side}_max"))
    both = by_hour(source, "source").join(by_hour(target, "target"), "hour", "full_outer")
    same = [F.col(f"source_{x}").eqNullSafe(F.col(f"target_{x}")) for x in ("n", "min", "max")]
    return both.where(~(same[0] & same[1] & same[2]))


def child_digests(children: DataFrame, parent: str, columns: list[str]) -> DataFrame:
    """count:sha256 of each parent's ordered child rows; a tree of hashes where there are many."""
    return digests.ordered_digests(children, parent, columns)


def sync_lag(maxima: DataFrame, cursors: DataFrame) -> DataFrame:
    """Seconds between a table's newest row and its cursor."""
    gap = F.unix_seconds(F.col("newest").cast("timestamp")) - F.unix_seconds(F.col("cursor").cast("timestamp"))
    return maxima.join(cursors, "name", "left").select("name", F.when(F.col("cursor").isNotNull(), F.greatest(F.lit(0), gap)).alias("lag_s"))


def readiness_streak(log: DataFrame, order: list[str], scope: str, most_lag: int = 60, need: int = 3) -> DataFrame:
    """Running streak of passes within a scope, reset by a failure or too great a lag."""
    ok = F.coalesce(F.col("passed") & (F.col("lag_s") < most_lag), F.lit(False))
    w = Window.partitionBy(scope).orderBy(*order)
    islands = log.withColumn("_ok", ok).withColumn("_island", F.sum(F.when(ok, 0).otherwise(1)).over(w))
    run = Window.partitionBy(scope, "_island").orderBy(*order)
    streak = F.sum(F.col("_ok").cast("int")).over(run)
    return islands.withColumn("streak", streak).withColumn("ready", F.col("streak") >= need).drop("_ok", "_island")


def inventory(source: DataFrame, target: DataFrame, skip: DataFrame) -> DataFrame:
    """(name, verdict): sync, skip, or fatal where one side lacks a table."""
    s, t = source.withColumn("_s", F.lit(True)), target.withColumn("_t", F.lit(True))
    k = skip.select("name").distinct().withColumn("_k", F.lit(True))
    return s.join(t, "name", "full_outer").join(k, "name", "left").select(
        "name", F.when(F.col("_k"), "skip").when(F.col("_s") & F.col("_t"), "sync").otherwise("fatal").alias("verdict"))


def schema_problems(source: DataFrame, target: DataFrame) -> list[str]:
    """Columns that the target lacks or types otherwise."""
    want = {f.name: f.dataType for f in target.schema.fields}
    return [
        f"{f.name}: {'missing' if f.name not in want else want[f.name].simpleString()}"
        for f in source.schema.fields if want.get(f.name) != f.dataType
    ]


def columns_of(df: DataFrame) -> DataFrame:
    """(position, name, type) of a table's columns."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def overlap_range(rows: DataFrame, at: str, cursor: Column, overlap_s: int, watermark: Column) -> DataFrame:
    """Rows of one pass: from a little before the cursor up to the pass's fixed watermark."""
    return rows.where((F.col(at) >= cursor - F.make_interval(secs=F.lit(overlap_s))) & (F.col(at) <= watermark))


def same_rows(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose row is missing on one side or differs; empty when the copy is exact."""
    s = source.select(key, row_checksum(source, columns).alias("_s"))
    t = target.select(key, row_checksum(target, columns).alias("_t"))
    return s.join(t, key, "full_outer").where(~F.col("_s").eqNullSafe(F.col("_t"))).select(key)
