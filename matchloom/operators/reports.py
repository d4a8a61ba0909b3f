"""Coverage, growth, readiness and integrity reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, key: Column, name: str, distinct: str | None = None) -> DataFrame:
    counted = F.count_distinct(distinct) if distinct else F.count("*")
    return rows.groupBy(key.alias(name)).agg(counted.alias("n"))


def zero_filled(dimension: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A count for every row of the dimension, zero where there is none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return dimension.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def gates(metrics: DataFrame, hard: dict[str, float], preferred: dict[str, float]) -> DataFrame:
    """One-row metrics against what is required and what is preferred."""
    rows = [
        F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("gate"), F.round(F.col(k).cast("double"), 5).alias("value"),
                 F.lit(float(need)).alias("required"), (F.col(k) >= need).alias("passed"))
        for kind, table in (("hard", hard), ("preferred", preferred)) for k, need in table.items()
    ]
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def orphans(child: DataFrame, parents: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """(relation, orphans): child keys that are set and have no parent row."""
    return union_all([
        child.where(F.col(key).isNotNull()).join(
            parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti"
        ).agg(F.lit(name).alias("relation"), F.count("*").alias("orphans"))
        for name, key, parent, parent_key in parents
    ])


def checks(facts: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """(check, observed, expected, passed) from one-value frames."""
    return union_all([
        df.select(F.lit(name).alias("check"), F.col(df.columns[0]).cast("double").alias("observed"),
                  F.lit(float(want)).alias("expected"), (F.col(df.columns[0]) == want).alias("passed"))
        for name, df, want in facts
    ])


def dedup_proof(rows: DataFrame, keys: list[str]) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return grouped.agg(F.sum("_n").alias("rows"), F.count("*").alias("distinct_keys"), F.count_if(F.col("_n") > 1).alias("repeated_keys"))


def growth_windows(rows: DataFrame, at: str, as_of: Column) -> DataFrame:
    def within(interval: str) -> Column:
        return F.count_if(F.col(at) >= as_of - F.expr(f"INTERVAL {interval}"))
    return rows.agg(within("1 HOUR").alias("last_hour"), within("24 HOURS").alias("last_day"), within("7 DAYS").alias("last_week"))


def nearest_rank(rows: DataFrame, value: str, group: str, shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact nearest-rank percentiles: the value at place ceil(p * n).

    Counts of equal values are taken first, so what is ordered within a group
    is its distinct values.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    placed = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    return placed.groupBy(group).agg(*[
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_n") * F.lit(p)), F.col(value))).alias(f"p{round(p * 100)}") for p in shares
    ])


def tables_in(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the tables that a folder holds, as its file system lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.createDataFrame([(n.removesuffix(".parquet"),) for n in sorted(names) if n.endswith(".parquet")], "name string")


def expected_tables(spark: SparkSession, folder: str, expected: tuple[str, ...]) -> DataFrame:
    """(name, present) for each table that should be there."""
    there = tables_in(spark, folder).withColumn("_there", F.lit(True))
    wanted = spark.createDataFrame([(n,) for n in expected], "name string")
    return wanted.join(there, "name", "left").select("name", F.coalesce("_there", F.lit(False)).alias("present"))
