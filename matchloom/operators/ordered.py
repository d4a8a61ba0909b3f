"""Orders over more rows than a task holds: running sums and shares at or below.

Rows are dealt out in ranges of the order and written to the shared folder, so
that every later step sees the same ranges.  Each range is summed by itself, the
sums before it are added to its rows, and no window ever holds a whole group.
A key with all rows of a table spreads over as many ranges as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def in_ranges(rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows, written in ranges of ``order``, with the number of their range in ``_range``.

    Ranges follow one another in the order, and rows equal in it share one.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "ranges")
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def running_sums(
    rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], ranges: int | None = None
) -> DataFrame:
    """The rows with inclusive running sums of whole numbers within ``keys`` by ``order``.

    The order should be total: only rows that differ in it can stand in two ranges.
    """
    marked = rows.withColumns({f"_add_{n}": c.cast("long") for n, c in sums.items()})
    dealt = in_ranges(marked, [*keys, *order], ranges)
    parts = dealt.groupBy(*keys, "_range").agg(*[F.sum(f"_add_{n}").alias(f"_of_{n}") for n in sums])
    # one row for each key and range it is in: at most as many per key as there are ranges
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), *[
        F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_within_{n}": F.sum(f"_add_{n}").over(upto) for n in sums})
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return summed.join(offsets, same).select(
        *rows.columns, *[(F.col(f"_within_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums])


def shares_at_or_below(rows: DataFrame, score: str, scope: list[str], name: str = "share") -> DataFrame:
    """The rows with the share of their scope's scores at or below their own; nulls count as least.

    Equal scores are one row while they are put in order, however many there are.
    """
    keys = [F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)]
    named = [f"_s{i}" for i in range(len(scope))]
    counted = rows.groupBy(*keys, F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    placed = running_sums(counted, named, ["_score"], {"_upto": F.col("_n")})
    totals = placed.groupBy(*named).agg(F.max("_upto").alias("_all"))
    if named:
        alike = [F.col(f"_t{i}").eqNullSafe(F.col(n)) for i, n in enumerate(named)]
        totals = totals.select(*[F.col(n).alias(f"_t{i}") for i, n in enumerate(named)], "_all")
        on = alike[0]
        for a in alike[1:]:
            on &= a
        placed = placed.join(totals, on).drop(*[f"_t{i}" for i in range(len(named))])
    else:
        placed = placed.crossJoin(F.broadcast(totals))  # one row
    on = F.col(score).eqNullSafe(F.col("_score"))
    for c, n in zip(scope, named):
        on &= F.col(c).eqNullSafe(F.col(n))
    return rows.join(placed, on).select(*rows.columns, (F.col("_upto") / F.col("_all")).alias(name))
