"""Pages behind a cursor that open only the files they need.

Rows are written once in the order of the cursor, in ranges, with an index of the
least and greatest key of each file.  A page then reads the index, takes files in
their order until they hold as many rows as it wants, and opens no other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(rows: DataFrame, order: list[str], path: str, files: int = 32) -> None:
    """The rows in files that follow one another in ``order``, and the index beside them."""
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    key = F.struct(*order)
    back = rows.sparkSession.read.parquet(f"{path}/rows").withColumn("_file", F.input_file_name())
    index = back.groupBy("_file").agg(F.min(key).alias("least"), F.max(key).alias("greatest"), F.count("*").alias("rows"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


@dataclass
class Page:
    """The rows of a page in their order, and the files it opens."""

    rows: DataFrame
    files: list[str]


def read_page(spark: SparkSession, path: str, order: list[str], size: int, after: Column | None = None, upto: Column | None = None) -> Page:
    """Up to ``size`` rows behind ``after`` and up to ``upto``, both structs of the order's columns.

    Files are taken in order until those wholly inside the bounds have ``size``
    rows: each has a row at least, so no more than ``size`` and two are looked at.
    """
    index, rows = spark.read.parquet(f"{path}/index"), spark.read.schema(spark.read.parquet(f"{path}/rows").schema)

    def cursor(bound: Column, like: str) -> Column:
        return bound.cast(index.schema[like].dataType)

    if after is not None:
        index = index.where(F.col("greatest") > cursor(after, "least"))
    if upto is not None:
        index = index.where(F.col("least") <= cursor(upto, "least"))
    inside = F.lit(True)
    if after is not None:
        inside &= F.col("least") > cursor(after, "least")
    if upto is not None:
        inside &= F.col("greatest") <= cursor(upto, "least")
    files, held = [], 0
    for f in index.select("_file", F.when(inside, F.col("rows")).otherwise(0).alias("n"), "least").orderBy("least").limit(size + 2).collect():
        if held >= size:
            break
        files.append(f["_file"])
        held += f.n
    found = rows.parquet(*files) if files else spark.createDataFrame([], spark.read.parquet(f"{path}/rows").schema)
    first = F.col(order[0])
    shape = F.struct(*order)
    if after is not None:
        found = found.where((shape > after) & (first >= after.getField("col1")))
    if upto is not None:
        found = found.where((shape <= upto) & (first <= upto.getField("col1")))
    return Page(found.orderBy(*order).limit(size), files)
