"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder.

    The written table survives the loss of any executor, and what reads it
    starts from plain files, so both sides of a later join are exchanged and
    adaptive execution can split a hot key there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    # its exchanges are files that nothing reads again once the table is whole
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._matchloom_path = path
    return out


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Within, a setting of the session has this value."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, most: int):
    """Within, Arrow batches hold ``most`` rows: for rows that can be very large."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(most))


def small_batches(spark: SparkSession, most: int = 500) -> None:
    """From now on Arrow batches of the session hold ``most`` rows at most.

    For jobs of several Python stages: a worker keeps what its largest batch
    took, and stages that run one after the other share their workers.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(df, "_matchloom_path", None)
    if path is None:
        return
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column has, for columns of an operator's own."""
    prefix = "_ml"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def others(columns: list[str], *added: str) -> list[str]:
    """The columns that stay beside added ones: those of the same name, in any case, give way."""
    taken = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in taken]


def map_beside(df: DataFrame, run, added: list[StructField]) -> DataFrame:
    """``mapInArrow`` that adds columns, whatever the names of the others.

    ``run`` sees plain names (a dot in a name stops ``mapInArrow``) and gives
    the batch's columns, then the added ones.
    """
    def released(batches):
        import pyarrow as pa

        for out in run(batches):
            yield out
            # several stages run in one worker; what this batch took is given back
            pa.default_memory_pool().release_unused()

    plain = [f"c{i}" for i in range(len(df.columns))]
    same = [StructField(n, f.dataType, True) for n, f in zip(plain, df.schema.fields, strict=True)]
    out = df.toDF(*plain).mapInArrow(released, StructType([*same, *added]))
    return out.toDF(*df.columns, *[a.name for a in added])


def crc32_text(col: Column) -> Column:
    """CRC-32 of a value's decimal text."""
    return F.crc32(col.cast("string").cast("binary"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array<int>, in blocks.

    A fold that appends copies its array at each step.  Blocks of ``block``
    keep those copies short, so long arrays stay close to linear.
    """

    def running(arr: Column) -> Column:
        return F.aggregate(
            arr,
            F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums")),
            lambda acc, x: F.struct(
                (acc["total"] + x).alias("total"),
                F.concat(acc["sums"], F.array(acc["total"] + x)).alias("sums"),
            ),
            lambda acc: acc["sums"],
        )

    def joined(blocks: Column) -> Column:
        base = F.concat(F.array(F.lit(0)), running(F.transform(blocks, lambda sums: F.element_at(sums, -1))))
        return let(base, lambda base: F.flatten(
            F.transform(blocks, lambda sums, i: let(F.get(base, i), lambda before: F.transform(sums, lambda x: x + before)))
        ))

    def cut(values: Column) -> Column:
        return let(F.transform(
            F.sequence(F.lit(1), F.size(values), F.lit(block)), lambda at: running(F.slice(values, at, F.lit(block)))
        ), joined)

    return F.when(F.size(values) > 0, let(values, cut)).otherwise(F.array().cast("array<int>"))
