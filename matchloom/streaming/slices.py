"""Aggregation in resumable slices: state that grows by what is new.

A slice is a micro-batch of landed files.  It is folded to partial aggregates
and stored as one delta under the number of the batch; what has been aggregated
so far is the merge of all deltas, so a run reads only files that are new and
writes only what they hold.  The stream's checkpoint moves on once the delta is
whole: state and cursor stand under one number.  A slice that dies in between is
done again under the same number and replaces its own delta, so nothing counts
twice.  Deltas are merged into a base from time to time; a base counts only
those deltas that are not in it.

A folder has one writer at a time, as a stream's checkpoint has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars
from ..operators import aggregate

#: How columns of one group are merged; all are associative and commutative.
MERGES = {"sum": F.sum, "max": F.max, "min": F.min, "any": F.bool_or, "bits": F.bit_or}


@dataclass(frozen=True)
class Mergeable:
    """Keys of a group, and how each of its other columns is merged."""

    keys: tuple[str, ...]
    columns: dict[str, str]

    def fold(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[MERGES[how](c).alias(c) for c, how in self.columns.items()])


class StateFolder:
    """Deltas by batch number and the base that older ones were merged into."""

    def __init__(self, spark: SparkSession, path: str, shape: Mergeable, schema: StructType, merge_every: int = 8):
        self.spark, self.path, self.shape, self.schema, self.merge_every = spark, path.rstrip("/"), shape, schema, merge_every
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _whole(self, kind: str) -> list[int]:
        """Numbers whose write has ended; one that broke off has no mark of success."""
        top = self._jpath(f"{self.path}/{kind}")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        return [n for n in numbers if self._fs.exists(self._jpath(f"{self.path}/{kind}/batch={n}/_SUCCESS"))]

    def _parts(self) -> tuple[int, list[str]]:
        base = max(self._whole("base"), default=-1)
        deltas = [n for n in self._whole("delta") if n > base]
        paths = [f"{self.path}/delta/batch={n}" for n in deltas]
        return len(deltas), ([f"{self.path}/base/batch={base}"] if base >= 0 else []) + paths

    def add(self, partials: DataFrame, number: int) -> None:
        """Store the slice's partial aggregates; the same number replaces what it wrote before."""
        partials.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/delta/batch={number}")
        if self._parts()[0] >= self.merge_every:
            self.merge(number)

    def merge(self, number: int) -> None:
        """Fold everything up to ``number`` into one base, then drop what it holds."""
        self.read().write.mode("overwrite").parquet(f"{self.path}/base/batch={number}")
        for kind in ("base", "delta"):
            for old in self._whole(kind):
                if old < number or (kind == "delta" and old == number):
                    self._fs.delete(self._jpath(f"{self.path}/{kind}/batch={old}"), True)

    def read(self) -> DataFrame:
        _, paths = self._parts()
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.shape.fold(self.spark.read.schema(self.schema).parquet(*paths)).select(*self.schema.names)


@dataclass(frozen=True)
class Run:
    """What one run did: slices, and rows read from the stream."""

    slices: int
    rows: int


def run_slices(stream: DataFrame, state: StateFolder, partials: Callable[[DataFrame, int], DataFrame], checkpoint: str) -> Run:
    """All slices that are there, then stop.

    ``partials`` folds the rows of a slice; its second argument is the number of the batch.
    """
    def one(batch: DataFrame, number: int) -> None:
        batch.persist()  # a slice is read once, whatever is made of it
        try:
            state.add(state.shape.fold(partials(batch, number)), number)
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"] > 0]
    return Run(len(done), sum(p["numInputRows"] for p in done))


# ---- statistics by entity, mode and version -----------------------------

MODE_STATS = Mergeable(
    ("entity_id", "mode", "version"), {"matches": "sum", "wins": "sum", "losses": "sum", "draws": "sum", "latest": "max"})
MODE_SCHEMA = "entity_id long, mode string, version string, matches long, wins long, losses long, draws long, latest timestamp_ntz"
WAITING_SCHEMA = "match_id long, entity_id long, team_id long"


class ModeStatistics:
    """Per-mode statistics kept by slices of participations.

    A participation whose match has not landed yet waits and is tried again with
    the next slice.  Entities that are not active are counted as well and left
    out on reading, so that a change of that flag needs no second count.
    """

    def __init__(self, spark: SparkSession, folder: str, matches: Callable[[], DataFrame], teams: Callable[[], DataFrame], merge_every: int = 8):
        self.spark, self.folder, self.matches, self.teams = spark, folder.rstrip("/"), matches, teams
        self.state = StateFolder(spark, f"{self.folder}/state", MODE_STATS, StructType.fromDDL(MODE_SCHEMA), merge_every)

    def waiting(self, number: int) -> DataFrame:
        path, root = f"{self.folder}/waiting/batch={number}", self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)):
            return self.spark.createDataFrame([], WAITING_SCHEMA)
        return self.spark.read.schema(WAITING_SCHEMA).parquet(path)

    def _partials(self, batch: DataFrame, number: int) -> DataFrame:
        rows = batch.select("match_id", "entity_id", "team_id").unionByName(self.waiting(number - 1))
        matches, teams = self.matches(), self.teams()
        rows.join(matches.select("match_id"), "match_id", "left_anti").write.mode("overwrite").parquet(f"{self.folder}/waiting/batch={number}")
        facts = aggregate.participation_facts(rows, matches, teams).where("mode IS NOT NULL")
        return facts.groupBy("entity_id", "mode", "version").agg(*aggregate.outcomes(), F.max("occurred_at").alias("latest"))

    def run(self, participations: DataFrame) -> Run:
        """Take up the stream where the last run ended."""
        return run_slices(participations, self.state, self._partials, f"{self.folder}/cursor")

    def read(self, entities: DataFrame) -> DataFrame:
        stats = self.state.read().join(entities.where("is_active").select("entity_id"), "entity_id", "left_semi")
        return stats.withColumn("win_rate", scalars.win_rate(F.col("wins"), F.col("losses")))
