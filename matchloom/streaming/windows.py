"""Rate windows in a stream: each begins with the first request behind the one before.

State is kept per scope: where its window began and how many requests it has
seen.  A window comes out once, when a request at or behind its end arrives.
Requests of one slice are put in order of time; a request that comes after a
later one of an earlier slice counts in the window that is open when it arrives,
as a counter would count it.  The batch form is ``operators.budgets``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State that outlives a task is kept by this provider; it is the one that typed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "scope string, window_start long, used long"


class AnchoredWindows(StatefulProcessor):
    """(scope, window_start, used) of each window that has ended; times in milliseconds."""

    def __init__(self, seconds: int):
        self.width = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "begun long, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.window.get() if self.window.exists() else None
        begun, used = held if held is not None else (None, 0)
        # instants of one slice, each with the number of its requests
        for ms, n in sorted((r.ms, r.n) for r in rows):
            if begun is not None and ms >= begun + self.width:
                yield Row(scope=key[0], window_start=begun, used=used)
                begun, used = None, 0
            begun, used = (ms if begun is None else begun), used + n
        self.window.update((begun, used))

    def close(self) -> None:
        pass


def ended_windows(requests: DataFrame, seconds: int) -> DataFrame:
    """Windows of a stream of requests (scope, at) that have ended; needs ``PROVIDER``."""
    timed = requests.where("scope IS NOT NULL AND at IS NOT NULL").select(
        "scope", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), F.lit(1).cast("long").alias("n"))
    return timed.groupBy("scope").transformWithState(AnchoredWindows(seconds), SCHEMA, "Append", "None")


@contextmanager
def provider(spark: SparkSession):
    """Within, streams that start keep their state with ``PROVIDER``."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)
