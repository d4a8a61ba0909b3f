"""Rate budgets: windows that begin at a scope's first request, and who is granted.

A scope's window begins with its first request; the next one begins with the
first request at or behind the end of the window before.  So each window depends
on the one before it.  The chain is cut into segments of time: within a segment
it is followed for every request that could be the first of a window there, all
segments at once; then one pass over those few candidates tells where each
segment is really entered.  Instants are whole milliseconds, each kept once per
scope, so a segment holds no more of them than its length, however many requests
there are.

Within a window requests are granted in their order while fewer than the ceiling
are used; the reserve at the end is for priority requests only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums


def _millis(at):
    return F.unix_millis(at.cast("timestamp"))


def _starts_within(times: np.ndarray, first: int, width: int) -> list[int]:
    """Beginnings of windows among sorted instants, the first of them at or behind ``first``."""
    out, at = [], int(np.searchsorted(times, first))
    while at < len(times):
        out.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + width))
    return out


def anchored_windows(requests: DataFrame, seconds: int, segment_windows: int = 32) -> DataFrame:
    """(scope, window_start, segment): where windows of ``seconds`` begin; requests are (scope, at).

    ``window_start`` is in milliseconds; ``segment`` numbers stretches of ``segment_windows`` windows.
    """
    width = seconds * 1000
    length = width * segment_windows
    times = requests.where("scope IS NOT NULL AND at IS NOT NULL").select("scope", _millis(F.col("at")).alias("ms")).distinct()
    times = times.withColumn("segment", F.floor(F.col("ms") / length))

    def leaving(group: pa.Table) -> pa.Table:
        scope, segment = group["scope"][0].as_py(), group["segment"][0].as_py()
        ms = np.sort(group["ms"].to_numpy())
        # a window that began before the segment ends within its first width
        n = min(int(np.searchsorted(ms, segment * length + width)) + 1, len(ms))
        after = np.searchsorted(ms, ms + width)
        leave = ms + width
        for i in np.flatnonzero(after < len(ms))[::-1]:
            leave[i] = leave[after[i]]
        return pa.table({"scope": [scope] * n, "segment": [segment] * n, "ms": ms[:n], "leave": leave[:n]})

    candidates = times.groupBy("scope", "segment").applyInArrow(leaving, "scope string, segment long, ms long, leave long")

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass in order, holding one number: where the next window may begin."""
        scope = segment = None
        free = -(1 << 62)
        for batch in batches:
            rows = []
            for s, g, ms, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != scope:
                    scope, segment, free = s, None, -(1 << 62)
                if g != segment and ms >= free:
                    rows.append((s, g, ms))
                    segment, free = g, leave
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["scope", "segment", "first"])

    ordered = candidates.repartition("scope").sortWithinPartitions("scope", "segment", "ms")
    firsts = ordered.mapInArrow(entered, "scope string, segment long, first long")

    def windows(group: pa.Table, first: pa.Table) -> pa.Table:
        starts: list[int] = []
        if len(first) and len(group):
            starts = _starts_within(np.sort(group["ms"].to_numpy()), first["first"][0].as_py(), width)
        scope, segment = (group["scope"][0].as_py(), group["segment"][0].as_py()) if len(group) else (None, None)
        return pa.table({
            "scope": pa.array([scope] * len(starts), pa.string()), "window_start": pa.array(starts, pa.int64()),
            "segment": pa.array([segment] * len(starts), pa.int64())})

    both = times.groupBy("scope", "segment").cogroup(firsts.groupBy("scope", "segment"))
    return both.applyInArrow(windows, "scope string, window_start long, segment long")


def in_windows(requests: DataFrame, seconds: int, segment_windows: int = 32) -> DataFrame:
    """The requests with the beginning of their window in ``window_start``, in milliseconds.

    A request's window began in its segment or is the last one of an earlier
    segment, so each segment carries a short list of beginnings.  A request
    without a scope or an instant has no window.
    """
    starts = anchored_windows(requests, seconds, segment_windows)
    length = seconds * 1000 * segment_windows
    # a window reaches into the next segment at most
    carried = starts.groupBy("scope", (F.col("segment") + 1).alias("segment")).agg(F.max("window_start").alias("window_start"))
    reach = starts.select("scope", "segment", "window_start").unionByName(carried)
    lists = reach.groupBy(F.col("scope").alias("_scope"), F.col("segment").alias("_segment")).agg(F.collect_list("window_start").alias("_starts"))
    ms = _millis(F.col("at"))
    on = (F.col("scope") == F.col("_scope")) & (F.floor(ms / length) == F.col("_segment"))
    own = F.array_max(F.filter("_starts", lambda s: s <= ms))
    return requests.join(lists, on, "left").select(*requests.columns, own.alias("window_start"))


def grant(rows: DataFrame, keys: list[str], order: list[str], ceiling: int, reserve: int, ranges: int | None = None) -> DataFrame:
    """``granted`` for each row (boolean ``priority``): whether the window ``keys`` had room for it.

    All are granted up to the ceiling less the reserve.  Behind that only
    priority requests are, as many as the reserve holds.  Two running counts
    tell: of all rows, and of priority rows behind the common part.
    """
    usable = max(ceiling - reserve, 0)
    counted = running_sums(rows, keys, order, {"_place": F.lit(1), "_urgent": F.coalesce(F.col("priority"), F.lit(False)).cast("int")}, ranges)
    # priority rows within the common part: as many as there are up to its last row
    common = counted.where(F.col("_place") <= usable).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max("_urgent").alias("_common"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    behind = F.col("_urgent") - F.coalesce("_common", F.lit(0))
    granted = (F.col("_place") <= usable) | (F.coalesce(F.col("priority"), F.lit(False)) & (behind <= ceiling - usable))
    return counted.join(common, on, "left").select(*rows.columns, granted.alias("granted"))
