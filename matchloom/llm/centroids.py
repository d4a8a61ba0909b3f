"""Centroid clustering of integer vectors with one upper and one lower bound each.

Every vector keeps, beside its cluster, an upper bound of the distance to its
own centroid and a lower bound of the distance to the second-nearest one.  When
centroids move, the upper bound grows by the drift of the own centroid and the
lower bound falls by the greatest drift of the others.  While the upper bound
stays below the lower one, or below half the distance from the own centroid to
the centroid next to it, the cluster cannot have changed and no distance is
worked out.  Where neither holds, the distance to the own centroid is worked out
first; vectors that are ambiguous still get a full scan in exact integers.

Bounds are floats, loosened by more than they can err, and only tell which
vectors need no scan: clusters, distances and centroids are exact.  Each round
writes vectors and bounds to the shared folder; sums of a round are folded in
tasks, so what the driver sees is one row per cluster.

Edge cases: vectors of another length, or with a null or non-finite component,
are left out; rows without an id take part, but start a centroid only where
fewer rows with an id than centroids are there; repeated rows count each; fewer
vectors than centroids give fewer centroids; an empty table gives no rows.
Components are integers of less than 2 ** 26 after scaling, so that squared
distances are exact longs; a greater one raises an error that says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

STATE = "vec_id long, vector array<int>, cluster int, upper double, lower double, distance long"
_NAMES = [f.split()[0] for f in STATE.split(", ")]
_WIDEST = 1 << 26
#: What a square root and a sum of floats may err by, many times over.
_SLACK = 1e-9


def integer_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 64
) -> DataFrame:
    """(vec_id, vector): floor(scale * component) of the vectors that are kept."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("_v"))
    rows = rows.where((F.size("_v") == size) & F.forall("_v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    whole = F.transform("_v", lambda x: F.floor(x * scale))
    checked = F.when(
        F.forall("_v", lambda x: F.abs(x * scale) < _WIDEST), whole.cast("array<int>")
    ).otherwise(F.raise_error(F.lit("a component is too wide for exact distances in longs")).cast("array<int>"))
    return rows.select("vec_id", checked.alias("vector"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The vectors of the ``k`` least hashes of their ids, in that order; a top-k of k rows."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return np.array([r.vector for r in rows.orderBy(order, "vector").select("vector").limit(k).collect()], np.int64)


def exact_scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance, and that of the second-nearest."""
    squares = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    rows, near = np.arange(len(vectors)), squares.argmin(axis=1)
    best = squares[rows, near]
    if len(centroids) == 1:
        return near, best, np.full(len(vectors), np.iinfo(np.int64).max)
    squares[rows, near] = np.iinfo(np.int64).max
    return near, best, squares.min(axis=1)


class Bounds:
    """Centroids, how far each moved, and half the distance from each to the one next to it."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(float))
        self.drift = moved * (1 + _SLACK)
        # the greatest drift of any other centroid than the own one
        self.others = np.array([max(np.delete(self.drift, i), default=0.0) for i in range(len(centroids))])
        apart = np.array([[((a - b) ** 2).sum() for b in centroids] for a in centroids], float)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(axis=1)) / 2 * (1 - _SLACK)

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """cluster, upper and lower after the move, and how many vectors were scanned."""
        cluster = cluster.copy()
        upper = upper + self.drift[cluster]
        lower = lower - self.others[cluster]
        safe = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper >= safe)
        own = ((vectors[open_] - self.centroids[cluster[open_]]) ** 2).sum(axis=1)
        upper[open_] = np.sqrt(own.astype(float)) * (1 + _SLACK)
        open_ = open_[upper[open_] >= safe[open_]]
        if len(open_):
            near, best, second = exact_scan(vectors[open_], self.centroids)
            cluster[open_] = near
            upper[open_] = np.sqrt(best.astype(float)) * (1 + _SLACK)
            lower[open_] = np.sqrt(second.astype(float)) * (1 - _SLACK)
        return cluster, upper, lower, len(open_)


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size).astype(np.int64)


def _round(rows: DataFrame, bounds: Bounds, first: bool, last: bool) -> DataFrame:
    """The state after one assignment; exact distances in the last one only."""
    sent = rows.sparkSession.sparkContext.broadcast(bounds)  # k centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        for batch in batches:
            vectors = _matrix(batch.column(1), now.centroids.shape[1])
            if first:
                cluster, best, second = exact_scan(vectors, now.centroids)
                upper, lower = np.sqrt(best.astype(float)) * (1 + _SLACK), np.sqrt(second.astype(float)) * (1 - _SLACK)
            else:
                state = [batch.column(i).to_numpy() for i in (2, 3, 4)]
                cluster, upper, lower, _ = now.assign(vectors, *state)
            exact = ((vectors - now.centroids[cluster]) ** 2).sum(axis=1) if last else np.zeros(len(vectors), np.int64)
            arrays = [pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(exact)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], _NAMES)

    return rows.mapInArrow(run, STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floors of exact means, empty clusters as they were."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
        for batch in batches:
            vectors, cluster = _matrix(batch.column(0), size), batch.column(1).to_numpy()
            for c in np.unique(cluster):
                chosen = vectors[cluster == c]
                counts[c] += len(chosen)
                sums[c] += chosen.sum(axis=0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"])

    parts = state.select("vector", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # one row a cluster
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(size)]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vector, cluster, distance) of rows (vec_id, vector), and the final centroids.

    Each of ``rounds`` rounds assigns and moves; then all are assigned once more.
    """
    kept = materialize(vectors, "centroid-vectors")
    centroids, before = first_centroids(kept, k), None
    if not len(centroids):
        empty = kept.selectExpr("vec_id", "vector", "CAST(null AS int) AS cluster", "CAST(null AS long) AS distance")
        return empty, centroids
    state = kept
    for number in range(rounds + 1):
        last = number == rounds
        after = materialize(_round(state, Bounds(centroids, before), number == 0, last), "centroid-state")
        discard(state)
        state = after
        if not last:
            before, centroids = centroids, _moved(state, centroids)
    return state.select("vec_id", "vector", "cluster", "distance"), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(integer_vectors(table(spark, sf_dir, "embeddings")))
    hashes = [(i, sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row a cluster on these sides, by construction
    sums = sums.crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia")))).join(F.broadcast(named), "cluster")
    return found.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, unnest(range({size})) AS i, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT k, unnest(range({size})) AS i, unnest(v) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS k, v FROM kept) WHERE k < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, k, d FROM (
    SELECT p.r, c.k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM parts p JOIN c{n} c USING (i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM c{n} c LEFT JOIN (
    SELECT a.k, p.i, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n FROM a{n} a JOIN parts p USING (r) GROUP BY ALL) m USING (k, i))""")
    return f"""WITH {','.join(steps)},
named AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT kept.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN named USING (k)"""


QUERIES = {"op11_centroids": op11_centroids}
ORACLE_SQL = {"op11_centroids": _oracle()}
