"""SimHash near-duplicate detection.

Fingerprints are cut into blocks; two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` whole blocks, so rows
are joined on every choice of that many blocks and then verified by their
Hamming distance.

Work is done on distinct fingerprints, so exact copies never multiply.  A
bucket with more than ``pair_limit`` distinct fingerprints would give all
pairs within a group; its members are linked another, equally exact way that
stays linear: fingerprints at distance two or less share a neighbour at
distance one or less, so each member emits itself and its 64 one-bit
neighbours, and all that share such a key are linked to the least of them.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; a null id takes part in linking but is never the id of a component
(null if all ids of the component are null); repeated rows give repeated
results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def simhash64(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        n = min(_CHUNK, total - at)
        part = words[at : at + n + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
        hashes = np.fromiter((xxh64_intdigest(b" ".join(g), 42) for g in grams), np.uint64, n)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every row, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash64(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """array<long> of one key for each choice of blocks - distance blocks.

    A key packs the bits of the chosen blocks side by side, at most 56 of
    them, below the number of the choice, so keys of two choices never meet.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key, width = F.lit(0).cast("long"), 0
        for b in chosen:
            size = edges[b + 1] - edges[b]
            piece = F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << size) - 1))
            key, width = key.bitwiseOR(F.shiftleft(piece, width)), width + size
        if width > 56:
            raise ValueError("too few blocks are left out for keys of one long")
        keys.append(key.bitwiseOR(F.lit(n << 56)))
    return F.array(*keys)


def near_pairs(
    fps: DataFrame, distance: int = 2, blocks: int = 5, pair_limit: int = 32
) -> DataFrame:
    """Links (a, b), a > b in signed order, between distinct fingerprints.

    Every pair within ``distance`` is linked directly or through other links
    of this result, and each link is between fingerprints within ``distance``.
    """
    if distance != 2:
        raise ValueError("crowded buckets are resolved for distance two")
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("key"))
    shared = materialize(keyed.groupBy("key").count().where("count > 1"), "simhash-buckets")
    members = materialize(keyed.join(shared, "key").select("key", "fp", "count"), "simhash-members")

    few = members.where(F.col("count") <= pair_limit)
    left = few.select("key", F.col("fp").alias("a"))
    right = few.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where(
        (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    ).select("a", "b")

    crowded = members.where(F.col("count") > pair_limit).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    spread = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("near"))
    least = materialize(
        spread.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("near", "b"),
        "simhash-near",
    )
    stars = spread.join(least, "near").where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), root the least node.

    Large-star and small-star steps until nothing changes.  A step is a
    minimum for each node, joined back to the edges; no group is collected.
    """
    edges = materialize(edges.where("a <> b"), "components")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(edges)
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "components")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low).where("a <> b").distinct()
        )
        small = materialize(small, "components")
        now = state(small)
        discard(edges)
        discard(large)
        edges = small
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 2,
    blocks: int = 5,
    pair_limit: int = 32,
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id that links reach, the row's own included.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-firsts")
    roots = materialize(
        connected_components(near_pairs(firsts.select("fp"), distance, blocks, pair_limit)), "simhash-roots"
    )
    least = (
        roots.join(firsts, roots["node"] == firsts["fp"]).groupBy("root").agg(F.min("first_id").alias("component_id"))
    )
    linked = roots.join(materialize(least, "simhash-least"), "root").select(F.col("node").alias("fp"), "component_id")
    labels = firsts.join(materialize(linked, "simhash-linked"), "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id")
    )
    return rows.join(materialize(labels, "simhash-labels"), "fp").select("doc_id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
