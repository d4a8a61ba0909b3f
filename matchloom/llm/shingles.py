"""Links between texts whose sets of word shingles reach a Jaccard similarity.

Candidates come from prefixes, which miss no pair: with shingles in any one
order that all texts share, two sets of similarity t have a shingle in common
among the first n - ceil(t * n) + 1 of each.  Shingles that are frequent over
all texts come last, so passages that many texts share are rarely in a prefix.
The counts decide the order only, which changes the cost and no result.

A pair is a candidate if it passes three exact bounds on its similarity: the
sizes of the sets; the places in both prefixes of the shingle it was found by
(where that is the first they have in common, and such a shingle exists for
every pair); and the bits in which parity signatures differ, never more than
the elements that only one set has.  Candidates are verified on whole texts.

Texts that share a shingle are first compared with one of them, the one that
shares most of its prefix with others, which links groups of copies to the
text they were made from; then, after more such rounds where asked for, all
candidate pairs that are not linked yet.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize
from .simhash import _LOWER, connected_components

#: Bits of a parity signature, in longs.
SIGNATURE_LONGS = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words met before, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 80_000:
            self.clear()
        made = self[word] = xxh64_intdigest(word, 7)
        return made


_WORDS = _WordHashes()


def forget() -> None:
    """Give back what this worker holds of words."""
    _WORDS.clear()


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the different word shingles; one of all words if there are fewer."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    made = hashes[:n] + np.uint64(size)
    for i in range(1, size):
        made = (made ^ (made >> np.uint64(29))) * _MIX + hashes[i : i + n]
    return np.unique(((made ^ (made >> np.uint64(32))) * _MIX).view(np.int64))


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The least shingles by (times counted, hash), in that order."""
    if not len(shingles):
        return shingles
    # a hair below, so that rounding never shortens a prefix
    size = len(shingles) - ceil(similarity * len(shingles) - 1e-9) + 1
    if not len(common):
        return shingles[:size]
    place = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    often = np.where(common[place] == shingles, seen[place], 0)
    return shingles[np.argsort(often, kind="stable")[:size]]


def signature(shingles: np.ndarray, least_bits: int = 0) -> np.ndarray:
    """Parity of the number of shingles in each of the bits, as longs; ``least_bits`` are doubled up to.

    The exclusive or of a signature's halves is the signature of half as many bits.
    """
    bits = 64 * SIGNATURE_LONGS
    while bits < least_bits:
        bits *= 2
    odd = np.bincount((shingles.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def often_seen(
    docs: DataFrame, text_col: str, shingle: int, least: int = 8, window: int = 1_000_000, most: int = 200_000
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are frequent, and how often all texts have them.

    Every text is counted.  A task counts ``window`` shingles at a time and
    passes on those that occur ``least`` times among them; the ``most``
    frequent sums, a fixed bound, are what the order of all tasks follows.
    """

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
        kept = times >= least
        return pa.RecordBatch.from_arrays([pa.array(found[kept]), pa.array(times[kept].astype(np.int64))], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), shingle))
                size += len(held[-1])
                if size >= window:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)
        forget()

    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "h long, n long")
    counts = counts.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most)
    rows = sorted((r[0], r[1]) for r in counts.toLocalIterator())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _differ(x: Column, y: Column) -> Column:
    """Bits in which two signatures differ, the longer one folded to the shorter."""
    def xor(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))

    def half(a: Column) -> Column:
        size = F.shiftright(F.size(a), 1)
        return xor(F.slice(a, F.lit(1), size), F.slice(a, size + 1, size))

    both = F.when(F.size(x) > F.size(y), xor(half(x), y)).when(F.size(x) < F.size(y), xor(x, half(y))).otherwise(xor(x, y))
    return F.aggregate(both, F.lit(0), lambda total, p: total + F.bit_count(p))


def similar(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int, broadcast_nodes: int) -> DataFrame:
    """The pairs (a, b) whose texts, by (node, text), reach the similarity.

    Texts are fetched for nodes of pairs only: behind a broadcast of their
    numbers where these are ``broadcast_nodes`` at most, by a join of both
    sides beyond.
    """
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "shingle-needed")
    few = needed.count() <= broadcast_nodes
    held = materialize(texts.join(F.broadcast(needed) if few else needed, "node", "left_semi"), "shingle-texts")
    left = held.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = held.select(F.col("node").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=256)(lambda text: shingle_set(text, shingle))
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = known(x.as_py()), known(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    found = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")
    with arrow_rows(pairs.sparkSession, 100):
        out = materialize(found, "shingle-links")
    discard(held)
    discard(needed)
    return out


def _bounds(similarity: float, x: str, y: str, signed: bool) -> Column:
    """Whether two members of a shingle can reach the similarity, by their signatures too where they have them."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    least = similarity / (1 + similarity) * (n + m) - 1e-6  # of elements in common
    sizes = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6
    places = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place")) >= least
    if not signed:
        return sizes & places
    differ = sum(
        (F.bit_count(F.get(f"{x}.sign", F.lit(i)).bitwiseXOR(F.get(f"{y}.sign", F.lit(i)))) for i in range(SIGNATURE_LONGS)),
        F.lit(0),
    )
    return sizes & places & (differ <= n + m - 2 * least)


def similar_pairs(
    nodes: DataFrame, texts: DataFrame, similarity: float = 0.8, shingle: int = 5, star_rounds: int = 1,
    broadcast_nodes: int = 1_000_000, candidates: DataFrame | None = None,
) -> DataFrame:
    """Links (a, b) between nodes of ``nodes`` (node, n, keys, sign, fine) with texts in ``texts`` (node, text).

    ``candidates`` (a, b) of another search are verified with the first round.

    Every pair of the similarity is linked directly or through other links.
    ``n`` is the size of the shingle set, ``keys`` its prefix, ``sign`` and
    ``fine`` its signatures.
    """
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("place", "key"))
    # one exchange of the prefixes; nearly all shingles are seen once and end here
    shared = keyed.withColumn("count", F.count("*").over(Window.partitionBy("key"))).where("count > 1")
    shared = materialize(shared, "shingle-shared")
    weight = shared.groupBy("node").agg((F.sum(F.log2("count")) / (1 + F.floor((1 - similarity) * F.first("n")))).alias("weight"))
    # members stay narrow: their signatures are fetched where pairs are few, or by the last round
    members = materialize(shared.drop("count").join(weight, "node").withColumn("root", F.col("node")), "shingle-members")
    discard(shared)
    whole = F.struct("node", "n", "place", "root")
    links = None

    def verified(pairs: DataFrame) -> DataFrame:
        distinct = pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
        # signatures that grow with the text, for pairs that are left
        for side in ("a", "b"):
            distinct = distinct.join(nodes.select(F.col("node").alias(side), F.struct("n", "fine").alias(f"of_{side}")), side)
        distinct = distinct.where(
            _differ(F.col("of_a.fine"), F.col("of_b.fine")) <= (1 - similarity) / (1 + similarity) * (F.col("of_a.n") + F.col("of_b.n")) + 1e-6)
        distinct = materialize(distinct.select("a", "b"), "shingle-pairs")
        out = similar(distinct, texts, similarity, shingle, broadcast_nodes)
        discard(distinct)
        return out if links is None else links.union(out)

    for number in range(star_rounds + 1):
        if links is not None:
            roots = connected_components(links).withColumnRenamed("root", "found")
            rooted = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("found", "node")).drop("found")
            rooted = materialize(rooted, "shingle-rooted")
            mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
            left = materialize(rooted.join(mixed, "key", "left_semi"), "shingle-unlinked")
            discard(rooted)
            discard(members)
            members = left
        if number < star_rounds:
            # at first what shares most, then chosen by hash among those
            order = F.struct(-F.round("weight", 3 if number == 0 else 0), F.xxhash64(F.lit(number), "node"), "node")
            x = members.select("key", whole.alias("x"))
            y = members.groupBy("key").agg(F.min_by(whole, order).alias("y"))
            other = F.col("x.root") != F.col("y.root")
        else:
            signed = members.select("key", "node", "n", "place", "root").join(nodes.select("node", "sign"), "node")
            signed = materialize(signed, "shingle-signed")
            discard(members)
            members = signed
            whole = F.struct("node", "n", "place", "sign", "root")
            x, y = (members.select("key", whole.alias(side)) for side in ("x", "y"))
            other = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
        on = (F.col("l.key") == F.col("r.key")) & other & _bounds(similarity, "x", "y", number == star_rounds)
        pairs = x.alias("l").join(y.alias("r"), on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        if number == 0 and candidates is not None:
            pairs = pairs.union(candidates.select("a", "b"))
        links = verified(pairs)
    discard(members)
    return links
