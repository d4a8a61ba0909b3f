"""One row of each group of near-duplicate texts.

Texts are near-duplicates if the Jaccard similarity of their word shingles
reaches the one given, or, where none is given, if their SimHash fingerprints
differ in at most two bits; links are followed.  With a similarity, fingerprints
only propose: a pair is linked when its whole texts were compared, so texts of
few different words, whose fingerprints are close by chance, stay.  Groups are
told apart by what the texts hold, never by id.

Edge cases: null and empty texts are one group; the row of the least id stays,
a row without an id only if its group has no id, and of rows alike in both the
one of the least text hash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from . import shingles, simhash
from .common import discard, map_beside, materialize


def _fingerprinted(docs: DataFrame, place: int, similarity: float | None, shingle: int) -> DataFrame:
    """The rows beside fp, shape (a hash of the shingle set), n, keys, sign and fine."""
    order = shingles.often_seen(docs, docs.columns[place], shingle) if similarity else None
    sent = docs.sparkSession.sparkContext.broadcast(order)
    added = [StructField("fp", LongType()), StructField("shape", LongType()), StructField("n", IntegerType()),
             StructField("keys", ArrayType(LongType())), StructField("sign", ArrayType(LongType())),
             StructField("fine", ArrayType(LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        longs = pa.list_(pa.int64())
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            made = []
            for value in batch.column(place):
                text = value.as_py()
                s = shingles.shingle_set(text if similarity else None, shingle)
                keys = shingles.prefix(s, similarity, *sent.value) if len(s) else s
                made.append((simhash.simhash64(text), xxh64_intdigest(s.tobytes()), len(s), keys, shingles.signature(s), shingles.signature(s, len(s))))
            fp, shape, n, keys, sign, fine = zip(*made, strict=True) if made else [()] * 6
            columns = [
                *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, shape)],
                pa.array(n, pa.int32()), pa.array(keys, longs), pa.array(sign, longs), pa.array(fine, longs),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[a.name for a in added]])
        shingles.forget()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return map_beside(plain, run, added).withColumn("row", F.monotonically_increasing_id())


def _similar_nodes(rows: DataFrame, firsts: DataFrame, own_text: Column, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) between nodes whose texts reach the similarity.

    Near fingerprints are the first candidates: for each fingerprint one node
    stands for all that have it, and the others are candidates with that one.
    Like all candidates they are verified on whole texts.  What they miss, the
    search by prefixes finds.
    """
    nodes = rows.where("n > 0").select(F.col("row").alias("node"), "fp", "n", "keys", "sign", "fine")
    nodes = materialize(nodes.join(firsts.select("node"), "node", "left_semi"), "dedup-nodes")
    one = materialize(nodes.groupBy("fp").agg(F.min("node").alias("one")), "dedup-one")
    near = simhash.near_pairs(one.select("fp"))
    near = near.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.select("node", "fp").join(one, "fp").where("node <> one").select(F.col("node").alias("a"), F.col("one").alias("b"))
    texts = rows.select(F.col("row").alias("node"), own_text.alias("text"))
    links = shingles.similar_pairs(nodes, texts, similarity, shingle, candidates=near.union(same))
    discard(nodes)
    discard(one)
    return links


def keep_one(
    docs: DataFrame, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were."""
    at_id, place = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = materialize(_fingerprinted(docs, place, similarity, shingle), "dedup-rows")
    own_id, own_text = F.col(f"c{at_id}"), F.col(f"c{place}")
    least = F.struct(own_id.isNull().alias("none"), own_id.alias("id"), F.xxhash64(own_text).alias("hash"), "row")
    if similarity:
        # texts with the same shingles are one node
        firsts = materialize(rows.groupBy("shape").agg(F.min(least).alias("first"), F.min("row").alias("node")), "dedup-firsts")
        links = _similar_nodes(rows, firsts, own_text, similarity, shingle)
    else:
        firsts = materialize(rows.groupBy(F.col("fp").alias("node")).agg(F.min(least).alias("first")), "dedup-firsts")
        links = simhash.near_pairs(firsts.select(F.col("node").alias("fp")))
    roots = materialize(simhash.connected_components(links), "dedup-roots")
    grouped = firsts.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    winners = materialize(grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.row"), "dedup-kept")
    discard(roots)
    discard(firsts)
    # those that go are the fewer: while Spark finds their numbers small, texts are not exchanged
    gone = materialize(rows.select("row").join(winners, "row", "left_anti"), "dedup-gone")
    discard(winners)
    kept = rows.join(gone, "row", "left_anti").select([f"c{i}" for i in range(len(docs.columns))])
    return kept.toDF(*docs.columns)
