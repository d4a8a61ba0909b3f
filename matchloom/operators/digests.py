"""Digests that tell whether two tables are alike, and where they differ.

Digests of sets are sums over rows of two independent 64-bit hashes: they fold
in any order and in parallel, and a lost, a doubled and a changed row each show.
``find_differences`` goes down a tree of key ranges and reads again only what
differs; ``ordered_digests`` hashes the ordered rows of a parent slice by slice.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums

WIDE = "decimal(38,0)"
_RANGE = Decimal(1 << 64)


def row_text(columns: list[str]) -> Column:
    """The row as text: a null and its name in letters differ, and so do 'a|b' and 'a', 'b'."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})


def two_hashes(columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes of a row."""
    text = row_text(columns)
    strong = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast(WIDE)
    return [F.xxhash64(text).cast(WIDE).alias("_h1"), strong.alias("_h2")]


def content_sums(columns: list[str]) -> list[Column]:
    """rows, digest_1, digest_2 of a group of rows, as aggregates; sums wrap at 64 bits."""
    one, two = two_hashes(columns)
    return [
        F.count("*").alias("rows"),
        *[F.pmod(F.coalesce(F.sum(h), F.lit(0).cast(WIDE)), F.lit(_RANGE)).cast("decimal(20,0)").alias(n)
          for h, n in ((one, "digest_1"), (two, "digest_2"))],
    ]


# ---- a tree over key ranges ---------------------------------------------


@dataclass
class Search:
    """Where two tables differ, and how many rows each look read.

    ``reads``: rows of both sides of the first pass over all, of each look at
    ranges that differ, and of the comparison at the end.
    """

    rows: DataFrame
    reads: list[int]
    ranges: list[tuple[int, int]]


def _within(key: str, ranges: list[tuple[int, int]]) -> Column:
    """Key in one of the ranges [from, to): plain comparisons, which reach the scan."""
    some = F.lit(False)
    for a, b in ranges:
        some |= (F.col(key) >= a) & (F.col(key) < b)
    # one outer bound as well, for readers that skip by a single range
    return some & (F.col(key) >= min(a for a, _ in ranges)) & (F.col(key) < max(b for _, b in ranges)) if ranges else some


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def find_differences(
    source: DataFrame, target: DataFrame, key: str, columns: list[str], fan: int = 64, leaf: int = 64, most_ranges: int = 256
) -> Search:
    """Rows (key, side) that one side lacks or has otherwise; ``side`` is source_only, target_only or differs.

    ``key`` is a whole number, unique on each side.  The first pass folds both
    tables to one digest for each of ``fan`` ranges of keys; each further look
    cuts the ranges that differ into ``fan`` again, until a range holds ``leaf``
    keys.  What is left is compared row by row.  Where more than ``most_ranges``
    ranges differ, looking closer costs more than it saves, and the comparison
    is made at once; the result is the same.  A null key belongs to no range and
    is compared with no row.
    """
    first = source.agg(F.min(key).alias("a"), F.max(key).alias("b")).union(target.agg(F.min(key), F.max(key)))
    low, high = first.agg(F.min("a"), F.max("b")).first()
    empty = source.select(key, F.lit("").alias("side")).where(F.lit(False))
    if low is None:
        return Search(empty, [], [])
    ranges, reads, width = [(int(low), int(high) + 1)], [], int(high) + 1 - int(low)
    while True:
        width = max(leaf, -(-width // fan))
        at = (F.floor((F.col(key) - low) / F.lit(width))).alias("_range")

        def folded(rows: DataFrame) -> DataFrame:
            return rows.where(_within(key, ranges)).groupBy(at).agg(*content_sums([key, *columns]))

        ours, theirs = folded(source), folded(target)
        both = ours.alias("s").join(theirs.alias("t"), "_range", "full_outer")
        same = F.lit(True)
        for c in ("rows", "digest_1", "digest_2"):
            same &= F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
        size = F.coalesce("s.rows", F.lit(0)) + F.coalesce("t.rows", F.lit(0))
        found = both.select("_range", size.alias("n"), same.alias("same"))
        # one row a range: at most ``fan`` for each range looked at
        looked = found.collect()
        reads.append(sum(r.n for r in looked))
        differ = [r["_range"] for r in looked if not r.same]
        # ranges of this look may reach over those of the one before
        cut = [(max(a, low + width * r), min(b, low + width * (r + 1))) for r in differ for a, b in ranges]
        ranges = _joined([(a, b) for a, b in cut if a < b])
        if not ranges:
            return Search(empty, reads, [])
        if width <= leaf or len(ranges) > most_ranges:
            break
    if len(ranges) > most_ranges:
        numbers = source.sparkSession.createDataFrame([(int(r),) for r in differ], "_range long")
        near = [df.withColumn("_range", at).join(numbers, "_range", "left_semi").drop("_range") for df in (source, target)]
    else:
        near = [df.where(_within(key, ranges)) for df in (source, target)]
    s, t = (df.select(key, F.sha2(row_text([key, *columns]), 256).alias(n)) for df, n in zip(near, ("_s", "_t")))
    reads.append(sum(r.n for r in looked if not r.same))
    side = F.when(F.col("_t").isNull(), "source_only").when(F.col("_s").isNull(), "target_only").otherwise("differs")
    rows = s.join(t, key, "full_outer").where(~F.col("_s").eqNullSafe(F.col("_t"))).select(key, side.alias("side"))
    return Search(rows, reads, ranges)


# ---- ordered children ---------------------------------------------------


def ordered_digests(rows: DataFrame, parent: str, columns: list[str], fan: int = 1000, levels: int | None = None) -> DataFrame:
    """(parent, digest): count, a colon, and a hash of the parent's ordered rows.

    Up to ``fan`` rows, it is the SHA-256 of their texts in order, a line each.
    Beyond, rows are numbered in their order, each ``fan`` of them are a slice
    with a hash of its own, and hashes are hashed in the same way until one is
    left.  So no row and no task ever holds more than ``fan`` texts of a parent.
    Where ``levels`` is given, the hashes of that level are one line each of a
    single text, however many there are; with two, 65 bytes for ``fan`` rows.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in columns])
    texts = rows.select(F.col(parent).alias("_parent"), text.alias("_text"))
    sizes = texts.groupBy("_parent").agg(F.count("*").alias("_size"))
    same = F.col("_parent").eqNullSafe(F.col("_p"))
    large = sizes.where(F.col("_size") > fan).select(F.col("_parent").alias("_p"), "_size")

    def hashed(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct(order, value)))
        return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(held, lambda x: x[value]), "\n"), 256).alias("_text"))

    small = texts.join(large, same, "left_anti")
    few = small.groupBy("_parent").agg(F.count("*").alias("_size"), F.array_sort(F.collect_list("_text")).alias("_texts"))
    digest = F.concat(F.col("_size").cast("string"), F.lit(":"), F.sha2(F.array_join("_texts", "\n"), 256)).alias("digest")
    out = few.select("_parent", digest)
    most = large.agg(F.max("_size")).first()[0]
    if most is not None:
        crowd = texts.join(large, same, "left_semi")
        # equal texts are alike whatever their order; a number of their own lets ranges part them
        crowd = crowd.withColumn("_tie", F.monotonically_increasing_id())
        level = running_sums(crowd, ["_parent"], ["_text", "_tie"], {"_place": F.lit(1)}).select(
            "_parent", "_text", (F.col("_place") - 1).alias("_place"))
        at = 0
        while most > 1:
            at += 1
            last = at == levels
            number = F.lit(0).cast("long") if last else F.floor(F.col("_place") / fan)
            level = hashed(level.withColumn("_slice", number), ["_parent", "_slice"], "_text", "_place")
            level = level.withColumnRenamed("_slice", "_place")
            most = 1 if last else -(-most // fan)
            # parents of fewer rows are done earlier; a hash of one hash would not be theirs
            done = level.groupBy("_parent").agg(F.count("*").alias("_left"), F.first("_text").alias("_only")).where("_left = 1")
            ended = done.join(sizes.toDF("_p", "_size"), same).select("_parent", F.concat(F.col("_size").cast("string"), F.lit(":"), F.col("_only")).alias("digest"))
            out = out.unionByName(ended)
            level = level.join(done.select(F.col("_parent").alias("_p")), same, "left_anti")
    return out.withColumnRenamed("_parent", parent)
