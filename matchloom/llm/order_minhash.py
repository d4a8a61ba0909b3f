"""Order MinHash fingerprints in DataFrame expressions only.

k-mers are runs of k words.  Each carries its occurrence number, so repeats
count as different elements.  One hash deals the elements into ``sketches``
buckets and ranks them within; each bucket keeps its two least elements, puts
them back in text order and hashes the pair.  Text with moved or edited parts
thus differs even where its set of k-mers does not.

Elements are packed into longs (hash above, position below), so that sorting,
the only step above linear, runs on primitive arrays.  Positions take 24 bits,
or 31 in texts of more k-mers.  A bucket's code has 16 bits, so two different
pairs agree by chance once in 65,536 buckets.

Edge cases: a null or empty text has one k-mer, the empty sequence; a text of
fewer than k words has one k-mer, all its words.  Equal texts have equal
fingerprints.  Words are split at space, tab, line and page breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

_POS_BITS = 24
_WIDE_POS_BITS = 31
#: Runs of ids; rows without an id are dealt by 48 bits of their text's hash.
_RUN_BITS = 7
_NO_ID = -(1 << 63)


def order_minhash(text: Column, k: int = 2, sketches: int = 64) -> Column:
    """array<int>: bucket * 65536 + 16-bit pair hash, for each bucket in use.

    ``sketches`` is a power of two, 2 to 4096.
    """
    bits = sketches.bit_length() - 1
    if sketches != 1 << bits or not 1 <= bits <= 12:
        raise ValueError("sketches must be a power of two, 2 to 4096")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) < 1 << _POS_BITS, _sketch(w, k, bits, _POS_BITS)).otherwise(
        _sketch(w, k, bits, _WIDE_POS_BITS)))


def _sketch(words: Column, k: int, bits: int, pos_bits: int) -> Column:
    low = F.lit((1 << pos_bits) - 1).cast("long")
    high = F.lit(-(1 << pos_bits)).cast("long")

    def bucket(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - bits)

    def kmers(words: Column) -> Column:
        n = F.size(words)
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]).bitwiseAND(high)
            .bitwiseOR(i.cast("long").bitwiseAND(low)),
        )
        return F.sort_array(runs)

    def run_starts(s: Column, key) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (key(F.get(s, i)) != key(F.get(s, i - 1))),
        )

    def numbered(s: Column) -> Column:
        """Occurrence numbers: within each run of equal hashes 0, 1, 2, ..."""
        def body(starts: Column) -> Column:
            return F.flatten(F.transform(
                starts, lambda at, j: F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), F.size(s)) - at - 1)
            ))
        return let(run_starts(s, lambda x: x.bitwiseAND(high)), body)

    def elements(s: Column) -> Column:
        return F.sort_array(F.zip_with(
            s, numbered(s),
            lambda x, occ: F.xxhash64(x.bitwiseAND(high), occ).bitwiseAND(high).bitwiseOR(x.bitwiseAND(low)),
        ))

    def slots(e: Column) -> Column:
        def slot(i: Column) -> Column:
            one, two = F.get(e, i), F.get(e, i + 1)
            paired = two.isNotNull() & (bucket(one) == bucket(two))
            first, second = one.bitwiseAND(high), two.bitwiseAND(high)
            code = (
                F.when(~paired, F.xxhash64(first))
                .when(one.bitwiseAND(low) < two.bitwiseAND(low), F.xxhash64(first, second))
                .otherwise(F.xxhash64(second, first))
            )
            return (bucket(one) * 65536 + code.bitwiseAND(F.lit(65535))).cast("int")
        return F.transform(run_starts(e, bucket), slot)

    return let(let(kmers(words), elements), slots)


def likeness(a: Column, b: Column) -> Column:
    """Share of the buckets in use by either that hold the same in both."""
    def buckets(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, 16))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(buckets(a), buckets(b)))


def fingerprint_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.lower(F.lpad(F.hex(v), 7, "0"))), "")


def _next_lower(buckets: DataFrame) -> DataFrame:
    """(bucket, next_bucket): the greatest lower bucket, at last the greatest.

    A single window over all would be one task.  Windows over ranges of
    buckets answer all but the last of each range; ranges are then put into
    wider ranges, until few are left.
    """
    level = buckets.select("bucket", F.col("bucket").alias("head"), F.col("bucket").alias("g"))
    levels = []
    for shift in (8, 20, 20):
        up = F.shiftright("g", shift)
        w = Window.partitionBy("up").orderBy(F.desc("g"))
        seen = level.withColumn("up", up).withColumn("after", F.lead("head").over(w))
        levels.append(seen)
        level = seen.groupBy("up").agg(F.max("head").alias("head")).select(F.col("up").alias("g"), "head")
    # 64 - 7 - 48 bits of a bucket of ids are left and one row for those without: at most 513 rows
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("g"))
    whole = Window.partitionBy(F.lit(0))
    last = level.select(
        F.col("g").alias("up"), F.coalesce(F.lead("head").over(w), F.max("head").over(whole)).alias("beyond")
    )
    for seen in reversed(levels):
        found = seen.join(last, "up").select("g", F.coalesce("after", "beyond").alias("beyond"))
        last = found.withColumnRenamed("g", "up")
    return last.select(F.col("up").alias("bucket"), F.col("beyond").alias("next_bucket"))


def fingerprint_with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, sketches: int = 64,
    edited_share: int = 3,
) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document.

    The next document is the one after in descending id order (ids equal: by
    text; rows without an id last, by descending XXH64 of the text), after the
    last the first.  The edited text has its
    last floor(n / ``edited_share``) code points replaced by the first as many
    of the next text, or all if it is shorter.

    Columns: doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    next_fingerprint.  Texts are exchanged once, dealt by runs of 128 ids, and
    the order within a run is a window; only the first text of each run is
    sent once more, to the run before.  Rows without an id are dealt by their
    text's hash; only rows alike in both id and text, or in a repeated id, must
    share a run.  A table of one row is its own next.
    """
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), t.alias("text"))
    own = F.shiftrightunsigned(F.xxhash64("text"), 16)
    rows = rows.withColumn("bucket", F.coalesce(F.shiftright("doc_id", _RUN_BITS), own + F.lit(_NO_ID)))
    # the one exchange of texts; fingerprints are worked out behind it, so that both its readers share it
    dealt = rows.repartition("bucket")

    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    seen = dealt.withColumn("fp", order_minhash(F.col("text"), k, sketches)).select(
        "*", F.lead("text").over(w).alias("follow_text"), F.lead("fp").over(w).alias("follow_fp")
    )
    heads = dealt.select("*", F.lag(F.lit(1)).over(w).alias("before")).where("before is null").select(
        F.col("bucket").alias("next_bucket"), F.col("text").alias("head_text"),
        order_minhash(F.col("text"), k, sketches).alias("head_fp"),
    )
    # nothing but the ids is read for the order of the runs
    order = _next_lower(rows.select("bucket").distinct())
    beyond = order.join(heads, "next_bucket").select("bucket", "head_text", "head_fp")
    both = seen.join(beyond, "bucket", "left").select(
        "doc_id", "text", "fp", F.coalesce("follow_text", "head_text").alias("next_text"),
        F.coalesce("follow_fp", "head_fp").alias("next_fp"), F.length("text").cast("long").alias("n_chars"),
    )
    cut = F.floor(F.col("n_chars") / edited_share).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)
    )
    both = both.select("doc_id", "n_chars", edited.alias("edited"), "fp", "next_fp")
    return both.select(
        "doc_id", "n_chars", "edited", F.col("fp").alias("fingerprint"),
        order_minhash(F.col("edited"), k, sketches).alias("edited_fingerprint"),
        F.col("next_fp").alias("next_fingerprint"),
    )
