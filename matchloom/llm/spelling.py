"""Spelling variants: words at one edit from a far more frequent word.

One edit leaves a half of a word intact: of two words at one edit, the shorter
of length m, either the first or the last half of m is the same in both (the
lesser half where a code point is replaced, the greater one where one is added).
So words stand in two sorted dictionaries, forward by their first halves and
reversed by their last ones, and words of one half are a block, found by a scan
of a range.  A word stands under its own length for partners of the same length,
under its own length for longer partners, and under one less for shorter ones.

A block of more than ``block_limit`` words is subdivided: what lies between the
intact ends is halved again in the same way, once more forward and once more
reversed.  This ends by itself.  With one code point left between the ends, or
none where one is added, a block holds no more words than there are letters.  So
nothing is capped, and a task holds one block of bounded size at a time.

A pair can meet in several blocks.  It counts in one of them: that on the path
which takes the first half wherever the pair shares it.  So pairs need no
exchange to be told apart, and what is counted per word folds in tasks.

Edge cases: a null text has no words; a null id counts as an empty one; repeated
rows count each; words alike but for capitals beyond A-Z are different words; an
empty table gives no rows.  A row whose only run is longer than a batch is read
whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize, table

KEYS = ["added", "m", "path", "head", "tail"]
_BLOCKS = "added int, m int, path string, head string, tail string, word string, n long"
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 199, least_length: int = 6,
    least_count: int = 5, most_held: int = 100_000, most_chars: int = 4_000_000,
) -> DataFrame:
    """(word, n) of all runs of letters, some of them with a code point deleted.

    A task holds at most ``most_held`` words of ``most_chars`` code points
    together and passes their counts on when it has more.
    """
    # a deletion only shortens, so shorter runs are no words
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def typed(doc: int | None, run: str) -> str:
        h = crc32(f"{'' if doc is None else doc}:{run}".encode())
        if h % divisor:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer()
                if raw is None:
                    continue
                found = Counter(runs.findall(raw.to_pybytes().translate(_ASCII_LOWER).decode("utf-8")))
                for word, times in found.items():
                    word = typed(doc, word)
                    if len(word) >= least_length:
                        if word not in held:
                            chars += len(word)
                        held[word] += times
                if len(held) >= most_held or chars >= most_chars:
                    yield sent(held)
                    held, chars = Counter(), 0
        yield sent(held)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _half(added: int, between: int) -> int:
    return (between + added) // 2


def _path_of(a: str, b: str, added: int, m: int, steps: int) -> str:
    """The first ``steps`` choices of the pair's one path: first halves wherever both words share them."""
    shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), m)
    p = s = 0
    path = ""
    for _ in range(steps):
        half = _half(added, m - p - s)
        if p + half <= shared:
            path, p = path + "F", p + half
        else:
            path, s = path + "R", s + half
    return path


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes the one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def _entered(words: DataFrame) -> DataFrame:
    """The words of both dictionaries, under the lengths that they have partners of."""
    size = F.char_length("word")
    under = F.array(
        F.struct(F.lit(0).alias("added"), size.alias("m")), F.struct(F.lit(1).alias("added"), size.alias("m")),
        F.struct(F.lit(1).alias("added"), (size - 1).alias("m")),
    )
    rows = words.select("word", "n", F.inline(under)).select(
        "added", "m", F.lit("").alias("path"), F.lit("").alias("head"), F.lit("").alias("tail"), "word", "n")
    return _subdivided(rows)


def _subdivided(rows: DataFrame) -> DataFrame:
    """Each row in two blocks: with the next half from the front, and with that from the back."""
    p, s = F.char_length("head"), F.char_length("tail")
    half = F.shiftright(F.col("m") - p - s + F.col("added"), 1)
    front = F.struct(
        "added", "m", F.concat("path", F.lit("F")).alias("path"), F.substring("word", F.lit(1), p + half).alias("head"), "tail", "word", "n")
    # kept reversed, so that the dictionary is sorted by last letters
    back = F.struct(
        "added", "m", F.concat("path", F.lit("R")).alias("path"), "head",
        F.substring(F.reverse("word"), F.lit(1), s + half).alias("tail"), "word", "n")
    return rows.select(F.inline(F.array(front, back)))


def _scanned(blocks: DataFrame) -> DataFrame:
    """(word, near, near_n) both ways for pairs at one edit, from ranges of the sorted dictionaries."""

    def pairs(key: tuple, block: list[tuple[str, int]]) -> Iterator[tuple[str, str, int]]:
        added, m, path = key[:3]
        short = [w for w in block if len(w[0]) == m]
        long = [w for w in block if len(w[0]) != m]
        for i, (a, n) in enumerate(short):
            for b, k in long if added else short[i + 1 :]:
                if one_edit(a, b) and _path_of(a, b, added, m, len(path)) == path:
                    yield a, b, k
                    yield b, a, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []

        def out(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            types = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "near", "near_n"])

        for batch in batches:
            found: list = []
            *keys, words, counts = (c.to_pylist() for c in batch.columns)
            for at, word, n in zip(zip(*keys, strict=True), words, counts, strict=True):
                if at != key:
                    found += pairs(key, block) if len(block) > 1 else ()
                    key, block = at, []
                block.append((word, n))
            yield out(found)
        yield out(list(pairs(key, block)) if len(block) > 1 else [])

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dictionary = blocks.repartitionByRange(parts, *KEYS).sortWithinPartitions(*KEYS, "word")
    return dictionary.mapInArrow(run, "word string, near string, near_n long")


def near_words(words: DataFrame, block_limit: int = 128) -> DataFrame:
    """(word, near, near_n): every pair of words (word, n) at one edit, both ways, each once."""
    if block_limit < 128:
        raise ValueError("blocks of the last subdivision hold up to 91 words")
    rows, small = materialize(_entered(words), "spelling-entries"), None
    while True:
        sizes = rows.groupBy(*KEYS).count()
        large = materialize(sizes.where(F.col("count") > block_limit).select(*KEYS), "spelling-large")
        done = large.isEmpty()
        # words that stand alone in a block have no partner there
        own = rows if done else rows.join(large, KEYS, "left_anti")
        small = own if small is None else small.unionByName(own)
        if done:
            return _scanned(small.select(*[f.split()[0] for f in _BLOCKS.split(", ")]))
        rows = materialize(_subdivided(rows.join(large, KEYS, "left_semi").select(*KEYS, "word", "n")), "spelling-entries")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last form that forms lead to.

    Each round doubles how far a row looks ahead.  Counts grow with each form,
    so there is no way back.
    """
    roots = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        far = materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"),
                                                                   F.col("ahead").isNotNull().alias("moved")), "spelling-roots")
        discard(roots)
        roots = far.select("word", "root")
        roots._matchloom_path = far._matchloom_path
        if far.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, factor: int = 5, block_limit: int = 128) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of rows (word, n), words distinct."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    with arrow_rows(words.sparkSession, 2000):
        near = near_words(words, block_limit).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
        near = materialize(near, "spelling-near")
    chosen = -F.col("best.less") >= factor * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "spelling-forms")
    discard(near)
    roots = follow(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialize(word_counts(table(spark, sf_dir, "documents")), "spelling-words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 by a table of 256 entries made by its rule; letters here have one or two bytes in UTF-8.
_SQL = """WITH RECURSIVE
step AS (SELECT b, 0 AS k, b AS c FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))),
    lambda h, b: xor(t[CAST(xor(h & 255, b) AS INTEGER) + 1], h >> 8))) AS h
  FROM runs, crc WHERE length(run) >= 6),
words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest, length(word) AS size
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, min((-near_n, near)) AS least FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN -struct_extract(least, 1) >= 5 * w.n THEN struct_extract(least, 2) END AS form,
    CASE WHEN -struct_extract(least, 1) >= 5 * w.n THEN -struct_extract(least, 1) END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""

QUERIES = {"op13_spelling": op13_spelling}
ORACLE_SQL = {"op13_spelling": _SQL}
