"""Order MinHash of rows without an id and of very long texts."""

from pyspark.sql import functions as F

from matchloom.llm import order_minhash


def test_rows_without_an_id_are_dealt_by_their_text(spark):
    docs = spark.createDataFrame([(None, f"text {i // 3} of words") for i in range(600)] + [(4, "the last id")], "doc_id long, text string")
    by_hash = [r.text for r in docs.orderBy(F.col("doc_id").desc_nulls_last(), F.shiftrightunsigned(F.xxhash64("text"), 16).desc()).collect()]
    want = sorted(t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(by_hash, by_hash[1:] + by_hash[:1], strict=True))
    made = order_minhash.fingerprint_with_edits(docs)
    assert sorted(r.edited for r in made.collect()) == want


def test_wide_positions(spark, monkeypatch):
    """Texts beyond the narrow positions keep their order."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words), " ".join(words[150:] + words[:150])]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    narrow = [r.fp for r in df.select("i", order_minhash.order_minhash(F.col("text")).alias("fp")).orderBy("i").collect()]
    monkeypatch.setattr(order_minhash, "_POS_BITS", 4)
    wide = [r.fp for r in df.select("i", order_minhash.order_minhash(F.col("text")).alias("fp")).orderBy("i").collect()]
    assert wide[0] == wide[1] != wide[2] and narrow[0] == narrow[1] != narrow[2] and len(wide[0]) == len(narrow[0])


def test_long_text_of_one_token(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000), (2, "y " * 300_000), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in order_minhash.fingerprint_with_edits(df).collect()}
    assert rows[1].n_chars == 3_000_000 and len(rows[1].fingerprint) == 1 and len(rows[2].fingerprint) == 64
