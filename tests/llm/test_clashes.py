"""Nulls in any column, clashing names, repeated rows and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from matchloom.llm import arrow_tokens, bpe, chat, langid, order_minhash, packing, quality, secrets, simhash, tiff

NAMES = (
    "_ml_text", "_ml_spans", "secret_spans", "Score", "REJECTED", "fp", "ids", "key", "count", "bucket", "next_id", "page", "pixels",
    "ERROR", "place", "label", "text_len", "a.b", "start", "file", "partition", "_c",
)
TEXTS = [None, "", "password=abcdef1 here", "password=abcdef1 here", "ein Text mit Wörtern " * 3, "x" * 30_000]


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(i if i != 2 else None, t, None) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(f"own {n}" if len(n) % 2 else None).cast("string").alias(n) for n in NAMES])


def test_secrets(clash):
    out = secrets.find_secrets(clash)
    assert out.columns == [c for c in clash.columns if c != "secret_spans"] + ["secret_spans"]
    rows = out.collect()
    assert sum(len(r.secret_spans) for r in rows) == 2 and {r["_ml_spans"] for r in rows} == {"own _ml_spans"}
    clean = secrets.redact_secrets(clash)
    assert clean.columns == clash.columns
    assert sum("[SECRET]" in (r.text or "") for r in clean.collect()) == 2


def test_per_row_models(spark, clash):
    model = quality.train(["good words here", "BAD!! BAD!!", "more good words"], [1, 0, 1])
    scored = quality.score(clash, model)
    assert scored.columns[-1] == "score" and "Score" not in scored.columns and scored.count() == 7
    lang = langid.train({"de": ["ein Text mit Wörtern"], "en": ["a text of words"]})
    named = langid.identify(clash, lang)
    assert named.columns[-3:] == ["lang_pred", "score", "rejected"] and named.count() == 7
    assert langid.fit(clash).languages == []  # nothing to learn from
    labels = spark.createDataFrame([(0, None), (None, 1), (5, 1), (5, 0)], "doc_id long, quality int")
    assert quality.fit(clash, labels).labels.tolist() == [0.0]


def test_operators_that_take_id_and_text(clash):
    assert simhash.near_duplicates(clash).count() == 7
    assert bpe.decode_ids(bpe.encode_texts(clash)).count() == 7
    assert tiff.read_pages(tiff.encode_texts(clash)).count() == 7
    assert {r.doc_id for r in packing.pack_documents(clash).collect()} == {r.doc_id for r in clash.collect()}
    folder, index = arrow_tokens.write_tokens(clash)
    assert arrow_tokens.read_ids(folder, index).count() == 7
    assert order_minhash.fingerprint_with_edits(clash).count() == 7


def test_tiff_and_bpe_keep_other_columns(clash):
    files = clash.withColumn("media", F.lit(tiff.encode([b"abc"])))
    pages = tiff.read_pages(files)
    assert {"_ml_text", "a.b", "start"} <= set(pages.columns) and "ERROR" not in pages.columns and pages.where("error is null").count() == 7
    coded = clash.drop("ids").withColumn("ids", F.when(F.col("doc_id") > 3, F.array(F.lit(0), F.lit(5)))).withColumn("Decoded", F.lit("own"))
    assert sum(r.decoded is None for r in bpe.decode_ids(coded).collect()) == 4


def test_empty_tables(clash):
    none = clash.where("false")
    model = quality.train([], [])
    assert secrets.redact_secrets(none).count() == quality.score(none, model).count() == langid.identify(none, langid.fit(none)).count() == 0
    assert simhash.near_duplicates(none).count() == bpe.decode_ids(bpe.encode_texts(none)).count() == 0
    assert tiff.read_pages(tiff.encode_texts(none)).count() == packing.pack_documents(none).count() == 0
    assert order_minhash.fingerprint_with_edits(none).count() == 0


def test_chat_nulls_and_extras(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "assistant", "x" * 700), (1, 0, "assistant", "x" * 700), (2, None, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("seq"), F.lit("k").alias("kind"), F.lit(2).alias("message_id"))
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.events_from_turns(turns))).collect()}
    assert set(out) == {None, 1, 2} and [t.text for t in out[1].turns] == ["x" * 700] * 2 and out[None].n_turns == 2
    assert out[1].loss_text == "x" * 1400 and out[2].n_turns == 1
    assert chat.format_conversations(chat.events_from_turns(turns.where("false"))).count() == 0
