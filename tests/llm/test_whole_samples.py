"""Models learn from whole texts, however long, in bounded memory."""

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import langid, quality


def test_grams_in_blocks_are_those_of_the_whole():
    rng = np.random.default_rng(1)
    parts = [rng.integers(97, 101, n).astype(np.uint32) for n in (1, 3, 50, 500)]
    for n in (1, 2, 4):
        one, two = langid._grams(parts, n), langid._grams(parts, n, 7)
        for a, b in zip([*one[:2], *one[2]], [*two[:2], *two[2]], strict=True):
            assert (a == b).all()


def test_entropies_in_blocks_are_those_of_the_whole():
    model = langid.train({"a": ["the cat sat on the mat " * 9], "b": ["der Hund liegt im Gras " * 9]})
    for text in ("a", "the dog", "der Hund sat on the mat and im Gras " * 20):
        s = langid.symbols(text)
        for block in (1, 2, 5, 1000):
            assert np.allclose(model.long_entropies(s, block), model.entropies([s]))


def test_language_sample_is_whole_and_bounded(spark):
    rows = [(i, "en", f"short text {i} ") for i in range(30)] + [(100 + i, "en", "word " * 900) for i in range(5)]
    rows += [(200, "xx", "only a long text " * 600), (201, "xx", "longer still " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {}
    for r in langid.sample_rows(df, 200, 9, max_chars=9000).collect():
        got.setdefault(r.lang, {})[r.doc_id] = r.text
    texts = {i: t for i, _, t in rows}
    assert all(texts[i] == t for found in got.values() for i, t in found.items())
    assert set(got["en"]) >= set(range(30)) and sum(map(len, got["en"].values())) <= 9000
    assert set(got["xx"]) == {200}  # one at least, the shortest


def test_very_long_texts_are_learned_from_to_their_end(spark):
    """The first million characters say nothing, the end tells."""
    ends = {"good": (1, "harbour lantern meadow willow "), "bad": (0, "zyx qrt vbn plk ")}
    rows, labels = [], []
    for i in range(24):
        word = "good" if i % 2 else "bad"
        rows.append((i, "same words here " * (70_000 if i < 2 else 3) + ends[word][1] * (200_000 if i < 2 else 40)))
        labels.append((i, ends[word][0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    fresh = spark.createDataFrame([(1, "willow meadow lantern " * 9), (2, "plk vbn qrt " * 9)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in quality.score(fresh, model).collect()}
    assert score[1] > 0.5 > score[2]


def test_one_text_of_twenty_million_characters(spark):
    lang = {"en": "the quick brown fox jumps over the lazy dog and runs away ", "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft weg "}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lang)], "doc_id long, lang string")
    text = F.when(F.col("lang") == "en", F.repeat(F.lit(lang["en"]), 20_000_000 // len(lang["en"]))).otherwise(F.lit(lang["de"] * 50))
    model = langid.fit(df.withColumn("text", text))
    assert model.languages == ["de", "en"]
    assert [x[0] for x in model.classify(["the lazy fox runs over the dog", "der faule Hund springt weg"])] == ["en", "de"]
