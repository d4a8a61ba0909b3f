"""Languages of few labelled texts."""

import numpy as np
import pytest

from matchloom.llm import langid

SYLLABLES = {
    "aa": "ka ri to mu shi ne ya ho ku ta na so".split(),
    "bb": "schl ach ung eit der ich ver sten auf ges ein cht".split(),
    "cc": "cion que los ar es del mente por ado ia el una".split(),
}


def texts(lang, count, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(300)]
    # each text has its own vocabulary, as documents of different subjects have
    return [" ".join(rng.choice(rng.choice(words, 60, replace=False), 80)) for _ in range(count)]


def test_languages_of_one_to_five_texts(spark):
    for k in range(1, 6):
        few = texts("cc", k + 40, 7)
        learned = [("aa", t) for t in texts("aa", 40, 1)] + [("bb", t) for t in texts("bb", 40, 2)] + [("cc", t) for t in few[:k]]
        docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(learned)], "doc_id long, text string, lang string")
        model = langid.fit(docs)
        got = model.classify(few[k:])
        assert "cc" in model.languages
        assert sum(x == "cc" and not out for x, _, out in got) >= 38, (k, got)
        # what is no language of the model is still rejected
        assert all(out for _, _, out in model.classify(["字" * 300, "zqxj wvkq pzzx qqwj " * 20]))


def test_no_language_is_left_out_in_silence(spark):
    docs = spark.createDataFrame([(i, "some words of it", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    assert len(langid.fit(docs, max_languages=5).languages) == 5
    with pytest.raises(ValueError, match="more than 4 languages"):
        langid.fit(docs, max_languages=4)


def test_models_have_a_size_bound():
    with pytest.raises(ValueError, match="bytes"):
        langid.train({x: texts(x, 20, 3) for x in ("aa", "bb", "cc")}, max_model_bytes=10_000)


def test_letters_of_all_planes():
    model = langid.train({x: texts(x, 20, 3) for x in ("aa", "bb")})
    (lang, score, _), = model.classify([chr(0x30010) * 5 + " " + chr(0x20001)])
    assert lang in ("aa", "bb") and score > 0
    (lang, score, _), = model.classify(["k" * 2_000_000])  # one long token
    assert lang in ("aa", "bb")
