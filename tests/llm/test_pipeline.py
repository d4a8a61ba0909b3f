"""The pipeline: each stage on its own input, against its operator."""

import numpy as np

import corpus_pipeline as cp
from matchloom.llm import langid, quality, secrets, simhash


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = [(10**6, "字" * 400, "en", "s", 400), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "1234 5678", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    before = rows(docs)
    step = cp.language(spark, docs, sf_dir)
    kept = rows(step)
    assert step.columns == list(cp.COLUMNS) and not set(kept) & {r[0] for r in junk}
    model = langid.fit(docs)
    assert set(kept) == {i for i, r in before.items() if not model.classify([r.text])[0][2]}

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    step2 = cp.good_quality(spark, step, sf_dir)
    good = rows(step2)
    model = quality.fit(step, labels)
    assert set(good) == {i for i, r in kept.items() if model.score(np.array([quality.features(r.text)]))[0] >= 0.3}
    clean = {r.doc_id for r in labels.where("quality = 1").collect()} & set(kept)
    assert len(clean & set(good)) >= 0.97 * len(clean)

    step3 = cp.near_dedup(spark, step2, sf_dir)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(step2).collect()}
    single = rows(step3)
    assert set(single) == set(groups.values()) and step3.count() == len(single)

    step4 = cp.redact(spark, step3, sf_dir)
    safe = rows(step4)
    assert set(safe) == set(single) and all(r.n_chars == len(r.text) for r in safe.values())
    assert all(not r.secret_spans for r in secrets.find_secrets(step4).collect() if "[SECRET]" in r.text)
    changed = {i for i in safe if safe[i].text != single[i].text}
    assert changed == {r.doc_id for r in secrets.find_secrets(step3).collect() if r.secret_spans}

    packed = cp.pack(spark, step4, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(safe)


def test_run(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() > 0
    assert [n for n, _ in cp.STAGES] == ["language ID", "quality classifier", "SimHash near-dedup", "secret scans", "packing"]


def test_repeated_rows_leave_one(spark, sf_dir):
    text = "one text that is here more than once in all"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, "other words of a row without id", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in cp.near_dedup(spark, docs, sf_dir).collect()) == [0, 1]


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_go_and_others_stay(spark, sf_dir):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(6):  # four words changed in 200: similarity 0.81 or more
        base = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
        near, far = list(base), list(base)
        for at in (20, 70, 120, 170):
            near[at] = "changed"
        for at in range(5, 200, 20):  # ten words: similarity 0.6
            far[at] = "changed"
        texts += [base, near, far]
    # a crowded group: one passage with one word changed, each time another
    passage = [f"p{i}" for i in range(120)]
    texts += [passage[:at] + [f"q{at}"] + passage[at + 1 :] for at in range(100)]
    # many texts that share a passage and no more
    texts += [passage[:40] + [f"r{k}s{i}" for i in range(80)] for k in range(80)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = sorted(r.doc_id for r in dict(cp.STAGES)["SimHash near-dedup"](spark, docs, sf_dir).collect())
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert kept == sorted(set(root)) and len(kept) == 12 + 1 + 80


def test_ids_do_not_make_copies(spark, sf_dir):
    one, two = ("first text with words of its own here", "second one that has nothing in common at all")
    rows = [(1, one), (1, two), (None, one), (None, "a third text without any id"), (None, "a third text without any id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id or 0), r.text) for r in dict(cp.STAGES)["SimHash near-dedup"](spark, docs, sf_dir).collect())
    assert kept == [(0, "a third text without any id"), (1, one), (1, two)]


def test_texts_of_few_words_are_not_taken_for_copies(spark):
    """Fingerprints of such texts are close by chance; nothing goes that is not similar."""
    import random

    from matchloom.llm import dedup, shingles, simhash

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(120))) for i in range(300)]
    sets = [set(shingles.shingle_set(t).tolist()) for _, t in rows]
    alike = {(i, j) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    fps = [simhash.simhash64(t) for _, t in rows]
    assert not alike and sum((fps[i] ^ fps[j]).bit_count() <= 2 for i in range(300) for j in range(i)) > 5
    # one text many times, one with a word changed, and one of a changed word per hundred
    base = rows[7][1].split()
    rows += [(500 + i, rows[7][1]) for i in range(5)] + [(600, " ".join([*base[:60], "four", *base[61:]]))]
    kept = dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 0.8)
    assert {r.doc_id for r in kept.collect()} == set(range(300))
