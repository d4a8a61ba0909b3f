"""Spelling variants against all pairs, hot prefixes and suffixes included."""

import random
import re
import string
from collections import Counter
from zlib import crc32

import pytest

from matchloom.llm import spelling

LETTERS = string.ascii_lowercase + "àéüÿ"


def plain_near(words):
    return {(a, b) for a in words for b in words if spelling.one_edit(a, b)}


def slow_one_edit(a, b):
    alphabet = set(a + b)
    ways = {a[:i] + a[i + 1 :] for i in range(len(a))}
    ways |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in alphabet}
    ways |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in alphabet}
    return b in ways - {a}


def test_one_edit():
    rng = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(rng.choices("abç", k=rng.randint(1, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == slow_one_edit(a, b), (a, b)


def crowd():
    """Words of one prefix, of one suffix, of both; each with neighbours."""
    rng = random.Random(4)
    out = {"".join(rng.choices("abc", k=rng.randint(6, 9))) for _ in range(400)}
    out |= {"internatio" + "".join(rng.choices("nal", k=rng.randint(3, 7))) for _ in range(400)}
    out |= {"".join(rng.choices("xyz", k=rng.randint(3, 7))) + "ification" for _ in range(400)}
    out |= {"con" + a + "tent" for a in LETTERS} | {"con" + a + b + "tent" for a in LETTERS for b in LETTERS}
    out |= {"a" * k for k in range(6, 40)} | {"long" * 200, "long" * 200 + "s", "grüßen", "grußen", "gruesse"}
    return sorted(out)


def test_near_words_are_all_pairs_at_one_edit(spark):
    words = crowd()
    df = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.near) for r in spelling.near_words(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_near(words)


def test_blocks_stay_within_the_limit(spark):
    df = spark.createDataFrame([(w, 1) for w in crowd()], "word string, n long")
    rows = spelling._entered(df)
    assert rows.groupBy(*spelling.KEYS).count().where("count > 128").count() > 0  # the crowd is one at first
    for _ in range(12):
        large = rows.groupBy(*spelling.KEYS).count().where("count > 128").drop("count")
        rows = spelling._subdivided(rows.join(large, spelling.KEYS, "left_semi").select(*spelling.KEYS, "word", "n"))
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        if rows.isEmpty():
            break
    else:
        raise AssertionError("blocks do not end")


def plain(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        near = [x for x in words if spelling.one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 5 * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    roots = {}
    for w in words:
        at = w
        while out[at][2]:
            at = out[at][2]
        roots[w] = at
    return sorted((w, *v, roots[w]) for w, v in out.items())


def run(spark, rows, **given):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    found = spelling.variants(spelling.word_counts(df, **given))
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect())


@pytest.mark.parametrize("held", [100_000, 7])
def test_equals_plain_grouping(spark, held):
    rng = random.Random(8)
    base = ["".join(rng.choices(LETTERS, k=rng.randint(5, 11))) for _ in range(30)]
    rows = []
    for i in range(500):
        words = rng.choices(base, k=30)
        for _ in range(3):  # slips of the pen, some of them frequent
            w = rng.choice(base[:6])
            words.append(w[:2] + rng.choice("ab") + w[2:])
            words.append(w[:2] + "a" + w[2:-1])
        rows.append((i % 400, rng.choice([" ", "-", "7", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(None, " ".join(base)), (900, None), (901, ""), (902, "!?"), (903, " ".join(base[:5] * 2000)), (903, " ".join(base[:5] * 2000))]
    got, want = run(spark, rows, most_held=held), plain(rows)
    assert got == want
    assert any(r[3] for r in got) and any(r[5] != r[3] for r in got if r[3])


def test_ties_and_chains(spark):
    rows = [(1, "abcdex " * 5 + "abcdexy " * 25 + "abcdexyz " * 125 + "abcdexyq " * 125 + "lonely1 " * 4)]
    assert run(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "nothing here")]) == []
