"""Best-fit packing against a list of open sequences, and against the least number possible."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchloom.llm import best_fit


def plain(lengths, window, most):
    """(sequence, offset) of each length, by scans of a list; equal spaces: the last one left so."""
    open_, out, made = [], [], 0
    for n in lengths:
        fitting = [(free, -at) for at, (free, _) in enumerate(open_) if free >= n]
        if fitting:
            free, number = open_.pop(-min(fitting)[1])
        else:
            free, number, made = window, made, made + 1
        out.append((number, window - free))
        if free > n:
            if len(open_) == most:
                least = min(free for free, _ in open_)
                open_.pop(max(at for at, (free, _) in enumerate(open_) if free == least))
            open_.append((free - n, number))
    return out


@pytest.mark.parametrize("most", [1, 3, 40, 1000])
def test_places_are_those_of_a_plain_search(most):
    rng = random.Random(most)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 9), 64]) for _ in range(2000)]
    places = best_fit.OpenSequences(64, most)
    assert [places.place(n) for n in lengths] == plain(lengths, 64, most)
    assert places.open <= most


def test_the_fullest_closes_first():
    places = best_fit.OpenSequences(10, 2)
    assert [places.place(n) for n in (9, 6, 8)] == [(0, 0), (1, 0), (2, 0)]
    assert places.place(4) == (1, 6)  # that of 9 closed
    assert places.place(1) == (2, 8)


def texts():
    rng = random.Random(3)
    words = [f"w{i} alpha beta".split()[i % 3] for i in range(50)] + ["Grüße", "naïve", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([3, 40, 700, 5000])))) for i in range(120)]
    return [*rows, (500, None), (501, ""), (None, "no id"), (3, rows[3][1]), (3, "same id"), (502, "a " * 2047), (503, "a " * 2048)]


def test_pieces_hold_every_id_once(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, ids int").repartition(3)
    got = best_fit.pack_whole(df).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((-1 if i is None else i, *library.encode(t or "", add_special_tokens=False).ids, 0) for i, t in rows)
    back, docs = {}, []
    for r in got:
        back.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.start == 2048 * r.piece
        whole = [int.from_bytes(r.ids[4 * j : 4 * j + 4], "little") for j in range(r.length)]
        docs.append((-1 if r.doc_id is None else r.doc_id, r.piece, whole))
    for pieces in back.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert sum(len(w) for *_, w in docs) == sum(len(w) - 1 for w in want)
    once = [w for w in want if sum(x[0] == w[0] for x in want) == 1]
    for doc, *ids in once:
        parts = sorted(p for p in docs if p[0] == doc)
        assert [x for *_, w in parts for x in w] == ids
        assert [len(w) for *_, w in parts] == [2048] * (len(ids) // 2048) + [len(ids) % 2048] * (len(ids) % 2048 > 0)


def test_close_to_the_least_number(spark, sf_dir):
    got = best_fit.pack_whole(spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1))
    n, ids = got.selectExpr("count(DISTINCT sequence_id)", "sum(length)").first()
    # no more than three in a hundred above what the ids alone need, and one
    assert n <= 1.03 * (ids + 2047) // 2048 + 1


def test_no_rows(spark):
    assert best_fit.pack_whole(spark.createDataFrame([], "doc_id long, text string")).collect() == []
