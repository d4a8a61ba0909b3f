"""The other operators against brute force, round trips or held-out labels."""

import hashlib
import math
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest

from matchloom.llm import arrow_tokens, bpe, langid, packing, quality, queries, simhash, tiff, tokens

LONG = "long text of many words " * 20_000


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a column with an awkward name."""
    rows = [(1, None, 7), (2, "", 7), (3, "ein Wort", 7), (3, "ein Wort", 7), (None, "no id", 7), (5, LONG, 7), (6, "é🙂 ok\n\n x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, `fp.text` int")


# ---- SimHash ------------------------------------------------------------

def components(fps):
    """{fingerprint: root} by comparing all pairs."""
    keys = np.unique(np.array(list(fps), np.uint64))
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 2):
            parent[find(int(j))] = find(i)
    return {int(k): find(i) for i, k in enumerate(keys)}


def check_components(rows):
    root = components(r[1] for r in rows)
    least = {}
    for ident, fp, _ in rows:
        if ident is not None:
            least[root[fp]] = min(ident, least.get(root[fp], ident))
    assert [c for _, _, c in rows] == [least.get(root[fp]) for _, fp, _ in rows]


def plain_simhash(text):
    from xxhash import xxh64_intdigest

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or [words] * bool(words)
    hashes = [xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_definition(documents):
    for _, text, _ in documents[:60]:
        assert simhash.simhash64(text) == plain_simhash(text)
    assert simhash.simhash64(None) == simhash.simhash64(" \n") == 0
    assert simhash.simhash64("A b") == plain_simhash("a b")


def test_simhash_chunks(monkeypatch):
    text = "many words of a text that goes on " * 50
    want = plain_simhash(text)
    monkeypatch.setattr(simhash, "_CHUNK", 37)
    assert simhash.simhash64(text) == want


@pytest.mark.parametrize("limit", [32, 2])
def test_planted_fingerprints(spark, monkeypatch, limit):
    """Chains, stars and a crowd of close fingerprints, by brute force."""
    random.seed(limit)
    fps = [random.getrandbits(64) for _ in range(300)]
    for _ in range(6):
        x = random.getrandbits(64)
        for _ in range(60):
            fps.append(x)
            x ^= 1 << random.randrange(64) | 1 << random.randrange(64)
    crowd = random.getrandbits(64)
    fps += [crowd ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(150)] + [crowd] * 5
    rows = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: frame)
    got = simhash.near_duplicates(frame, pair_limit=limit).collect()
    assert len(got) == len(rows)
    check_components([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got])


def test_block_keys_cover_all_close_pairs(spark):
    from pyspark.sql import functions as F

    random.seed(1)
    x = random.getrandbits(64)
    near = [x ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(i + 1, 64, 5)]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in [x, *near]], "fp long")
    first, *rest = (set(r[0]) for r in df.select(simhash.block_keys(F.col("fp"), 5, 2)).collect())
    assert all(first & r for r in rest)


def test_op2(spark, sf_dir, documents):
    rows = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op2_simhash(spark, sf_dir).collect()]
    assert {i: fp for i, fp, _ in rows} == {i: simhash.simhash64(t) for i, t, _ in documents}
    check_components(rows)


def test_simhash_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    check_components([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got])
    assert simhash.near_duplicates(odd.where("false")).count() == 0


# ---- TIFF ---------------------------------------------------------------

@pytest.mark.parametrize("compression,predictor,tile,order", product(
    [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS], [1, 2], [None, 16, 64], "<>"))
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = random.Random(7)
    for n in (0, 1, 63, 64, 65, 9000):
        for raw in (rng.randbytes(n), b"ab" * (n // 2), b"\0" * n):
            data = tiff.encode([raw, b"second page"], compression=compression, predictor=predictor, tile=tile, order=order, rows_per_strip=16)
            pages = [tiff.decode_page(data, tags).tobytes() for _, tags in tiff.directories(data)]
            assert len(pages) == 2 and pages[0] == raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")


def test_tiff_pages(spark):
    good = tiff.encode([b"one", b"two" * 100], compression=tiff.LZW)
    rows = [(1, good, "x"), (2, None, "x"), (3, b"II*\0\xff\xff\xff\x7f", "x"), (4, b"", "x"), (1, good, "x")]
    pages = tiff.read_pages(spark.createDataFrame(rows, "id int, media binary, page string")).collect()
    assert sorted((r.id, r.page, r.error is None) for r in pages) == [(1, 0, True)] * 2 + [(1, 1, True)] * 2 + [(3, 0, False), (4, 0, False)]


def test_op3(spark, sf_dir, documents):
    texts = {i: t for i, t, _ in documents}
    for r in queries.op3_tiff_pages(spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = tiff.encode([padded], **tiff.LAYOUTS[zlib.crc32(padded) % len(tiff.LAYOUTS)])
        share = [padded.count(b) / len(padded) for b in set(padded)]
        mean = sum(padded) / len(padded)
        spread = (sum((b - mean) ** 2 for b in padded) / len(padded)) ** 0.5
        want = (64, len(padded) // 64, mean, spread, -sum(p * math.log2(p) for p in share))
        got = [float(x) for x in re.findall(r"[0-9.]+", r.feature)]
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and got == pytest.approx(want, abs=2e-4)


def _patched(data, tag, value):
    """The file with another value of a tag of its first directory."""
    import struct

    out = bytearray(data)
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    for place in range(at + 2, at + 2 + 12 * n, 12):
        if struct.unpack_from("<H", data, place)[0] == tag:
            struct.pack_into("<I", out, place + 8, value)
    return bytes(out)


def test_tiff_bad_files_give_an_error_row(spark):
    good = tiff.encode([b"abc" * 500], compression=tiff.LZW, rows_per_strip=4096)
    tiled = tiff.encode([b"abc" * 500], compression=tiff.DEFLATE, tile=16)
    bomb = tiff.encode([b"\0" * 50_000_000], compression=tiff.DEFLATE, rows_per_strip=1 << 24)
    bad = [_patched(good, t, v) for t, v in ((tiff.WIDTH, 0), (tiff.LENGTH, 0), (tiff.LENGTH, 4_000_000_000), (tiff.WIDTH, 4_000_000_000),
                                             (tiff.ROWS_PER_STRIP, 0), (tiff.SAMPLES, 0), (tiff.STRIP_COUNTS, 3), (tiff.STRIP_OFFSETS, 1 << 30))]
    bad += [_patched(tiled, t, v) for t, v in ((tiff.TILE_WIDTH, 0), (tiff.TILE_LENGTH, 4_000_000_000), (tiff.TILE_OFFSETS, 1 << 30))]
    bad += [good[: len(good) // 2], good[:9], b"MM\0*" + b"\xff" * 40]
    rows = [(i, b) for i, b in enumerate(bad)] + [(100, _patched(bomb, tiff.LENGTH, 10)), (101, good)]
    pages = {r.i: r for r in tiff.read_pages(spark.createDataFrame(rows, "i int, media binary")).collect()}
    assert len(pages) == len(rows) and all(pages[i].error and pages[i].pixels is None for i in range(len(bad)))
    assert pages[101].error is None and pages[100].pixels == b"\0" * 640  # what the page does not need is not decoded


def test_tiff_odd_rows(odd):
    pages = tiff.read_pages(tiff.encode_texts(odd)).collect()
    assert len(pages) == 7 and {r.height for r in pages if r.doc_id in (1, 2)} == {1} and not any(r.error for r in pages)


# ---- byte-level BPE -----------------------------------------------------

@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return bpe._worker(bpe.default_ranks_path(), public_tokenizers.PATTERN)[0]


def test_prefix_encoding_is_merging(encoder):
    rng = random.Random(2)
    for _ in range(400):
        data = rng.choice([rng.randbytes(rng.randint(1, 30)), bytes(rng.choice(b"the ing ation ") for _ in range(rng.randint(1, 30)))])
        ids = encoder.encode(data)
        assert ids == encoder._merged(data) and encoder.decode(ids) == data


def test_append_and_edit(encoder):
    rng = random.Random(3)
    data, last = b"the first words", []
    encoder.extend(data, last)
    for _ in range(60):
        if rng.random() < 0.5:
            data += bytes(rng.choice(b"aeinst ") for _ in range(3))
            encoder.extend(data, last)
        else:
            a = rng.randrange(len(data))
            b = min(len(data), a + rng.randint(0, 5))
            data, last = encoder.edit(data, last, a, b, b"new"[: rng.randint(0, 3)])
        assert encoder.walk(last) == encoder.encode(data)


def test_op5_is_tiktoken(spark, sf_dir, documents, encoder):
    import public_tokenizers
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    texts = {i: t for i, t, _ in documents}
    for r in queries.op5_byte_bpe(spark, sf_dir).collect():
        ids = other.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_odd_rows(odd):
    got = bpe.decode_ids(bpe.encode_texts(odd)).collect()
    assert sorted((r.decoded or b"").decode() for r in got) == sorted(t or "" for t in ["", "", "ein Wort", "ein Wort", "no id", LONG, "é🙂 ok\n\n x"])


# ---- tokens, packing, files ---------------------------------------------

@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_are_the_whole(documents, name, spaces):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab cdeéß字🙂 \n\t's't12!?--\x01\x1c\x85 \xa0́ thein<|endoftext|>") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [t for _, t, _ in documents] + ["", " ", "\n", " a", "a ", "a\n", None]
    texts += ["x <|endoftext|> y", "<|endoftext|>", "a<|startoftext|>b\n<|ENDOFTEXT|>", "<|endoftext|><|endoftext|> the end", " <|endoftext|>"]
    for plain in (False, True):  # False: the library as it is
        library.encode_special_tokens = plain
        got = tokens.PieceTokenizer(public_tokenizers.path(name), spaces, plain).encode(texts)
        want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert all(list(g) == w.ids for g, w in zip(got, want, strict=True))
    assert len(tokens.PieceTokenizer(public_tokenizers.path(name), spaces).encode(["x <|endoftext|> y"])[0]) <= 4


def test_packer_fills_windows():
    rng = random.Random(6)
    docs = [np.arange(rng.choice([1, 5, 300, 700, 1500, 2048, 5000]), dtype=np.uint32) for _ in range(300)]
    packer = packing.Packer(hold=1 << 14)
    for i, ids in enumerate(docs):
        packer.add(i, ids)
    packer.finish()
    pieces, groups = {}, {}
    for length, group, window in packer.ready:
        assert sum(len(p[2]) for p in window) == length and length & (length - 1) == 0
        groups.setdefault(group, []).append(length)
        for doc, start, ids, n in window:
            pieces.setdefault(doc, []).append((start, ids))
            assert n == len(docs[doc])
    for i, ids in enumerate(docs):
        assert np.array_equal(np.concatenate([p for _, p in sorted(pieces[i], key=lambda x: x[0])]), ids)
    assert all(len(set(g)) == 1 and sum(g) <= 16384 for g in groups.values())
    for length in {n for n, _, _ in packer.ready}:  # full groups, then two that differ by one window at most
        sizes = [len(g) for _, g in sorted(groups.items()) if g[0] == length]
        assert all(n * length == 16384 for n in sizes[:-2]) and (len(sizes) < 2 or 0 <= sizes[-2] - sizes[-1] <= 1)
    assert sum(n for n, _, _ in packer.ready if n < 256) < 256


def expected_ids(texts, name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def test_op8(spark, sf_dir, documents):
    rows = queries.op8_packing(spark, sf_dir).collect()
    want = {d[0]: ids for d, ids in zip(documents, expected_ids([t for _, t, _ in documents], "word_bpe_49k.json", 1), strict=True)}
    ends, sequences = dict.fromkeys(want, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        ends[r.doc_id] += r.length
    assert ends == {i: len(x) for i, x in want.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 for n in sequences.values())
    lengths, groups = {r.sequence_id: (r.step_group, r.sequence_length) for r in rows}, {}
    for group, n in lengths.values():
        groups.setdefault(group, []).append(n)
    assert all(len(set(g)) == 1 and sum(g) <= 16384 for g in groups.values()) and {n for g in groups.values() for n in g} >= {2048, 1024, 512}
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sequences.values()) == 0


def test_op9(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in queries.op9_arrow_tokens(spark, sf_dir).collect()}
    start = 0
    for (i, _, _), ids in zip(documents, expected_ids([t for _, t, _ in documents], "byte_bpe_50k.json", 0), strict=True):
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files(spark, odd):
    """Small files, so that documents go over their ends; zero-copy views."""
    import pyarrow as pa

    folder, index = arrow_tokens.write_tokens(odd, sequence=16, batch_rows=4, file_rows=8)
    rows = arrow_tokens.read_ids(folder, index).collect()
    assert len({r.file for r in rows}) > 3
    docs = sorted([(i, t) for i, t, _ in odd.collect()], key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    got = b"".join(r.ids for r in sorted(rows, key=lambda r: (r.start, r.piece_start)))
    assert got == b"".join(x.tobytes() for x in expected_ids([t for _, t in docs], "byte_bpe_50k.json", 0))
    reader = pa.ipc.open_file(pa.memory_map(f"{folder.removeprefix('file:')}/{min(r.file for r in rows)}"))
    batch = reader.get_batch(0)
    assert batch.schema.field("ids").type.list_size == 16 and batch.column(1).values.true_count == 64
    batch.column(0).values.to_numpy(zero_copy_only=True)
    _, none = arrow_tokens.write_tokens(odd.where("false"))
    assert none.count() == 0


def test_packing_odd_rows(odd):
    rows = packing.pack_documents(odd).collect()
    texts = sorted((t or "" for _, t, _ in odd.collect()), key=len)
    assert sum(r.length for r in rows) == sum(map(len, expected_ids(texts, "word_bpe_49k.json", 1)))


# ---- classifiers --------------------------------------------------------

def test_op4_held_out(spark, sf_dir, duck):
    rows = queries.op4_quality_knn(spark, sf_dir).collect()
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert len(rows) == len({r.doc_id for r in rows}) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in known) >= 0.9 * len(known)


def test_knn_is_exact(documents):
    """Blocked products against the vote worked out row by row."""
    texts = [t for _, t, _ in documents]
    labels = [int(len(t) % 3 > 0) for t in texts]
    model = quality.train(texts[:120], labels[:120], dimensions=8)
    rows = np.array([quality.features(t) for t in texts[120:]], np.float32)
    latent = model.project(rows)
    for got, x in zip(model.score(rows, block=7), latent, strict=True):
        cosine = model.vectors @ x
        near = np.flatnonzero(cosine >= np.sort(cosine)[-model.neighbours] - quality.TIE)
        w = np.maximum(cosine[near], 0).astype(float) ** model.power
        assert got == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=2e-3)


def test_labels_that_depend_on_words_alone():
    """Texts of one shape whose label is told by vocabulary."""
    rng = np.random.default_rng(1)
    kinds = [[f"w{i}" for i in range(300)], [f"w{i}" for i in range(300, 600)]]
    common = [f"c{i}" for i in range(600)]
    made = [(" ".join(rng.permutation([*rng.choice(common, 80), *rng.choice(kinds[i % 2], 25)])), i % 2) for i in range(1400)]
    model = quality.train([t for t, _ in made[:1000]], [y for _, y in made[:1000]])
    scores = model.score(np.array([quality.features(t) for t, _ in made[1000:]]))
    assert np.mean((scores >= 0.5) == np.array([y for _, y in made[1000:]])) >= 0.95


def test_ties_all_vote():
    """Copies in the sample and the order of its rows make no difference."""
    rng = np.random.default_rng(2)
    texts = [f"text {i % 9} of words that come {i % 5} times" for i in range(90)]
    labels = [int(x) for x in rng.integers(0, 2, 90)]
    rows = np.array([quality.features(t) for t in texts[:20]])
    model = quality.train(texts, labels, neighbours=4)
    turned = quality.Model(model.weights, model.basis, model.vectors[::-1].copy(), model.labels[::-1].copy(), model.prior, 4, model.power)
    assert model.score(rows) == pytest.approx(turned.score(rows), abs=1e-5)


def test_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(i, f"all word{i}" if i else None) for i in range(50)], "doc_id long, text string")
    found, total = quality.words_found(docs)
    assert total == 50 and found[quality._SEEN["all"] // 256] >= 49 and found.sum() <= 98


def test_repeated_ids_reach_the_driver_once(spark, monkeypatch):
    docs = spark.createDataFrame([(7, f"text {i}", "en") for i in range(300)] + [(8, "ein Text", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    assert quality.labelled_sample(docs, labels, "quality", 50).count() == 2
    docs = docs.union(spark.createDataFrame([(9, "another text", "en")], docs.schema))
    assert langid.sample_rows(docs, 2, 64).count() == 3


def test_quality_odd_rows(spark, odd):
    model = quality.train(["good words here", "BAD!! BAD!!", "more good words"], [1, 0, 1])
    scores = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert scores[1] == scores[2] == pytest.approx(2 / 3) and len(scores) == 6
    assert quality.train([], []).score(np.zeros((2, quality.WIDTH), np.float32)).tolist() == [1.0, 1.0]
    assert quality.train(["only"], [0]).score(np.array([quality.features("only")]))[0] == 0


def test_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None)], "doc_id long, quality int")
    one = {r.doc_id for r in quality.labelled_sample(docs, labels, "quality", 50).collect()}
    two = {r.doc_id for r in quality.labelled_sample(docs.repartition(7), labels.repartition(3), "quality", 50).collect()}
    assert one == two and len(one) == 50


def test_op7_held_out(spark, sf_dir, documents):
    lang = {i: x for i, _, x in documents}
    rows = queries.op7_language_id(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_language_odd_rows(spark, odd, documents):
    samples = {}
    for _, t, x in documents:
        samples.setdefault(x, []).append(t)
    model = langid.train({x: v[:40] for x, v in samples.items()})
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == ("und", 0.0, True) and len(got) == 6
    (pred, score, rejected), = model.classify(["東京は日本の首都です。" * 20])
    assert rejected and pred in samples and 0 <= score <= 1
    assert model.classify(["12 34 !?"]) == [("und", 0.0, True)]
    assert langid.train({}).classify(["some words"]) == [("und", 0.0, True)]


def plain_probability(texts, gram, order, discount=0.75):
    """Interpolated Kneser-Ney of the last symbol of ``gram``, from raw counts."""
    from collections import Counter

    size = len({tuple([c]) for t in texts for c in t}) + 1
    grams = lambda n: Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))

    def counts(n):
        if n == order:
            return grams(n)
        return Counter(g[1:] for g in grams(n + 1))

    def p(g):
        n, c = len(g), counts(len(g))
        if n == 1:
            total = sum(c.values())
            return max(c[g] - discount, 0) / total + discount * len(c) / total / size
        total = sum(v for k, v in c.items() if k[:-1] == g[:-1])
        kinds = sum(k[:-1] == g[:-1] for k in c)
        if not total:
            return p(g[1:])
        return max(c[g] - discount, 0) / total + discount * kinds / total * p(g[1:])

    return p(tuple(gram))


def test_kneser_ney_by_definition():
    texts = ["abracadabra abba", "barbara cab"]
    model = langid.train({"x": texts}, order=3)
    parts = [langid.symbols(t) for t in texts]
    text = langid.symbols("abracab dab")
    want = 0.0
    for i in range(1, len(text)):
        want += np.log2(plain_probability([tuple(p.tolist()) for p in parts], text[max(0, i - 2) : i + 1].tolist(), 3))
    got = model.entropies([text])[0, 0]
    assert got == pytest.approx(-want / (len(text) - 1), rel=1e-6)


def test_one_id_is_dealt_to_many_tasks(spark):
    """Files of a table whose rows have one id or none come from many partitions."""
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i // 4} of few words") for i in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder, index = arrow_tokens.write_tokens(docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = arrow_tokens.read_ids(folder, index).collect()
    assert len({r.partition for r in rows}) == 4 and len(rows) == 400
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None] * 200 + [7] * 200
