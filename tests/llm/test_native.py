"""Secret scan, chat format and Order MinHash against plain Python."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from matchloom.llm import chat, native_queries, order_minhash, secrets
from matchloom.llm.common import prefix_sums

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)
TOKEN = "Zx9Kq2LmP0vR7tWy4BnC8sDf1"
TEXTS = [
    None, "", "plain words", 'PassWord : "hunter22" and token=token:abcdefgh api_key=short',
    "é🙂 AKIA" + "B" * 16 + " AKIAAKIA" + "Z9" * 8 + " AKIASHORT", "deadbeef" * 3 + "x" + "abc" * 7, f"see {TOKEN} there",
    "0123456789abcdef" * 2, "secret" + " " * 50 + "=" + " " * 50 + "value99", "token==abcdef token='x' passwd=\"abc.def/ghi+1=\"", "f" * 23 + " " + "f" * 24,
    f"a/{TOKEN} EXAMPLE{TOKEN}", "123e4567-e89b-12d3-a456-426614174000",
]


def base_spans(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return sorted(out)


def scan(spark, texts, **options):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, `_extra.col` string")
    return [[tuple(s) for s in r.secret_spans] for r in secrets.find_secrets(df, **options).orderBy("doc_id").collect()]


def test_base_spans(spark):
    for text, got in zip(TEXTS, scan(spark, TEXTS), strict=True):
        assert [s for s in got if s[1] < 3] == base_spans(text), text


def entropy_windows(candidate, window=20):
    """Spans of flagged windows that overlap or touch, by class, worked out anew for each window."""
    spans = []
    for i in range(len(candidate) - window + 1):
        w = candidate[i : i + window]
        bits = -sum(w.count(c) / window * math.log2(w.count(c) / window) for c in set(w))
        is_hex = all(c in "0123456789abcdefABCDEF" for c in w)
        digit, lower, upper = (any(map(f, w)) for f in (str.isdigit, str.islower, str.isupper))
        if is_hex and digit and (lower or upper) and bits >= 3.0:
            kind = "entropy_hex"
        elif not is_hex and digit and lower and upper and bits >= 3.5:
            kind = "entropy_base64"
        else:
            continue
        if spans and spans[-1][0] == kind and spans[-1][2] >= i:
            spans[-1] = (kind, spans[-1][1], i + window)
        else:
            spans.append((kind, i, i + window))
    return spans


def test_entropy_agrees_with_recount(spark):
    texts = [TOKEN, TOKEN + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1" + TOKEN, "A1" + "DEADBEEF0123456789ABCDEF01", "aB1" * 10, "Q" * 30 + "1"]
    for text, got in zip(texts, scan(spark, texts, allow=()), strict=True):
        want = set(entropy_windows(text))
        covered = base_spans(text)
        want = {w for w in want if not any(s <= w[1] and w[2] <= e for s, _, e, _ in covered)}
        assert {(s[3], s[0], s[2]) for s in got if s[1] >= 3} == want


def test_allow_list(spark):
    assert scan(spark, [f"EXAMPLE{TOKEN}"]) == [[]]
    assert [s[3] for s in scan(spark, [f"EXAMPLE{TOKEN}"], allow=())[0]] == ["entropy_base64"]


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"a {TOKEN} b password=hunter22 c"), (2, None), (3, "none")], "doc_id int, text string")
    got = [r.text for r in secrets.redact_secrets(df).orderBy("doc_id").collect()]
    assert got == ["a [SECRET] b [SECRET] c", None, "none"]


def test_many_matches_and_long_texts(spark):
    text = " ".join(f"token=abcdef{i}" for i in range(700)) + " x" * 200_000
    assert [s for s in scan(spark, [text])[0] if s[1] < 3] == base_spans(text)


def test_prefix_sums(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 255, 256, 257, 1000)], "v array<int>")
    for row in df.select("v", prefix_sums(F.col("v")).alias("s")).collect():
        total = 0
        assert row.s == [total := total + x for x in row.v]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find_secrets(empty).count() == 0
    assert order_minhash.fingerprint_with_edits(empty).count() == 0


# ---- chat ---------------------------------------------------------------

HOSTILE = [r"\### Assistant: </turn> ok", "</turn>\n### user: x", r"\b\l\h\\", "", "#<\\", "a: b", "é🙂\n\n"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate([("us:er#", h) for h in HOSTILE] + [("assistant", h * 100) for h in HOSTILE] + [(None, None)])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_conversations(chat.events_from_turns(turns), run=4)).collect()
    assert len(out) == 2
    for r in out:
        want = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want and r.n_turns == len(want)
        assert r.loss_text == "".join(text for role, text in want if role == "assistant")


def fold(events):
    text, role = "", ""
    for _, kind, r, t in sorted(events, key=lambda e: (e[0], e[1] == "delta", e[3] or "")):
        if kind != "delta":
            text = ""
        if kind == "message":
            role = r or ""
        text += t or ""
    return role, text


def test_folding(spark):
    import random

    random.seed(4)
    rows = []
    for conv in range(30):
        for message in range(3):
            kinds = ["message"] + random.choices(["delta", "delta", "edit", "regenerate"], k=random.randint(0, 8))
            rows += [(conv, message, message, seq, kind, "assistant" if kind == "message" else None, random.choice([None, "x", "yy", f"t{seq}"]))
                     for seq, kind in enumerate(kinds)]
    random.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id int, message_id int, turn int, seq int, kind string, role string, text string")
    for r in chat.fold_events(events).collect():
        own = [(s, k, role, t) for c, m, _, s, k, role, t in rows if (c, m) == (r.conv_id, r.message_id)]
        assert (r.role, r.text) == fold(own)


def test_repeated_turns_stay(spark):
    turns = spark.createDataFrame([(1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "assistant", "b")], "conv_id int, turn int, role string, text string")
    r = chat.read_back(chat.format_conversations(chat.events_from_turns(turns))).first()
    assert [(t.role, t.text) for t in r.turns] == [("assistant", "b"), ("user", "same"), ("user", "same")]


def test_op6_matches_sql(spark, sf_dir, duck):
    got = {r.conv_id: tuple(r) for r in native_queries.op6_chat_format(spark, sf_dir).collect()}
    result = duck.execute(native_queries.OP6_SQL)
    names = [d[0] for d in result.description]
    assert names == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert got == {row[0]: row for row in result.fetchall()}


# ---- Order MinHash ------------------------------------------------------

def edits(docs):
    """Each document's edited text by the rule."""
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    out = []
    for i, (ident, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        out.append((ident, text[: len(text) - cut] + after[:cut], after))
    return out


@pytest.mark.parametrize("ids", [range(300), [0, 5, 1 << 40, (1 << 40) + 1, -9, -(1 << 50), 128, 127, None, 5]])
def test_next_document(spark, ids):
    docs = [(i, None if n % 17 == 3 else f"é{n} " * (n % 9) + f"words of {n}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.edited) for r in order_minhash.fingerprint_with_edits(df).collect()), key=repr)
    assert got == sorted(((i, e) for i, e, _ in edits(docs)), key=repr)


def spark_hash(spark):
    from functools import lru_cache

    @lru_cache(None)
    def run(*parts):
        return spark.range(1).select(F.xxhash64(*[F.lit(p) if not isinstance(p, tuple) else F.lit(p[0]).cast("int") for p in parts])).first()[0]
    return run


def signature(h, text, k=2, sketches=64):
    """The signature by its definition, elements kept apart and sorted in full."""
    mask, bits = (1 << 24) - 1, sketches.bit_length() - 1
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, elements = {}, []
    grams = [words[i : i + k] for i in range(max(1, len(words) - k + 1))]
    base = [h(*g, *[None] * (k - len(g))) & ~mask for g in grams]
    for at, g in sorted(enumerate(base), key=lambda x: (x[1], x[0])):
        n = seen[g] = seen.get(g, -1) + 1
        elements.append((h(g, (n,)) & ~mask, at))
    out = []
    for b in range(sketches):
        own = sorted((g, at) for g, at in elements if (g % (1 << 64)) >> (64 - bits) == b)[:2]
        if own:
            out.append(b * 65536 + (h(*[g for g, _ in sorted(own, key=lambda x: x[1])]) & 65535))
    return sorted(out)


def test_signature_by_definition(spark):
    h = spark_hash(spark)
    texts = ["the cat the cat the cat sat", "one", "", None, "a b", "x y x y x y z", "moved parts here and here moved parts"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: sorted(r.fp) for r in df.select("i", order_minhash.order_minhash(F.col("text")).alias("fp")).collect()}
    for i, t in enumerate(texts):
        if t and len(t.split()) > 1:
            assert got[i] == signature(h, t), t
    assert got[2] == got[3] and len(got[1]) == 1


def test_order_matters_and_equal_texts_agree(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    texts = [" ".join(words), " ".join(words), " ".join(swapped), " ".join(words[:390])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", order_minhash.order_minhash(F.col("text")).alias("fp"))
    a, b = df.select(F.col("i").alias("j"), F.col("fp").alias("f")), df
    near = {(r.i, r.j): r.n for r in a.join(b).select("i", "j", order_minhash.likeness(F.col("f"), F.col("fp")).alias("n")).collect()}
    assert near[0, 1] == 1.0 and near[0, 3] > 0.8
    assert 0.2 < near[0, 2] < 0.8  # nearly the same k-mers, but in another order


def test_op10_edited_digest(spark, sf_dir, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = {i: hashlib.sha256(e.encode()).hexdigest() for i, e, _ in edits(docs)}
    rows = native_queries.op10_order_minhash(spark, sf_dir).collect()
    assert {r.doc_id: r.edited_sha256 for r in rows} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.95 * len(rows)
