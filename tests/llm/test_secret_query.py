"""op1_secret_scan as registered: against plain Python, its SQL twin, and long texts."""

import hashlib
import math
import random
import re
import string
import time

import duckdb

from matchloom.llm import native_queries, secrets

from test_native import TEXTS, base_spans

UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
WORDS = re.compile(r"[A-Za-z0-9]{0,20}(?:(?i:example|sample|dummy|placeholder|changeme|redacted|x{6,})|(?i:abcdefgh|01234567|12345678|qwertyui))[A-Za-z0-9]{0,20}")
BASE64 = string.ascii_letters + string.digits + "+/"


def kind_of(w):
    bits = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
    digit, lower, upper = (any(map(f, w)) for f in (str.isdigit, str.islower, str.isupper))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(w, w[1:]))
    if not digit:
        rises = sum(a.isupper() != b.isupper() for a, b in zip(w, w[1:]))
        return "entropy_base64" if w.isalpha() and 8 <= sum(map(str.isupper, w)) <= 15 and rises >= 7 and bits >= 3.7 else None
    if set(w) <= set("0123456789abcdefABCDEF"):
        return "entropy_hex" if (lower or upper) and bits >= 3.0 else None
    if lower and upper:
        return "entropy_base64" if bits >= 3.5 else None
    if w.isalnum() and bits >= 3.4 and turns >= (5 if lower else 4):
        return "entropy_lower" if lower else "entropy_upper"
    return None


def allowed(c):
    if UUID.fullmatch(c) or re.fullmatch("[0-9+/_=-]+", c) or re.fullmatch("[A-Za-z0-9+/]{0,40}EXAMPLEKEY", c):
        return True
    return bool(re.fullmatch("[a-z0-9/_-]+", c) and not re.search("[0-9][a-z]", c))


def flagged(c):
    marks = [w.span() for w in WORDS.finditer(c)]
    for i in range(len(c) - 19):
        kind = kind_of(c[i : i + 20])
        if kind and not any(a < i + 20 and b > i for a, b in marks):
            yield i, kind


def group_keys(text):
    """Neighbouring words of one length, 4 to 8, behind single dashes."""
    words, run = list(re.finditer("[A-Za-z0-9]+", text)), []
    for w, after in zip(words, [*words[1:], None]):
        run.append(w)
        if after is None or text[w.end() : after.start()] != "-" or len(after[0]) != len(w[0]):
            if 4 <= len(w[0]) <= 8 and len(run) > 1 and len(w[0]) * len(run) >= 20:
                yield run[0].start(), w.end(), "".join(r[0] for r in run)
            run = []


def entropy_spans(text):
    out = [[a, 7, b, "entropy_groups"] for a, b, c in group_keys(text) if not allowed(text[a:b]) and any(flagged(c))]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        c, own = m[0], []
        if allowed(c):
            continue
        for i, kind in flagged(c):
            last = next((s for s in reversed(own) if s[3] == kind), None)
            if last and last[2] >= m.start() + i:
                last[2] = m.start() + i + 20
            else:
                own.append([m.start() + i, secrets.KINDS.index(kind), m.start() + i + 20, kind])
        out += own
    base = base_spans(text)
    return [tuple(s) for s in out if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def texts():
    r = random.Random(7)
    key = lambda symbols, n: "".join(r.choices(symbols, k=n))
    made = [*TEXTS, key(BASE64, 40) + "a" * 60 + key(BASE64, 40), "EXAMPLE" + key(BASE64, 90), key(string.ascii_lowercase + string.digits, 48)]
    made += ["é " + key(string.ascii_uppercase + "234567", 40) + " é " + key("0123456789abcdef", 30).upper(), "key-" + key(string.ascii_lowercase + string.digits, 40)]
    made += [" ".join(key(BASE64 + "=_-", r.randint(15, 60)) for _ in range(4)) for _ in range(12)]
    made += [key(BASE64, 3 * secrets.SLICE + 100), "v1/" * 40 + key(BASE64, 50), "x" * 200 + "1" + key(BASE64, 60), key(BASE64, 20), "a1B" * 40]
    made += ["-".join(key(s, g) for _ in range(6)) for s in (BASE64[:62], BASE64[26:62], BASE64[:52], string.ascii_uppercase + "0123456789") for g in (3, 4, 5, 8, 9)]
    made += ["key-A1B2C-D3E4F-G5H6J-K7L8M-N9P", "aB3dE-fG4hJ--kL5mN-pQ6rS-tU7vW-xY8zA-bC9", "x " + key(BASE64[:52], 40) + " y", "example/" + key(BASE64, 24) + " " + key(BASE64, 24) + "/sample"]
    made += ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "AbstractSingletonProxyFactoryBeanXMLHttpRequest", key(BASE64[:52], secrets.SLICE + 90)]
    return made + made[5:8]


def test_registered_query(spark, tmp_path):
    rows = [(i % 30, t, "other") for i, t in enumerate(texts())] + [(None, "token=abcdef12", None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in native_queries.op1_secret_scan(spark, str(tmp_path)).collect()]
    want = []
    for i, t, _ in rows:
        base = base_spans(t)
        n = [sum(s[1] == k for s in base) for k in range(3)]
        want.append((i, *n, hashlib.sha256(said(base).encode()).hexdigest(), said([*base, *entropy_spans(t or "")])))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(native_queries.OP1_SQL).fetchall(), key=repr) == sorted(want, key=repr)


def test_long_candidates_take_linear_time(spark):
    r = random.Random(3)

    def took(text):
        began = time.perf_counter()
        found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().secret_spans
        return time.perf_counter() - began, found

    took("warm up " + "Zx9Kq2LmP0vR7tWy4BnC8sDf1")
    assert took("a-" * 500_000 + "1")[1] == [] and took("ab12/" * 200_000)[1] == []
    short, _ = took("".join(r.choices(BASE64, k=100_000)))
    long, found = took("".join(r.choices(BASE64, k=1_000_000)))
    assert found[-1].end > 990_000 and long < 12 * short + 15


def test_words_hide_no_key_further_on(spark):
    r = random.Random(5)
    blob = "".join(r.choices(BASE64, k=300))
    docs = spark.createDataFrame([(1, f"sample{blob}")], "doc_id long, text string")
    spans = secrets.find_secrets(docs).first().secret_spans
    assert spans and min(s.start for s in spans) <= 6 + 25 and max(s.end for s in spans) >= 290


def test_kinds_of_keys_are_found(spark):
    """Keys of letters only, keys in groups, and keys behind a placeholder word."""
    r = random.Random(11)
    key = lambda symbols, n: "".join(r.choices(symbols, k=n))
    lower, upper = string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits
    kinds = {
        "letters": lambda: key(string.ascii_letters, 40),
        "lower groups": lambda: "-".join(key(lower, 5) for _ in range(5)),
        "upper groups": lambda: "-".join(key(upper, 5) for _ in range(5)),
        "behind a word": lambda: "example/" + key(BASE64[:62], 24),
    }
    rows = [(kind, f"see {make()} there") for kind, make in kinds.items() for _ in range(300)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "kind string, text string")).where("size(secret_spans) > 0")
    shares = {row.kind: row["count"] / 300 for row in found.groupBy("kind").count().collect()}
    assert all(shares.get(kind, 0) >= 0.9 for kind in kinds), shares


def test_plain_names_are_left_alone(spark):
    names = ["AbstractSingletonProxyFactoryBean", "InternalFrameInternalFrameTitlePaneMaximizeButtonWindowNotFocusedState",
             "SomeHTTPSURLParserXMLHTTPRequestURLParserJSON", "thisIsALongMethodNameInCamelCaseThatDoesNothing", "ThisIsACamelCaseNameOfAnOldType",
             "black-white-green-brown-other", "AAAA-BBBB-CCCC-DDDD-EEEE-FFFF", "path/To/SomeFile/WithCamelCase/InManyParts", "2024-2025-2026-2027-2028-2029"]
    docs = spark.createDataFrame([(n,) for n in names], "text string")
    assert [row.text for row in secrets.find_secrets(docs).collect() if row.secret_spans] == []
