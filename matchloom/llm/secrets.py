"""Secret scans in DataFrame expressions only.

Two sources of spans.  *Base* kinds are three patterns (an assignment to a
secret-like name, a cloud access key id, a long hex string).  The *entropy*
kinds slide a window over each candidate string (a maximal run of token
characters that holds a digit, or capitals within small letters) and keep its
symbol counts, packed into a few longs, by adding the character that enters and
taking away the one that leaves.  Windows whose Shannon entropy reaches the
threshold of their character class are flagged; flagged windows of a class that
overlap or touch are a span.  Windows of letters only need more: a higher
threshold, many capitals and many changes of case, which names in camel case
lack.  Groups of equal length, 4 to 8, parted by single dashes, are joined and
scanned as one; if a window of them is flagged, the whole is a span of its own.

The allow-list suppresses.  A pattern that begins with ``^`` holds for whole
candidates; any other marks its matches and the letters and digits that touch
them, one window at most on either side.  Windows that hold a mark are not
flagged, so a word hides neither a key further on nor one behind a separator.

Not found: keys of letters of one case only, which entropy cannot tell from
words run together, and keys of fewer characters than a window.

Candidates are scanned in slices that overlap, so a very long one costs time in
proportion to its length and memory for a slice.

Positions are code points, end exclusive.  A null text counts as empty; an
empty text has no spans.  Repeated rows are scanned each for itself, and other
columns of the input pass through untouched; only one of the output column's
name gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, let, others, prefix_sums

ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A maximal run shorter than the least length fails as a whole, and no part
#: of it can pass, so the length stands in the pattern itself.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper", "entropy_groups")
#: Symbols of candidates; a symbol's place is its number in the counts.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_MARK = "~"
#: Candidates are scanned in slices of so many windows.
SLICE = 1 << 14

ALLOW = (
    # identifiers that are random by design but no secrets
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    # paths and dashed words: letters, then digits, in each part
    r"^(?!.*[0-9][a-z])[a-z0-9/_-]+$",
    # numbers with separators
    r"^[0-9+/_=-]+$",
    # placeholders
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6,}",
    # the documented sample of a cloud secret key
    r"^[A-Za-z0-9+/]{0,40}EXAMPLEKEY$",
    # runs of the alphabet or of the digits
    r"(?i)abcdefgh|01234567|12345678|qwertyui",
)

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_OPEN = "array<struct<rank:int,start:int,end:int>>"


def _ends(text: Column, pattern: str, found: Column) -> Column:
    """End positions of matches: pieces and matches alternate from the start."""
    def steps(pieces: Column) -> Column:
        return F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
    return let(let(F.split(text, pattern, -1), steps), prefix_sums)


def _no_spans() -> Column:
    return F.array().cast(_SPANS)


#: Bits of a field of the class counts, and the fields.
_FIELD = 10
_HEXES, _DIGITS, _LOWERS, _UPPERS, _TURNS, _CASES = range(6)


def _class_code(symbol: str) -> int:
    held = {
        _HEXES: symbol in "0123456789abcdefABCDEF", _DIGITS: symbol.isdigit(), _LOWERS: symbol.islower(),
        _UPPERS: symbol.isupper(),
    }
    return sum(1 << (_FIELD * field) for field, yes in held.items() if yes)


def _marked(candidate: Column, words: Sequence[str], window: int) -> Column:
    """The candidate with matches of ``words``, and what touches them, overwritten by marks."""
    if not words:
        return candidate
    word = "|".join(f"(?:{w})" for w in words)
    beside = f"[A-Za-z0-9]{{0,{window}}}"
    pattern = f"{beside}(?:{word}){beside}"
    found = F.regexp_extract_all(candidate, F.lit(pattern), F.lit(0))
    rebuilt = F.array_join(F.zip_with(
        F.split(candidate, pattern, -1), found,
        lambda piece, m: F.concat(piece, F.repeat(F.lit(_MARK), F.coalesce(F.length(m), F.lit(0)))),
    ), "")
    return F.when(candidate.rlike(word), rebuilt).otherwise(candidate)


def _slice_spans(
    text: Column, first: Column, last: Column, window: int, hex_bits: float, base64_bits: float, case_bits: float,
    lower_turns: int, upper_turns: int, letter_bits: float, letter_uppers: int, letter_lowers: int, letter_turns: int,
) -> Column:
    """array<struct<rank, start, end>> of a slice; windows that start at ``first`` to ``last`` - 1 are judged.

    State of the fold: packed counts by symbol of the current window, the sum
    of c * log2(c) over them, packed counts by class, marks in the window, an
    open span for each class and the closed ones.
    """
    bits = window.bit_length()
    per = 63 // bits
    longs = -(-len(SYMBOLS) // per)
    weight = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    growth = F.array(*[F.lit(y - x) for x, y in zip(weight, weight[1:], strict=False)])  # of the sum, from one count to the next
    codes = F.array(*[F.lit(_class_code(c)).cast("long") for c in SYMBOLS])
    ranks = range(3, 7)

    def coded(held: Column) -> Column:
        """Class codes, with a turn where a digit meets a letter and one where a capital meets another symbol."""
        def one(code: Column, i: Column) -> Column:
            other = code.bitwiseXOR(F.coalesce(F.get(held, i - 1), code))
            return code + F.shiftleft(other.bitwiseAND(1 << (_FIELD * _DIGITS)), _FIELD * (_TURNS - _DIGITS)) + F.shiftleft(
                other.bitwiseAND(1 << (_FIELD * _UPPERS)), _FIELD * (_CASES - _UPPERS))
        return F.transform(held, one)

    def prepare(chars: Column) -> Column:
        number = F.transform(chars, lambda c: F.instr(F.lit(SYMBOLS), c) - 1)  # -1: a mark
        return let(number, lambda number: F.struct(
            F.transform(number, lambda n: F.when(n >= 0, F.floor(n / per)).otherwise(-1).cast("int")).alias("word"),
            F.transform(number, lambda n: F.pmod(n, F.lit(per)) * bits).alias("shift"),
            let(F.transform(number, lambda n: F.coalesce(F.get(codes, n), F.lit(0).cast("long"))), coded).alias("code"),
            F.transform(number, lambda n: (n < 0).cast("int")).alias("mark"),
            (~F.exists(number, lambda n: n < 0)).alias("clean"),
        ))

    def scan(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            word_in, shift_in = F.get(p["word"], i), F.get(p["shift"], i)
            word_out = F.when(i >= window, F.get(p["word"], i - window)).otherwise(-1)
            shift_out = F.when(i >= window, F.get(p["shift"], i - window)).otherwise(0)
            one = F.lit(1).cast("long")

            def held(word: Column, shift: Column) -> Column:
                return _shifted(F.get(acc["counts"], word), shift).bitwiseAND((1 << bits) - 1).cast("int")

            same = (word_in == word_out) & (shift_in == shift_out)
            counts = F.transform(acc["counts"], lambda c, j: F.when(j == word_in, F.when(
                j == word_out, c + _left(one, shift_in) - _left(one, shift_out)).otherwise(c + _left(one, shift_in))
            ).when(j == word_out, c - _left(one, shift_out)).otherwise(c))
            before_in, before_out = held(word_in, shift_in), held(word_out, shift_out)
            gain = F.when(word_in >= 0, F.get(growth, before_in)).otherwise(0.0)
            loss = F.when(word_out >= 0, F.get(growth, before_out - 1)).otherwise(0.0)
            return F.struct(
                F.when(same, acc["counts"]).otherwise(counts).alias("counts"),
                F.when(same, acc["mass"]).otherwise(acc["mass"] + gain - loss).alias("mass"),
                (acc["classes"] + F.get(p["code"], i) - F.when(i >= window, F.get(p["code"], i - window)).otherwise(0)).alias("classes"),
                F.when(p["clean"], acc["marks"]).otherwise(
                    acc["marks"] + F.get(p["mark"], i)
                    - F.when(i >= window, F.get(p["mark"], i - window)).otherwise(0)).alias("marks"),
                acc["open"].alias("open"), acc["closed"].alias("closed"),
            )

        def judged(acc: Column, i: Column) -> Column:
            start = i - (window - 1)

            def field(number: int, of: Column | None = None) -> Column:
                return F.shiftrightunsigned(acc["classes"] if of is None else of, _FIELD * number).bitwiseAND((1 << _FIELD) - 1)

            def kept(kind: Column) -> Column:
                """The state after a window of a kind: its open span goes on, or it is closed and a new one begins."""
                o = F.get(acc["open"], kind)
                fresh = start > o["end"]
                now = F.struct(o["rank"].alias("rank"), F.when(fresh, start).otherwise(o["start"]).alias("start"), (i + 1).alias("end"))
                return F.when(kind < 0, acc).otherwise(F.struct(
                    *[acc[k].alias(k) for k in ("counts", "mass", "classes", "marks")],
                    F.transform(acc["open"], lambda x, j: F.when(j == kind, now).otherwise(x)).alias("open"),
                    F.when(fresh & (o["end"] >= 0), F.concat(acc["closed"], F.array(o))).otherwise(acc["closed"]).alias("closed"),
                ))

            most = math.log2(window)
            hexes, digits, lowers, uppers = map(field, (_HEXES, _DIGITS, _LOWERS, _UPPERS))
            # turns between digits and letters tell a random key from words with a number
            turns, cases = (field(of) - field(of, F.get(p["code"], start)) for of in (_TURNS, _CASES))
            entropy = F.lit(most) - acc["mass"] / window
            letters = (
                (lowers + uppers == window) & (uppers >= letter_uppers) & (lowers >= letter_lowers)
                & (cases >= letter_turns) & (entropy >= letter_bits)
            )
            # no window is of two kinds
            kind = (
                F.when(digits == 0, F.when(letters, 1).otherwise(-1))
                .when(hexes == window, F.when((lowers + uppers > 0) & (entropy >= hex_bits), 0).otherwise(-1))
                .when((lowers > 0) & (uppers > 0), F.when(entropy >= base64_bits, 1).otherwise(-1))
                .when((lowers > 0) & (digits + lowers == window), F.when((entropy >= case_bits) & (turns >= lower_turns), 2).otherwise(-1))
                .when((uppers > 0) & (digits + uppers == window), F.when((entropy >= case_bits) & (turns >= upper_turns), 3).otherwise(-1))
                .otherwise(-1)
            )
            least = (most - min(hex_bits, base64_bits, case_bits, letter_bits)) * window + 1e-6
            asked = (acc["mass"] <= least) & (start >= first) & (start < last) & (acc["marks"] == 0) & (
                (field(_DIGITS) > 0) | (field(_UPPERS) >= letter_uppers))
            return F.when(asked, let(kind, kept)).otherwise(acc)

        none = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(-1).alias("start"), F.lit(-1).alias("end")) for r in ranks])
        begin = F.struct(
            F.array(*[F.lit(0).cast("long")] * longs).alias("counts"), F.lit(0.0).alias("mass"), F.lit(0).cast("long").alias("classes"),
            F.lit(0).alias("marks"),
            none.alias("open"), F.array().cast(_OPEN).alias("closed"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(p["word"]) - 1), begin,
            # the step's result is bound, so that it is worked out once
            lambda acc, i: let(step(acc, i), lambda now: judged(now, i)),
            lambda acc: F.concat(acc["closed"], F.filter(acc["open"], lambda o: o["end"] >= 0)),
        )

    return let(let(F.split(text, ""), prepare), scan)


def _shifted(value: Column, shift: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, shift)


def _left(value: Column, shift: Column) -> Column:
    return F.call_function("shiftleft", value, shift)


def _entropy(candidate: Column, scanned: Column, allow: Sequence[str], window: int, **limits) -> Column:
    """array<struct<rank, start, end>> of what is scanned of a candidate, by rank and start; spans do not touch."""
    whole, words = [a for a in allow if a.startswith("^")], [a for a in allow if not a.startswith("^")]

    def slices(marked: Column) -> Column:
        def one(at: Column) -> Column:
            begin = F.greatest(at - window, F.lit(0))
            part = F.substring(marked, begin + 1, at - begin + F.lit(SLICE + 2 * window))
            found = _slice_spans(part, at - begin, at - begin + SLICE, window, **limits)
            return F.transform(found, lambda s: F.struct(
                s["rank"].alias("rank"), (s["start"] + begin).alias("start"), (s["end"] + begin).alias("end")))
        starts = F.sequence(F.lit(0), F.length(marked) - window, F.lit(SLICE))
        return F.sort_array(F.flatten(F.transform(starts, one)))

    def joined(spans: Column) -> Column:
        """Spans that a border between slices has cut are put together."""
        def heads(at: Column) -> Column:
            return F.transform(at, lambda i, j: F.struct(
                F.get(spans, i)["rank"].alias("rank"), F.get(spans, i)["start"].alias("start"),
                F.get(spans, F.coalesce(F.get(at, j + 1), F.size(spans)) - 1)["end"].alias("end")))
        def head(i: Column) -> Column:
            before = F.get(spans, i - 1)
            return (i == 0) | (before["rank"] != F.get(spans, i)["rank"]) | (F.get(spans, i)["start"] > before["end"])
        return F.when(F.size(spans) > 0, let(F.filter(F.sequence(F.lit(0), F.size(spans) - 1), head), heads)).otherwise(spans)

    allowed = F.lit(False)
    for pattern in whole:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, F.array().cast(_OPEN)).otherwise(let(let(_marked(scanned, words, window), slices), joined))


def _groups(window: int) -> str:
    """Groups of equal length behind single dashes that hold a window together; possessive, so that none is tried twice."""
    one = "[A-Za-z0-9]"
    sizes = "|".join(
        f"{one}{{{size}}}(?:-{one}{{{size}}}(?!{one})){{{max(-(-window // size) - 1, 1)},}}+" for size in range(4, 9))
    return f"(?<!{one})(?={one}{{4,8}}-)(?:{sizes})"


def find_secrets(
    docs: DataFrame,
    text_col: str = "text",
    window: int = 20,
    hex_bits: float = 3.0,
    base64_bits: float = 3.5,
    allow: Sequence[str] = ALLOW,
    out_col: str = "secret_spans",
    case_bits: float = 3.4,
    lower_turns: int = 5,
    upper_turns: int = 4,
    letter_bits: float = 3.7,
    letter_uppers: int = 8,
    letter_lowers: int = 5,
    letter_turns: int = 7,
) -> DataFrame:
    """Add ``out_col``: array<struct<start, rank, end, kind>>, by start then kind.

    Entropy spans that lie within a base span are left out; base spans always
    stay.  ``allow`` suppresses the entropy scan only.  Windows of
    digits and letters of one case must reach ``case_bits`` and change between
    digits and letters at least ``lower_turns`` or ``upper_turns`` times.
    Windows of letters only must reach ``letter_bits``, hold ``letter_uppers``
    capitals and ``letter_lowers`` small letters and change between them
    ``letter_turns`` times.
    """
    if not 2 <= window <= 255:
        raise ValueError("window must be 2 to 255")
    run = r"[A-Za-z0-9+/_=-]"
    # a window of letters only with so many changes of case holds this many capitals behind other symbols
    rises = f"(?:[A-Z]*+[a-z+/_=-]++[A-Z]){{{max(letter_turns // 2, 1)}}}"
    candidate = rf"(?<!{run})(?=[A-Za-z+/_=-]*+[0-9]|{rises}){run}{{{window},}}"
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "cand": candidate, "entropy_groups": _groups(window)}
    keep = others(docs.columns, out_col)
    own = free_prefix(docs.columns)
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    df = docs.withColumn(f"{own}_text", t)
    # few texts hold what a match must: a value behind its sign, or a long run of token characters
    value = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
    df = df.select(
        "*", F.col(f"{own}_text").rlike(value).alias(f"{own}_value"),
        F.col(f"{own}_text").rlike(f"(?<!{run}){run}{{{min(window, 20)}}}").alias(f"{own}_runs"),
    )

    def matches(kind: str, pattern: str) -> Column:
        asked = F.col(f"{own}_value" if kind == "assign" else f"{own}_runs")
        every = F.regexp_extract_all(f"{own}_text", F.lit(pattern), F.lit(0))
        return F.when(asked, every).otherwise(F.array().cast("array<string>"))

    df = df.select("*", *[matches(k, p).alias(f"{own}_m_{k}") for k, p in patterns.items()])
    df = df.select("*", *[
        F.when(F.size(f"{own}_m_{k}") > 0, _ends(F.col(f"{own}_text"), p, F.col(f"{own}_m_{k}")))
        .otherwise(F.array().cast("array<int>")).alias(f"{own}_e_{k}")
        for k, p in patterns.items()
    ])

    def spans(kind: str, ok) -> Column:
        rank = KINDS.index(kind)
        found, ends = F.col(f"{own}_m_{kind}"), F.col(f"{own}_e_{kind}")
        made = F.zip_with(found, ends, lambda m, e: F.struct(
            (e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"),
            F.lit(kind).alias("kind"), ok(m).alias("ok"),
        ))
        kept = F.transform(F.filter(made, lambda s: s["ok"]), lambda s: F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.when(F.size(found) > 0, kept.cast(_SPANS)).otherwise(_no_spans())

    base = F.concat(
        spans("assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        spans("access", lambda m: F.lit(True)),
        spans("hex", lambda m: F.lit(True)),
    )
    df = df.withColumn(f"{own}_base", base)

    limits = {"hex_bits": hex_bits, "base64_bits": base64_bits, "case_bits": case_bits, "lower_turns": lower_turns, "upper_turns": upper_turns,
              "letter_bits": letter_bits, "letter_uppers": letter_uppers, "letter_lowers": letter_lowers, "letter_turns": letter_turns}
    scanned = F.zip_with(f"{own}_m_cand", f"{own}_e_cand", lambda m, e: let(e - F.length(m), lambda at: F.transform(
        _entropy(m, m, allow, window, **limits), lambda s: F.struct(
            (at + s["start"]).alias("start"), s["rank"].alias("rank"), (at + s["end"]).alias("end"),
            F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind")))))
    grouped = spans("entropy_groups", lambda m: F.size(_entropy(m, F.replace(m, F.lit("-")), allow, window, **limits)) > 0)
    df = df.withColumn(f"{own}_scan", F.when(
        (F.size(f"{own}_m_cand") > 0) | (F.size(f"{own}_m_entropy_groups") > 0), F.concat(F.flatten(scanned).cast(_SPANS), grouped)))

    added = F.filter(
        F.col(f"{own}_scan"),
        lambda s: ~F.exists(f"{own}_base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])),
    )
    every = F.when(F.col(f"{own}_scan").isNull(), F.col(f"{own}_base")).otherwise(F.concat(f"{own}_base", added))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.sort_array(every).alias(out_col))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """Replace each span by ``mask``; overlapping spans become one mask.

    A null text stays null.  Rows and other columns stay as they are.
    """
    name = f"{free_prefix(docs.columns)}_spans"
    spans, text = F.col(name), F.col(f"`{text_col}`")
    folded = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                (s["start"] >= acc["at"]) & (s["end"] > s["start"]),
                F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))),
            ).otherwise(acc["parts"]).alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    found = find_secrets(docs, text_col, out_col=name, **options)
    clean = F.when(F.size(spans) > 0, folded).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
