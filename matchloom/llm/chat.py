"""Chat formatting from an event log, in DataFrame expressions only.

An event is (conv_id, message_id, turn, seq, kind, role, text):

* ``message`` opens a message with a role and, at choice, text,
* ``delta`` appends streamed text,
* ``edit`` replaces all that the message held,
* ``regenerate`` drops what it held; later deltas build it anew.

Messages are folded first, one group each; then turns of a conversation are
put together by runs of 64 turns, and the runs to the conversation, so no group
is larger than the record it makes.

Template: ``### role: text</turn>`` and a line break for each turn.  Inside texts
and roles ``\\`` is written ``\\b``, ``<`` is ``\\l`` and ``#`` is ``\\h``; in roles also
``:`` is ``\\c``.  So no text can hold a turn's mark or end, and undoing the
replacements in reverse order gives the text back.

Edge cases: null texts and roles count as empty; events of equal seq are taken
in text order, and an event that resets counts before deltas of its seq; a
message without opening event has an empty role; repeated events apply
repeatedly; turns that tie are ordered by role, then text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))
EVENT_COLUMNS = ("conv_id", "message_id", "turn", "seq", "kind", "role", "text")


def escape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, message_id, role, text): each message as it ended."""
    resets = F.col("kind").isin("message", "edit", "regenerate")
    order = F.struct("seq", F.when(resets, 0).otherwise(1).alias("late"), "text")
    folded = events.select(
        "conv_id", "message_id", "turn", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")
    ).groupBy("conv_id", "turn", "message_id").agg(
        F.max(F.when(resets, order)).alias("reset"),
        F.max_by("role", F.when(F.col("kind") == "message", F.col("seq"))).alias("role"),
        F.collect_list(order).alias("parts"),
    )
    live = F.filter("parts", lambda p: F.col("reset").isNull() | (p >= F.col("reset")))
    text = F.array_join(F.transform(F.sort_array(live), lambda p: p["text"]), "")
    return folded.select("conv_id", "turn", "message_id", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def format_conversations(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), run: int = 64) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    ``loss_spans`` has one entry per turn, in order: null, or the (start, end)
    code points of the turn's text within its segment of ``formatted`` (a
    segment is a turn with its end mark), if its role is in ``loss_roles``.
    """
    turns = fold_events(events).groupBy("conv_id", F.floor(F.col("turn") / run).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )

    def head(t: Column) -> Column:
        return F.concat(F.lit("### "), escape(t["role"], _ROLE_ESCAPES), F.lit(": "))

    def span(t: Column) -> Column:
        start = F.length(head(t))
        return F.when(
            t["role"].isin(*loss_roles),
            F.struct(start.alias("start"), (start + F.length(escape(t["text"]))).alias("end")),
        )

    segments = F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END)))
    runs = turns.select(
        "conv_id", "run", F.array_join(segments, "").alias("formatted"), F.transform("turns", span).alias("spans")
    )
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "formatted", "spans"))).alias("runs"))
    spans = F.flatten("runs.spans")
    return whole.select(
        "conv_id", F.size(spans).cast("long").alias("n_turns"),
        F.array_join("runs.formatted", "").alias("formatted"), spans.alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns``: array<struct<role, text>>, and ``loss_text``, from the output alone."""
    pieces = F.split("formatted", END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    cut = formatted.withColumn("_ml_pieces", pieces)

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substring(p, F.lit(5), F.length(p)), ": ", 1)
        return F.struct(
            unescape(role, _ROLE_ESCAPES).alias("role"),
            unescape(F.substring(p, F.length(role) + 7, F.length(p))).alias("text"),
        )

    masked = F.zip_with(
        "_ml_pieces", "loss_spans",
        lambda p, s: F.when(s.isNotNull(), unescape(F.substring(p, s["start"] + 1, s["end"] - s["start"]))),
    )
    return cut.select(
        *formatted.columns, F.transform("_ml_pieces", turn).alias("turns"), F.array_join(masked, "").alias("loss_text")
    )


def events_from_turns(turns: DataFrame, piece: int = 256) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text).

    Each row opens a message; assistant texts then stream in as deltas of
    ``piece`` code points, other texts come with the opening event.
    """
    rows = turns.select(
        "conv_id", F.monotonically_increasing_id().alias("message_id"), "turn", "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    streamed = F.col("role").eqNullSafe("assistant")
    first = F.struct(F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.when(~streamed, F.col("text")).alias("text"))
    starts = F.when(streamed, F.sequence(F.lit(0), F.length("text"), F.lit(piece))).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(
        starts, lambda at: F.struct((at + 1).alias("seq"), F.lit("delta").alias("kind"),
                                    F.substring(F.col("text"), at + 1, F.lit(piece)).alias("text"))
    )
    return rows.select(
        "conv_id", "message_id", "turn", "role", F.explode(F.concat(F.array(first), deltas)).alias("e")
    ).select("conv_id", "message_id", "turn", "e.seq", "e.kind", "role", "e.text")


def hostile_conversation(spark: SparkSession, conv_id: int = -7, text: str = r"\### Assistant: </turn> ok") -> DataFrame:
    """Events of a conversation whose texts look like the template's own marks.

    The assistant's turn is streamed, regenerated and edited before it ends.
    """
    rows = [
        (0, 0, 0, "message", "user", text),
        (1, 1, 0, "message", "assistant", None),
        (1, 1, 1, "delta", None, "### assistant: a draft</turn>"),
        (1, 1, 2, "regenerate", None, None),
        (1, 1, 3, "delta", None, "a second draft"),
        (1, 1, 4, "edit", None, text[:6]),
        (1, 1, 5, "delta", None, text[6:]),
    ]
    base = spark.range(1)
    events = F.array(*[
        F.struct(
            F.lit(conv_id).cast("long").alias("conv_id"), F.lit(m).cast("long").alias("message_id"),
            F.lit(t).cast("long").alias("turn"), F.lit(s).alias("seq"), F.lit(k).alias("kind"),
            F.lit(r).cast("string").alias("role"), F.lit(x).cast("string").alias("text"),
        )
        for m, t, s, k, r, x in rows
    ])
    return base.select(F.explode(events).alias("e")).select(*[f"e.{c}" for c in EVENT_COLUMNS])
