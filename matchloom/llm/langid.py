"""Language identification by character language models.

For each language an interpolated Kneser-Ney model over lower-case letters and
spaces is learned from a bounded sample of its texts.  All n-grams stand in one
hash array per order, sorted, beside their log probabilities in each language;
contexts stand likewise beside their back-off weights.  A text belongs to the
language of least cross-entropy per character.  Rejection is calibrated on the
sample: a text is rejected if its cross-entropy exceeds what its language's own
texts show by a wide margin, longer texts being held closer to the mean.

Only the text is read for a prediction.  The sample holds at most
``max_per_language`` documents of each language, chosen by a hash of their id,
with ``max_chars`` characters together (one document at least), so the driver's
work is bounded; every text is learned from and scored whole.  A model of more than ``max_model_bytes`` raises an error before it is broadcast.  Texts that a model of the sample's other half
rejects are not learned from, so a wrong label does not make junk acceptable;
a language of fewer than twenty texts keeps all of them, and its limit follows
halves of its texts that a model of the other halves has not seen.

Edge cases: a null text and one without letters give ``und`` with score 0, as
does every text if nothing was learned; ties go to the first language by name;
repeated rows give the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_beside, others

UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32
#: So many texts of a language in a half judge those of the other.
_JUDGES = 10


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str | None) -> np.ndarray:
    """Lower-case letters, each run of other characters as one space, with a
    space at either end; empty if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return codes[:0]
    padded = np.full(len(codes) + 2, _SPACE, np.uint32)
    padded[1:-1] = np.where(letter, codes, _SPACE)
    space = padded == _SPACE
    return padded[~(space & np.concatenate([[False], space[:-1]]))]


def gram_hashes(s: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a symbol array, one per start."""
    h = s[: len(s) - n + 1].astype(np.uint64) + np.uint64(1)
    for i in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * _MIX + s[i : len(s) - n + 1 + i].astype(np.uint64) + np.uint64(1)
    return h


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[np.ndarray]  # per order: sorted hashes
    logp: list[np.ndarray]  # per order: hashes x languages, as if interpolated
    contexts: list[np.ndarray]  # per order of the longer gram, sorted
    backoff: list[np.ndarray]
    unseen: float
    mean: np.ndarray  # cross-entropy of a language's own texts
    spread: np.ndarray  # at one character; falls with the root of the length
    floor: np.ndarray

    def entropies(self, parts: list[np.ndarray]) -> np.ndarray:
        """Texts x languages: bits per symbol.  Each n-gram is looked up once."""
        n_lang = len(self.languages)
        lengths = np.array([len(p) for p in parts])
        joined = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), lengths)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        inside = np.arange(len(joined)) - first[owner]
        total = np.zeros((len(parts), n_lang))
        # the symbol at each place but the first, with as much context as there is
        at = np.flatnonzero(inside > 0)
        reach = np.minimum(inside[at] + 1, self.order)
        for n in range(2, self.order + 1):
            here = at[reach == n]
            if not len(here):
                continue
            logp = self._lookup(joined, here, n)
            total += np.stack(
                [np.bincount(owner[here], logp[:, j], len(parts)) for j in range(n_lang)], axis=1
            )
        return -total / np.maximum(lengths - 1, 1)[:, None] / np.log(2)

    def long_entropies(self, part: np.ndarray, block: int = 500_000) -> np.ndarray:
        """``entropies`` of one text, in blocks that carry their context."""
        bits = np.zeros((1, len(self.languages)))
        for a in range(0, max(1, len(part) - 1), block):
            before = min(a, self.order - 1)
            cut = part[a - before : a + block + 1]
            whole = self.entropies([cut]) * max(len(cut) - 1, 1)
            # what the context itself costs was counted with the block before
            bits += whole - (self.entropies([cut[: before + 1]]) * before if before else 0)
        return bits / max(len(part) - 1, 1)

    def _lookup(self, s: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of the n-grams that end at ``ends``."""
        h = s[ends - n + 1].astype(np.uint64) + np.uint64(1)
        prefix = h
        for i in range(n - 2, -1, -1):
            prefix = h
            h = (h ^ (h >> np.uint64(29))) * _MIX + s[ends - i].astype(np.uint64) + np.uint64(1)
        table = self.grams[n - 1]
        place = np.minimum(np.searchsorted(table, h), len(table) - 1)
        out = self.logp[n - 1][place]
        missing = np.flatnonzero(table[place] != h)
        if len(missing):
            if n == 1:
                out[missing] = self.unseen
                return out
            lower = self._lookup(s, ends[missing], n - 1)
            held = self.contexts[n - 1]
            where = np.minimum(np.searchsorted(held, prefix[missing]), len(held) - 1)
            known = held[where] == prefix[missing]
            out[missing] = lower + np.where(known[:, None], self.backoff[n - 1][where], 0.0)
        return out

    def classify(self, texts: list[str | None], block: int = 200_000) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        held, chars = [], 0
        for i, text in enumerate(texts):
            s = symbols(text)
            if len(s):
                held.append((i, s))
                chars += len(s)
            if held and (chars >= block or i == len(texts) - 1):
                self._classify([h[0] for h in held], [h[1] for h in held], out)
                held, chars = [], 0
        return out

    def _classify(self, places: list[int], parts: list[np.ndarray], out: list) -> None:
        bits = self.entropies(parts)
        best = bits.argmin(axis=1)
        n = np.array([len(p) for p in parts])
        rows = np.arange(len(parts))
        # posterior at a length of twenty symbols at most: long texts would all be at 1
        weight = np.exp2(-(bits - bits[rows, best][:, None]) * np.minimum(n, 20)[:, None])
        score = 1 / weight.sum(axis=1)
        limit = self.mean[best] + self.floor[best] + self.spread[best] / np.sqrt(n)
        rejected = bits[rows, best] > limit
        for i, b, p, r in zip(places, best, score, rejected, strict=True):
            out[i] = (self.languages[b], float(min(max(p, 0.0), 1.0)), bool(r))


def _grams(parts: list[np.ndarray], n: int, block: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Different n-grams, how often each is, and the grams without its first and its last symbol; counted in blocks."""
    made, held = [], []

    def counted(cut: list[np.ndarray]) -> None:
        hs = np.concatenate([gram_hashes(s, n) for s in cut])
        uniq, at, c = np.unique(hs, return_index=True, return_counts=True)
        suffix, prefix = (np.concatenate([gram_hashes(s, n - 1)[d] for s in cut])[at] if n > 1 else uniq for d in (slice(1, None), slice(None, -1)))
        made.append((uniq, c, suffix, prefix))

    size = 0
    for s in (p[a : a + block + n - 1] for p in parts for a in range(0, max(1, len(p) - n + 1), block)):
        if len(s) >= n:
            held.append(s)
            size += len(s)
        if size >= block:
            counted(held)
            held, size = [], 0
    if held:
        counted(held)
    if not made:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(0, np.int64), (none, none)
    every, times, suffix, prefix = (np.concatenate(x) for x in zip(*made, strict=True))
    uniq, at, where = np.unique(every, return_index=True, return_inverse=True)
    return uniq, np.bincount(where, times).astype(np.int64), (suffix[at], prefix[at])


def train(
    samples: dict[str, list[str | None]], order: int = 4, discount: float = 0.75, halved: bool = True,
    max_model_bytes: int = 400_000_000,
) -> Model:
    """Fit on a bounded sample: texts of each language."""
    languages = sorted(samples)
    parts = {x: [s for s in map(symbols, samples[x]) if len(s)] for x in languages}
    languages = [x for x in languages if parts[x]]
    n_lang = len(languages)
    tables: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    shorter: list[np.ndarray] = []  # of each n-gram: without its first symbol
    prefixes: list[np.ndarray] = []  # without its last
    size_of = 0
    for n in range(1, order + 1):
        per, info = [], {}
        for x in languages:
            uniq, c, info[x] = _grams(parts[x], n)
            per.append((uniq, c))
        table = np.unique(np.concatenate([u for u, _ in per])) if per else np.zeros(0, np.uint64)
        size_of += len(table) * n_lang * 8
        if size_of > max_model_bytes:
            raise ValueError(f"the model takes more than {max_model_bytes} bytes; learn from fewer texts or characters")
        matrix = np.zeros((len(table), n_lang), np.float32)
        left, right = np.zeros(len(table), np.uint64), np.zeros(len(table), np.uint64)
        for j, (x, (u, c)) in enumerate(zip(languages, per, strict=True)):
            where = np.searchsorted(table, u)
            matrix[where, j] = c
            if n > 1:
                left[where], right[where] = info[x]
        tables.append(table)
        counts.append(matrix)
        shorter.append(left)
        prefixes.append(right)
    # below the highest order, count the different symbols seen before a gram
    used = []
    for n in range(1, order + 1):
        if n == order:
            used.append(counts[n - 1])
            continue
        kinds = np.zeros_like(counts[n - 1])
        np.add.at(kinds, np.searchsorted(tables[n - 1], shorter[n]), (counts[n] > 0).astype(float))
        used.append(kinds)
    size = max(1, len(tables[0]) if tables else 1) + 1
    logp, contexts, backoff = [], [np.zeros(0, np.uint64)], [np.zeros((0, n_lang), np.float32)]
    prob = None
    for n in range(1, order + 1):
        c = used[n - 1]
        if n == 1:
            total = np.maximum(c.sum(axis=0), 1)
            spare = discount * (c > 0).sum(axis=0) / total
            prob = np.maximum(c - discount, 0) / total + spare / size
        else:
            context, group = np.unique(prefixes[n - 1], return_inverse=True)
            total, kinds = np.zeros((len(context), n_lang)), np.zeros((len(context), n_lang))
            np.add.at(total, group, c)
            np.add.at(kinds, group, (c > 0).astype(float))
            spare = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            lower = prob[np.searchsorted(tables[n - 2], shorter[n - 1])]
            prob = np.maximum(c - discount, 0) / np.maximum(total[group], 1) + spare[group] * lower
            contexts.append(context)
            backoff.append(np.log(np.maximum(spare, 1e-12)).astype(np.float32))
        logp.append(np.log(np.maximum(prob, 1e-12)).astype(np.float32))
    model = Model(languages, order, tables, logp, contexts, backoff, float(np.log(1 / size / 2)),
                  np.zeros(n_lang), np.zeros(n_lang), np.zeros(n_lang))
    for j, x in enumerate(languages):
        own = np.concatenate([model.long_entropies(p)[:, j] for p in parts[x]])
        n = np.array([len(p) for p in parts[x]])
        mean = float(np.average(own, weights=n))
        # a wide margin: texts of a language are not rejected for their own spread
        model.mean[j] = mean
        model.spread[j] = 3.0 * float(np.sqrt(np.mean((own - mean) ** 2 * n))) + 8.0
        model.floor[j] = 0.5 * mean
    # few texts show little of what others of their language look like: a half that the model has not seen shows more
    few = {x: [t or "" for t in samples[x]] for x in languages if len(parts[x]) < 2 * _JUDGES} if halved else {}
    for i in (0, 1) if few else ():
        cut = {x: [(t[: len(t) // 2], t[len(t) // 2 :]) for t in texts] for x, texts in few.items()}
        other = train({x: [c[i] for c in texts] for x, texts in cut.items()}, order, discount, halved=False, max_model_bytes=max_model_bytes)
        for x in other.languages:
            unseen = [s for s in (symbols(c[1 - i]) for c in cut[x]) if len(s)]
            if unseen:
                bits = other.entropies(unseen)[:, other.languages.index(x)]
                j = languages.index(x)
                model.mean[j] = max(model.mean[j], float(np.average(bits, weights=[len(s) for s in unseen])))
                model.floor[j] = max(model.floor[j], 0.5 * model.mean[j])
    return model


def sample_rows(docs: DataFrame, max_per_language: int, max_languages: int, allowed=None, max_chars: int = 4_000_000) -> DataFrame:
    """(lang, text) of the documents to learn from, whole, by a hash of their id.

    Of each language at most ``max_per_language`` documents that hold
    ``max_chars`` characters together, one at least; documents so long that
    twenty of them would not fit come last, the shortest first.  The window
    keeps a bounded number of ids of each language within each task before
    anything is exchanged; texts are fetched for those ids only.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).withColumn("_chars", F.coalesce(F.length("text"), F.lit(0)))
    if allowed is not None:
        known = known.where(allowed)
    # bounded by max_languages rows, and no language is left out in silence
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).select("lang")
    if common.count() > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages to learn them all")
    long = F.when(F.col("_chars") * 2 * _JUDGES > max_chars, F.col("_chars")).otherwise(0)
    w = Window.partitionBy("lang").orderBy("_long", F.xxhash64("doc_id"), "doc_id")
    first = (
        known.join(F.broadcast(common), "lang").select("doc_id", "lang", "_chars", long.alias("_long"))
        .withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= max_per_language)
    )
    # over the few rows of each language that are left
    upto = F.sum("_chars").over(Window.partitionBy("lang").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("_upto", upto).where((F.col("place") == 1) | (F.col("_upto") <= max_chars)).select("doc_id", "lang")
    # bounded by max_languages * max_per_language rows of two values
    found = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])
    # one row stays of those that repeat an id
    text = F.coalesce("text", F.lit(""))
    return found.groupBy("doc_id", "lang").agg(F.min(text).alias("text"))


def fit(docs: DataFrame, max_per_language: int = 200, max_languages: int = 64, allowed=None, max_chars: int = 4_000_000, **options) -> Model:
    rows = sample_rows(docs, max_per_language, max_languages, allowed, max_chars)
    samples: dict[str, list] = {}
    for r in sorted((r["lang"], r["doc_id"], r["text"]) for r in rows.toLocalIterator()):
        samples.setdefault(r[0], []).append(r[2])
    return train(_own(samples, **options), **options)


def _own(samples: dict[str, list], **options) -> dict[str, list]:
    """Samples without the texts that a model of the other half rejects: some labels are wrong."""
    halves = [{x: texts[i::2] for x, texts in samples.items()} for i in (0, 1)]
    models = [train(h, **options) for h in halves]
    kept: dict[str, list] = {}
    for half, model in zip(halves, models[::-1], strict=True):
        for x, texts in half.items():
            # too few texts of the language in the other half say nothing about these
            if len(samples[x]) < _JUDGES * 2 or x not in model.languages:
                fits = texts
            else:
                fits = [t for t, (_, _, out) in zip(texts, model.classify(texts), strict=True) if not out]
            kept[x] = kept.get(x, []) + fits
    return kept


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected to every row; other columns pass through."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = [("lang_pred", StringType(), pa.string()), ("score", DoubleType(), pa.float64()), ("rejected", BooleanType(), pa.bool_())]
    names = others(docs.columns, *[a for a, _, _ in added])
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            made = fitted.classify(batch.column(place).to_pylist())
            columns = [pa.array([m[i] for m in made], t) for i, (_, _, t) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[a for a, _, _ in added]])

    kept = docs.select(*[F.col(f"`{n}`") for n in names])
    return map_beside(kept, run, [StructField(a, t) for a, t, _ in added])
