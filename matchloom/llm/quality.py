"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of its words, by a hash, beside character-class trigrams,
word shapes and repetition marks.  Words are weighted by inverse document
frequency over all documents and count as much as the rest together.  A
truncated singular value decomposition of a bounded sample of labelled texts
gives the latent space; the sample's vectors and labels are broadcast, and each
document is compared with all of them by exact cosine products, block by block.
The nearest neighbours vote with weights that grow with similarity; all that
tie with the last of them (within ``TIE``) vote too, so copies in the sample and
the order of rows make no difference.

Only the text is read for a score.  The sample holds at most ``max_labelled``
rows, chosen by a hash of their id; their features are worked out in tasks, from
whole texts, and only these go to the driver.  So its work and the broadcast have
a fixed bound, and the choice does not depend on the order of rows.  Every text
is learned from and scored whole.

Edge cases: a null or empty text has no features and scores as the share of
label 1 in the sample, as does any text if there are no labels (then 1.0); null labels
are not learned from; repeated rows score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_beside, others

_CLASSES = 12
_TRIGRAMS = _CLASSES**3
_SHAPES = 256
_MARKS = 24
_PLAIN = _TRIGRAMS + _SHAPES + _MARKS
_WORDS = 1 << 12
WIDTH = _PLAIN + _WORDS
#: Cosines that differ by no more are alike.
TIE = 1e-6

#: Class of each ASCII character; letters beyond ASCII go with the lower case.
_CLASS = np.full(128, 9, np.uint8)
for _chars, _c in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\r\v\f", 3),
                   ("\n", 4), (".,", 5), ("!?", 6), ("'\"-;:()", 7), ("|", 8), ("#$%&*", 10)):
    for _ch in _chars:
        _CLASS[ord(_ch)] = _c


class _Words(dict):
    """Of words met before: number of the word's bucket above, of its shape in the low bits; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 80_000:
            self.clear()
        bucket = zlib.crc32(word.lower().strip(_EDGES).encode("utf-8", "replace")) % _WORDS
        made = self[word] = bucket * _SHAPES + _shape(word)
        return made


_EDGES = ".,;:!?()\"'|"
_SEEN = _Words()


def _shape(word: str) -> int:
    """A word's ends and case, as a feature number."""
    def kind(c: str) -> int:
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3

    length = min(len(word), 15) // 4
    letters = [c for c in word if c.isalpha()]
    case = 0 if not letters else 1 if len(letters) > 1 and all(map(str.isupper, letters)) else 2 if letters[0].isupper() else 3
    return ((kind(word[0]) * 4 + kind(word[-1])) * 4 + case) * 4 + length


def features(text: str | None) -> np.ndarray:
    """Term frequencies, damped; zeros for a text without words."""
    out = np.zeros(WIDTH, np.float32)
    words = (text or "").split()
    if not words:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 0).astype(np.int64)
    if len(kinds) > 2:
        grams = (kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:]
        out[:_TRIGRAMS] = np.bincount(grams, minlength=_TRIGRAMS)
        out[:_TRIGRAMS] /= len(grams)
    codes = np.fromiter(map(_SEEN.__getitem__, words), np.int64, len(words))
    out[_TRIGRAMS : _TRIGRAMS + _SHAPES] = np.bincount(codes % _SHAPES, minlength=_SHAPES) / len(words)
    out[_PLAIN:] = np.bincount(codes // _SHAPES, minlength=_WORDS) / len(words)
    marks = out[_TRIGRAMS + _SHAPES : _PLAIN]
    repeated = sum(map(str.__eq__, words, words[1:])) / max(1, len(words) - 1)
    distinct = len(set(words)) / len(words)
    lines = text.split("\n")
    same_lines = 1 - len(set(lines)) / len(lines)
    marks[min(7, int(repeated * 8))] = 1
    if len(words) >= 50:
        marks[8 + min(7, int(distinct * 8))] = 1
    marks[16 + min(7, int(same_lines * 8))] = 1
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    weights: np.ndarray  # per feature
    basis: np.ndarray  # features x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length one
    labels: np.ndarray
    prior: float
    neighbours: int
    power: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        return _unit((np.sqrt(rows) * self.weights) @ self.basis)

    def score(self, rows: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if not len(self.labels):
            return out
        latent, k = self.project(rows), min(self.neighbours, len(self.labels))
        for at in range(0, len(rows), block):
            cosine = latent[at : at + block] @ self.vectors.T
            last = np.partition(cosine, -k, axis=1)[:, -k][:, None]
            weight = np.where(cosine >= last - TIE, np.maximum(cosine, 0.0), 0.0) ** self.power
            total = weight.sum(axis=1, dtype=np.float64)
            vote = weight @ self.labels
            known = (total > 1e-9) & (rows[at : at + block].any(axis=1))
            out[at : at + block][known] = vote[known] / total[known]
        return np.clip(out, 0.0, 1.0)


def train(
    texts: list[str | None], labels: list[float], dimensions: int = 64, neighbours: int = 15, power: float = 8.0,
    found_in: np.ndarray | None = None, total: int = 0, rows: np.ndarray | None = None,
) -> Model:
    """Fit on a bounded sample; plain linear algebra on a few thousand rows.

    ``rows``: the features of the texts, where they are worked out already.

    ``found_in``: in how many of ``total`` documents each word bucket occurs;
    of the sample's own if not given.
    """
    y = np.array(labels, np.float64)
    prior = float(y.mean()) if len(y) else 1.0
    if rows is None:
        rows = np.array([features(t) for t in texts], np.float32).reshape(len(texts), WIDTH)
    seen, n = np.count_nonzero(rows, axis=0), np.full(WIDTH, len(rows))
    if found_in is not None:
        seen[_PLAIN:], n[_PLAIN:] = found_in, total
    weights = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    weights[_TRIGRAMS + _SHAPES : _PLAIN] *= 0.5
    if len(rows):
        # words weigh as much as all else, on average over the sample
        mass = rows.mean(axis=0) * weights**2
        weights[_PLAIN:] *= np.sqrt(mass[:_PLAIN].sum() / max(mass[_PLAIN:].sum(), 1e-9))
    np.sqrt(rows, out=rows)
    rows *= weights
    basis = _latent(rows, dimensions) if len(rows) else np.zeros((WIDTH, 1), np.float32)
    return Model(weights, basis, _unit(rows @ basis), y, prior, neighbours, power)


def _latent(rows: np.ndarray, dimensions: int, rounds: int = 8) -> np.ndarray:
    """The first right singular vectors, by subspace iteration from a fixed start."""
    start = np.random.default_rng(0).standard_normal((len(rows), min(dimensions + 16, len(rows))))
    q = start.astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(rows @ (rows.T @ q))
    return np.linalg.svd(q.T @ rows, full_matrices=False)[2][:dimensions].T.copy()


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_labelled: int, allowed=None) -> DataFrame:
    """At most ``max_labelled`` rows (doc_id, text, label), by a hash of the id; texts are whole."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    chosen = (
        known.groupBy("doc_id").agg(F.min(label_col).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # bounded by max_labelled rows of two numbers; one row stays of those that repeat an id
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    text = F.coalesce("text", F.lit(""))
    return found.groupBy("doc_id", "label").agg(F.min(text).alias("text")).select("doc_id", "text", "label")


def words_found(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each word bucket occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(_WORDS, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0):
                codes = np.fromiter(map(_SEEN.__getitem__, (text.as_py() or "").split()), np.int64)
                found[np.unique(codes // _SHAPES)] += 1
        _SEEN.clear()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_WORDS + 1)), pa.array(np.append(found, total))], ["bucket", "n"])

    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(_WORDS + 1, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # one row for each bucket
        out[r["bucket"]] = r["n"]
    return out[:-1], int(out[-1])


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 3000, allowed=None, **options,
) -> Model:
    """A model of at most ``max_labelled`` labelled rows; the driver sees their features, never their texts."""
    sample = labelled_sample(docs, labels, label_col, max_labelled, allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = features(batch.column(1)[i].as_py())
                at = np.flatnonzero(made).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(2).slice(i, 1).cast(pa.float64()), pa.array([at], pa.list_(pa.int32())), pa.array([made[at]], pa.list_(pa.float32()))],
                    ["doc_id", "label", "at", "value"])
        _SEEN.clear()

    featured = sample.select("doc_id", "text", F.col("label").cast("double").alias("label"))
    found = featured.mapInArrow(run, "doc_id long, label double, at array<int>, value array<float>").orderBy("doc_id", "label")
    rows, y = np.zeros((max_labelled, WIDTH), np.float32), []
    for r in found.toLocalIterator():
        rows[len(y), r["at"]] = r["value"]
        y.append(r["label"])
    found_in, total = words_found(docs)
    return train([None] * len(y), y, found_in=found_in, total=total, rows=rows[: len(y)], **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add ``out_col``, 0 to 1, to every row; other columns pass through."""
    from pyspark.sql.types import DoubleType, StructField

    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = others(docs.columns, out_col)
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            made = []
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(place).slice(at, 512).to_pylist()
                made.append(fitted.score(np.array([features(t) for t in texts], np.float32)))
            values = np.concatenate(made) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, out_col])
        _SEEN.clear()

    kept = docs.select(*[F.col(f"`{n}`") for n in names])
    return map_beside(kept, run, [StructField(out_col, DoubleType())])
