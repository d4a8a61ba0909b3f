"""Bounded-space best-fit packing: few sequences, no cut where none is needed.

Documents longer than a window are cut into whole windows and a rest; all other
pieces stay whole.  Pieces come one by one and go where the least space is left
that still holds them.  A fixed number of sequences is open at a time; a bitset
has a bit for each amount of free space that an open sequence has, so the best
fit is the lowest set bit at or above a piece's length.  A piece that fits
nowhere opens a sequence, and if as many as allowed are open, the fullest closes
first.  An open sequence is no more than its number and its free space: a piece
leaves as soon as it has its place, so memory does not grow with the texts.

Each partition packs its own stream; nothing is exchanged, and a partition that
is run again after a loss gives the same sequences.

Edge cases: a null or empty text has the end id alone; repeated rows are packed
each for itself; a row without an id gives pieces without one; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packing import default_tokenizer_path
from .tokens import CACHE_PIECES, batches_of, tokenizer

SCHEMA = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


class OpenSequences:
    """Places for pieces, one after the other; numbers of sequences count up from ``first``."""

    def __init__(self, window: int, most: int, first: int = 0):
        self.window, self.most, self.next = window, most, first
        self.open, self._spaces = 0, 0
        self._by_space: list[list[int]] = [[] for _ in range(window + 1)]

    def _take(self, space: int) -> int:
        held = self._by_space[space]
        number = held.pop()
        if not held:
            self._spaces ^= 1 << space
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of at most a window."""
        fitting = self._spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.window, self.next
            self.next += 1
        rest = space - length
        if rest:
            if self.open == self.most:
                self._take((self._spaces & -self._spaces).bit_length() - 1)
            self._by_space[rest].append(number)
            self._spaces |= 1 << rest
            self.open += 1
        return number, self.window - space


def pack_whole(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0,
    window: int = 2048, open_sequences: int = 4096, plain_specials: bool = False, cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """One row per piece; ``ids`` are little-endian unsigned 32-bit integers.

    sequence_id is unique over all partitions: the partition's number above, a
    running number in the low 36 bits.
    """
    path = tokenizer_path or default_tokenizer_path()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokenizer(path, False, plain_specials, cache_pieces)
        places = OpenSequences(window, open_sequences, TaskContext.get().partitionId() << 36)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                columns: list[list] = [[] for _ in names]
                for doc, ids in zip(doc_ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    raw = ids.tobytes() + end
                    total = len(raw) >> 2
                    for piece, start in enumerate(range(0, total, window)):
                        length = min(window, total - start)
                        row = (doc, piece, start, length, *places.place(length), raw[4 * start : 4 * (start + length)])
                        for column, value in zip(columns, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_whole(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op12_best_fit": op12_best_fit}
