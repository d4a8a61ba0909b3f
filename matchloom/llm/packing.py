"""Hierarchical packing of token sequences into windows of several lengths.

Whole windows of the greatest length are cut from the start of a document; what
is left of it is routed to the smallest tier that holds it.  Tiers are packed
from long to short: each window takes one piece of its own tier, and its gap is
filled from shorter tiers, with whole pieces that fit first and with a cut piece
at last, so that windows are full.  What no full window takes at the end of a
partition goes into windows of smaller powers of two.  Windows of one length
form step groups of equal token counts; windows wait until two groups of them
are there, so that what is left at the end is levelled between the last two.

Each partition packs its own stream with bounded memory; nothing is exchanged,
and a partition that is run again gives the same windows.

Edge cases: a null or empty text has the end id alone; a text longer than any
window is cut; repeated rows are packed each for itself.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CACHE_PIECES, batches_of, tokenizer

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, step_group long, ids binary"
)


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens); windows come out of ``ready``."""

    def __init__(self, window: int = 2048, tiers: int = 4, step_tokens: int = 16384, hold: int = 1 << 18):
        self.window, self.hold, self.step_tokens = window, hold, step_tokens
        self.tiers = [window >> i for i in range(tiers)]
        self.queues: dict[int, deque] = {t: deque() for t in self.tiers}
        self.held = 0
        self.ready: list[tuple[int, int, list]] = []  # length, step group, pieces
        self._waiting: dict[int, list] = {}
        self._next_group = 0

    def _tier(self, n: int) -> int:
        return next(t for t in reversed(self.tiers) if n <= t)

    def _route(self, piece) -> None:
        self.queues[self._tier(len(piece[2]))].append(piece)
        self.held += len(piece[2])

    def _emit(self, length: int, pieces: list) -> None:
        """Windows of one length leave as a group once as many wait behind them."""
        waiting, size = self._waiting.setdefault(length, []), max(1, self.step_tokens // length)
        waiting.append(pieces)
        if len(waiting) == 2 * size:
            self._leave(length, size)

    def _leave(self, length: int, count: int) -> None:
        waiting = self._waiting[length]
        self.ready += [(length, self._next_group, pieces) for pieces in waiting[:count]]
        del waiting[:count]
        self._next_group += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self._emit(self.window, [(doc, at, ids[at : at + self.window], n)])
            at += self.window
        if at < n:
            self._route((doc, at, ids[at:], n))
        if self.held >= self.hold:
            self._pack()

    def _take(self, tier: int):
        piece = self.queues[tier].popleft()
        self.held -= len(piece[2])
        return piece

    def _filled(self, tier: int) -> list | None:
        """A full window of ``tier`` from its first piece and shorter tiers."""
        if self.held < tier:
            return None
        pieces = [self._take(tier)]
        gap = tier - len(pieces[0][2])
        for shorter in self.tiers:
            queue = self.queues[shorter]
            while queue and len(queue[0][2]) <= gap:
                pieces.append(self._take(shorter))
                gap -= len(pieces[-1][2])
        if gap:
            short = next((t for t in reversed(self.tiers) if self.queues[t]), None)
            while gap and short:
                doc, start, ids, n = self._take(short)
                pieces.append((doc, start, ids[:gap], n))
                if len(ids) > gap:
                    self._route((doc, start + gap, ids[gap:], n))
                gap -= len(pieces[-1][2])
                short = next((t for t in reversed(self.tiers) if self.queues[t]), None)
        return pieces

    def _pack(self) -> None:
        for tier in self.tiers:
            while self.queues[tier]:
                pieces = self._filled(tier)
                if pieces is None:
                    break
                self._emit(tier, pieces)

    def finish(self) -> None:
        """Windows of falling powers of two for what is left."""
        self._pack()
        rest = [self._take(t) for t in self.tiers for _ in range(len(self.queues[t]))]
        left = sum(len(p[2]) for p in rest)
        while left:
            length = 1 << (left.bit_length() - 1)
            gap, pieces = length, []
            while gap:
                doc, start, ids, n = rest.pop(0)
                pieces.append((doc, start, ids[:gap], n))
                if len(ids) > gap:
                    rest.insert(0, (doc, start + gap, ids[gap:], n))
                gap -= len(pieces[-1][2])
            self._emit(length, pieces)
            left -= length
        for length, waiting in self._waiting.items():
            if len(waiting) * length > max(length, self.step_tokens):
                self._leave(length, (len(waiting) + 1) // 2)
            if waiting:
                self._leave(length, len(waiting))


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
    end_id: int = 1, window: int = 2048, tiers: int = 4, step_tokens: int = 16384, plain_specials: bool = False,
    cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """One row per piece; ``ids`` are little-endian unsigned 32-bit integers.

    sequence_id and step_group are unique over all partitions: the partition's
    number above, a running number in the low 36 bits.
    """
    path = tokenizer_path or default_tokenizer_path()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        encoder, packer, sequence = tokenizer(path, False, plain_specials, cache_pieces), Packer(window, tiers, step_tokens), base
        end = np.array([end_id], np.uint32)

        def out() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for length, group, pieces in packer.ready:
                offset = 0
                for doc, start, ids, n in pieces:
                    rows.append((doc, start, len(ids), n, sequence, offset, length, base + group, ids.tobytes()))
                    offset += len(ids)
                sequence += 1
            packer.ready = []
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            types = [pa.int64()] * 8 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                for doc, ids in zip(doc_ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    packer.add(doc, np.concatenate([ids, end]))
                yield out()
        packer.finish()
        yield out()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
