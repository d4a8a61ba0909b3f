"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A byte string has one encoding, and so does each of its prefixes; for each
prefix only the last token of that encoding is stored.  Token t may end a
prefix if it follows the last token of the prefix before it as merging would
leave the two: merging their bytes gives exactly those two tokens.  Exactly one
token passes.  (Ranks must be those of a trained vocabulary, where each merge
has a rank above those of its parts.)  Following last tokens back from the end gives the encoding, an
append only adds entries, and after an edit the entries before it still hold.

Edge cases: a null or empty text has no tokens; repeated rows repeat.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_beside, others
from .tokens import slices

#: Words whose encodings a worker keeps; the store is emptied when full.
CACHE_WORDS = 250_000
LONGEST_CACHED = 32


class PrefixEncoder:
    """Encodes byte strings with merge ranks (token bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._split: dict[int, list[int]] = {}

    def _merged(self, data: bytes, least: int = 1) -> list[int]:
        """Plain merging, least rank first, down to ``least`` parts; for short strings only."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > least:
            best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, token: int) -> list[int]:
        """The two tokens that the last merge of ``token`` joins; more if merging its bytes never gives it."""
        known = self._split.get(token)
        if known is None:
            known = self._split[token] = self._merged(self.bytes_of[token], 2)
        return known

    def _reachable(self, token: int) -> bool:
        return len(self._halves(token)) <= 2

    def _follows(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives exactly the two (left -1: the one).

        Merges are undone from the last to the first on either side of the seam.
        The seam is crossed if the tokens that then stand beside it have a merge
        of a rank below that of the merge undone before.
        """
        a, b, limit = left, right, 1 << 60
        bytes_of, get, halves = self.bytes_of, self.ranks.get, self._halves
        fits = self._reachable(right) and (left < 0 or self._reachable(left))
        while fits and left >= 0:
            across = get(bytes_of[a] + bytes_of[b])
            if across is not None and across < limit:
                fits = False
            elif len(bytes_of[a]) > 1 and (a > b or len(bytes_of[b]) == 1):
                a, limit = halves(a)[1], a
            elif len(bytes_of[b]) > 1:
                # of equal merges the one further left comes first
                b, limit = halves(b)[0], b + 1
            else:
                break
        if len(self._pairs) >= CACHE_WORDS:
            self._pairs.clear()
        self._pairs[left, right] = fits
        return fits

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Bring ``last`` (last[i]: last token of data[:i + 1]) up to all of ``data``."""
        get, pairs, follows, longest = self.ranks.get, self._pairs.get, self._follows, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                token = get(data[start:end])
                if token is None:
                    continue
                left = last[start - 1] if start else -1
                fits = pairs((left, token))
                if fits is None:
                    fits = follows(left, token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the ranks lack a single byte")
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, at, bytes_of = [], len(last), self.bytes_of
        while at:
            out.append(last[at - 1])
            at -= len(bytes_of[last[at - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self.walk(self.extend(data, []))

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace data[start:end]; entries before ``start`` are kept."""
        data = data[:start] + new + data[end:]
        return data, self.extend(data, last[:start])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str):
    """Encoder, compiled pattern and the words met so far, one per worker."""
    import regex

    return PrefixEncoder(read_ranks(path)), regex.compile(pattern), {}


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> pa.Array:
    """The bytes of each id; null where there is no such id."""
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def _raw_ids(words: list[str], encoder: PrefixEncoder, seen: dict[str, bytes]) -> list[bytes]:
    """The ids of different words as bytes of 32-bit integers; each new word is encoded once."""
    raws = list(map(seen.get, words))
    new = [i for i, r in enumerate(raws) if r is None]
    for i in new:
        data = words[i].encode("utf-8")
        token = encoder.ranks.get(data)
        raws[i] = array("i", encoder.encode(data) if token is None else [token]).tobytes()
    if len(seen) + len(new) > CACHE_WORDS:
        seen.clear()
    seen.update((words[i], raws[i]) for i in new if len(words[i]) <= LONGEST_CACHED)
    return raws


def encode_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """(doc_id, ids array<int>) of each text; each match of ``pattern`` by itself."""
    import public_tokenizers

    path, pattern = ranks_path or default_ranks_path(), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words, seen = _worker(path, pattern)
        for batch in batches:
            for start, stop in slices(batch.column(1), 2_000_000):
                flat, ends = [], [0]
                for text in batch.column(1).slice(start, stop - start).to_pylist():
                    flat += words.findall(text or "")
                    ends.append(len(flat))
                # each different word is looked up once; Arrow puts the ids in the order of the texts
                coded = pa.array(flat, pa.string()).dictionary_encode()
                table = pa.array(_raw_ids(coded.dictionary.to_pylist(), encoder, seen), pa.binary())
                taken = table.take(coded.indices)
                _, offsets, data = taken.buffers()
                sums = np.frombuffer(offsets or b"\0" * 4, np.int32, len(taken) + 1)[ends] // 4
                ids = pa.array(np.frombuffer(data or b"", np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.ListArray.from_arrays(pa.array(sums), ids)], ["doc_id", "ids"]
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ids_col: str = "ids", ranks_path: str | None = None, out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the bytes that the ids stand for.  Null ids give null."""
    from pyspark.sql.types import BinaryType, StructField

    path = ranks_path or default_ranks_path()
    names = others(encoded.columns, out_col)
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(place)
                # the bytes of the tokens stand one after the other; documents are cut from them
                tokens = table.take(ids.flatten())
                lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                _, offsets, data = tokens.buffers()
                ends = np.frombuffer(offsets, np.int32, len(tokens) + 1)[edges]
                made = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends)), data])
                if ids.null_count:
                    made = pc.if_else(ids.is_valid(), made, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out_col])

    kept = encoded.select(*[F.col(f"`{n}`") for n in names])
    return map_beside(kept, run, [StructField(out_col, BinaryType())])
