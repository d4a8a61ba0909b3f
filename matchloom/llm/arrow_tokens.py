"""Token ids in Arrow stream-file format, as fixed-size-list batches.

Documents are dealt by ranges of their id, of a hash of the text and of the row,
so that no id, nor a missing one, must go to one task, and sorted, so that file
after file holds ascending ids.  A task writes its stream of ids as rows of one length
(``ids`` and a ``mask`` of real ids), in record batches of a set number of rows,
and renames the finished file to a name that only its partition and part have;
a task that runs again writes the same file again, and what a lost attempt left
unfinished is deleted at the end.  Files roll over at a set
number of rows, so a reader opens only what it needs.  The job's own result is
the index: for each document and file, where its ids lie.

Readers map a file into memory and slice rows without copying.

Edge cases: a null or empty text has the end id alone; equal ids are ordered by
a hash of their text, equal rows anyhow; null ids come first; an empty table gives no files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir
from .tokens import batches_of, tokenizer

SEQUENCE = 2048
BATCH_ROWS = 256
FILE_ROWS = 16384
INDEX = "doc_id long, part long, file string, file_start long, n_ids long, piece_start long, doc_ids long"


def schema(sequence: int, dtype) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence)),
    ])


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class _Writer:
    """Rolls files of a partition; a document's ids may go on in the next."""

    def __init__(self, folder: str, partition: int, sequence: int, dtype, batch_rows: int, file_rows: int):
        self.fs, self.folder = _filesystem(folder)
        self.partition, self.sequence, self.dtype = partition, sequence, dtype
        self.batch_rows, self.file_rows = batch_rows, file_rows
        self.part, self.file, self.rows = 0, None, 0
        self.held: list[np.ndarray] = []
        self.n_held = self.in_file = 0

    def name(self) -> str:
        return f"tokens-{self.partition:06d}-{self.part:06d}.arrow"

    def _batch(self, ids: np.ndarray, real: int) -> None:
        if self.file is None:
            from uuid import uuid4

            self.partial = f"{self.folder}/.{self.name()}.{uuid4().hex}"
            self.sink = self.fs.open_output_stream(self.partial)
            self.file = pa.ipc.new_file(self.sink, schema(self.sequence, self.dtype))
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        self.file.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)], ["ids", "mask"]
        ))
        self.rows += len(ids) // self.sequence

    def _flush(self, final: bool) -> None:
        block = self.batch_rows * self.sequence
        while self.n_held >= block or (final and self.n_held):
            joined = np.concatenate(self.held)
            real = min(block, len(joined))
            ids = np.zeros(-(-real // self.sequence) * self.sequence, self.dtype)
            ids[:real] = joined[:real]
            self._batch(ids, real)
            self.held, self.n_held = [joined[real:]], len(joined) - real

    def add(self, ids: np.ndarray) -> Iterator[tuple[int, str, int, int, int]]:
        """Where the ids went: (part, file, start there, how many, from which)."""
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.file_rows * self.sequence - self.in_file)
            yield self.part, self.name(), self.in_file, n, at
            self.held.append(ids[at : at + n].astype(self.dtype))
            self.n_held += n
            self.in_file += n
            at += n
            self._flush(False)
            if self.in_file == self.file_rows * self.sequence:
                self.close()

    def close(self) -> None:
        self._flush(True)
        if self.file is not None:
            self.file.close()
            self.sink.close()
            self.fs.move(self.partial, f"{self.folder}/{self.name()}")
            self.part += 1
        self.file, self.rows, self.held, self.n_held, self.in_file = None, 0, [], 0, 0


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(
    docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    tokenizer_path: str | None = None, end_id: int = 0, sequence: int = SEQUENCE, batch_rows: int = BATCH_ROWS,
    file_rows: int = FILE_ROWS, wide: bool = False, plain_specials: bool = False,
) -> tuple[str, DataFrame]:
    """Write all documents; returns the folder (a URI) and the index.

    Index: one row per document and file, doc_id, partition, part, file,
    file_start (ids before it in the file), n_ids, piece_start (ids of the
    document in files before), doc_ids (all of the document's), start (ids of
    all documents before, plus piece_start).  Ids are stored in 16 bits, or in 32 where ``wide``.
    """
    from uuid import uuid4

    path = tokenizer_path or default_tokenizer_path()
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid4().hex}"
    fs, local = _filesystem(folder)
    fs.create_dir(local, recursive=True)
    dtype = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        encoder, end = tokenizer(path, True, plain_specials), np.array([end_id], np.uint32)
        writer = _Writer(folder, partition, sequence, dtype, batch_rows, file_rows)
        names = ["doc_id", "partition", "part", "file", "file_start", "n_ids", "piece_start", "doc_ids"]
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for a, b in batches_of(texts):
                for doc, ids in zip(ids_of[a:b], encoder.encode(texts[a:b]), strict=True):
                    if not wide and len(ids) and ids.max() > 65535:
                        raise ValueError("an id needs more than 16 bits")
                    rows += [(doc, partition, *place, len(ids) + 1) for place in writer.add(np.concatenate([ids, end]))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        writer.close()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    place = ["doc_id", "hash", "row"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text")
    index = materialize(
        dealt.mapInArrow(run, INDEX.replace("part long", "partition long, part long")), "tokens-index"
    )
    from pyarrow.fs import FileSelector

    for left in fs.get_file_info(FileSelector(local)):
        if left.base_name.startswith(".tokens-"):
            fs.delete_file(left.path)
    # one row per file is left for the running total
    sizes = index.groupBy("partition", "part").agg(F.sum("n_ids").alias("n"))
    w = Window.orderBy("partition", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("partition", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    index = index.join(before, ["partition", "part"]).withColumn("start", F.col("before") + F.col("file_start"))
    return folder, index.drop("before")


def read_ids(folder: str, index: DataFrame) -> DataFrame:
    """The index rows with ``ids``, read from the files as uint32 bytes.

    Rows of a file are read by tasks that map the file (or open it, where the
    store is no local one) and decode the batches that the row touches.
    """
    from pyspark.sql.types import BinaryType, StructField, StructType

    out = StructType([*index.schema.fields, StructField("ids", BinaryType())])
    names = index.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = _filesystem(folder)
        name = reader = None
        batch_rows, held = 0, {}
        for batch in batches:
            for cut in range(0, batch.num_rows, 1000):
                part = batch.slice(cut, 1000)
                cols = part.to_pydict()
                made = []
                for file, start, n in zip(cols["file"], cols["file_start"], cols["n_ids"], strict=True):
                    if file != name:
                        where = f"{local}/{file}"
                        source = pa.memory_map(where) if fs.type_name == "local" else fs.open_input_file(where)
                        name, reader, held = file, pa.ipc.open_file(source), {}
                        sequence = reader.schema.field("ids").type.list_size
                        batch_rows = reader.get_batch(0).num_rows * sequence
                    got = []
                    for b in range(start // batch_rows, -(-(start + n) // batch_rows)):
                        if b not in held:
                            if len(held) > 4:
                                held.clear()
                            rb = reader.get_batch(b)
                            held[b] = [rb.column(i).values for i in (0, 1)]
                        ids, mask = held[b]
                        lo, hi = max(start - b * batch_rows, 0), min(start + n - b * batch_rows, batch_rows)
                        if mask.slice(lo, hi - lo).false_count:
                            raise ValueError(f"{file}: padding where ids should be")
                        got.append(ids.slice(lo, hi - lo).to_numpy(zero_copy_only=True))
                    made.append(np.concatenate(got).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*names, "ids"])

    return index.mapInArrow(run, out)
