"""Media columns: TIFF pages.

``encode`` makes a TIFF of one 8-bit grey page from bytes; ``read_pages`` walks
the image directories of each file, decodes PackBits, LZW or deflate strips
and tiles, undoes horizontal differencing and emits one row per page.

Both work batch by batch within a partition; nothing is exchanged.

Edge cases: a null file gives no page; a file that cannot be read gives one row
with ``error`` set and no pixels, as does a page whose size its stored bytes
cannot fill or that is larger than ``MOST_BYTES``; each repeated row gives its
pages again.
Payloads are padded with zeros to a positive multiple of the width.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_beside, others

#: Fixed values of the TIFF 6.0 format: tags, compressions, sizes of types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS = 256, 257, 258, 259, 262, 273
SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 277, 278, 279, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END_OF_INFORMATION = 256, 257

#: Decoded bytes of a page at most; a text of 2 GB fits.
MOST_BYTES = 1 << 31
#: Decoded bytes that one stored byte can give at most, by compression: deflate 1032, PackBits 64, LZW 4096 bytes for 9 bits.
_EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 3641, DEFLATE: 1032, OLD_DEFLATE: 1032}


def packbits_encode(data: bytes) -> bytes:
    out, i, n, literal = bytearray(), 0, len(data), 0
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3 or (run == 2 and literal == i):
            while literal < i:
                step = min(128, i - literal)
                out.append(step - 1)
                out += data[literal : literal + step]
                literal += step
            out += bytes((257 - run, data[i]))
            i += run
            literal = i
        else:
            i += run
    while literal < n:
        step = min(128, n - literal)
        out.append(step - 1)
        out += data[literal : literal + step]
        literal += step
    return bytes(out)


def packbits_decode(data: bytes, size: int | None = None) -> bytes:
    """At least ``size`` bytes where given; what stands behind them is not decoded."""
    out, i, n, made = [], 0, len(data), 0
    while i < n and (size is None or made < size):
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i, made = i + head + 2, made + head + 1
        elif head == 128:
            i += 1
        else:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i, made = i + 2, made + 257 - head
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early."""
    first = {bytes((i,)): i for i in range(256)}
    out, acc, filled = bytearray(), 0, 0
    table, following, width = dict(first), 258, 9

    def put(code: int) -> None:
        nonlocal acc, filled
        acc, filled = (acc << width) | code, filled + width
        while filled >= 8:
            filled -= 8
            out.append(acc >> filled)
            acc &= (1 << filled) - 1

    put(CLEAR)
    word = b""
    for at in range(len(data)):
        longer = word + data[at : at + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == 4094:
            put(CLEAR)
            table, following, width = dict(first), 258, 9
        elif following + 1 > (1 << width):
            width += 1
        word = data[at : at + 1]
    if word:
        put(table[word])
        following += 1
        if following + 1 > (1 << width) and width < 12:
            width += 1
    put(END_OF_INFORMATION)
    if filled:
        out.append((acc << (8 - filled)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int | None = None) -> bytes:
    """At least ``size`` bytes where given; what stands behind them is not decoded."""
    made, first = 0, [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, out, last = list(first), 9, [], b""
    acc = filled = 0
    for byte in data:
        acc, filled = (acc << 8) | byte, filled + 8
        if filled < width:
            continue
        filled -= width
        code = acc >> filled
        acc &= (1 << filled) - 1
        if code == CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if code == END_OF_INFORMATION:
            break
        if code < len(table):
            word = table[code]
            if last:
                table.append(last + word[:1])
        elif code == len(table) and last:
            word = last + last[:1]
            table.append(word)
        else:
            raise ValueError("LZW code beyond the table")
        out.append(word)
        last = word
        made += len(word)
        if size is not None and made >= size:
            break
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
    return b"".join(out)


def _compress(data: bytes, compression: int) -> bytes:
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 6) if compression == DEFLATE else data


def _decompress(data: bytes, compression: int, size: int) -> bytes:
    """``size`` bytes, or a little more."""
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == NONE:
        return data
    raise ValueError(f"compression {compression} is not read")


def encode(
    payloads: list[bytes], width: int = 64, compression: int = DEFLATE, predictor: int = 1,
    tile: int | None = None, rows_per_strip: int = 128, order: str = "<",
) -> bytes:
    """A file of one grey page per payload, in strips or in square tiles."""
    body = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for payload in payloads:
        height = max(1, -(-len(payload) // width))
        grey = np.zeros(height * width, np.uint8)
        grey[: len(payload)] = np.frombuffer(payload, np.uint8)
        grey = grey.reshape(height, width)
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = grey
            parts = [
                padded[y : y + tile, x : x + tile]
                for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)
            ]
        else:
            parts = [grey[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        if predictor == 2:
            parts = [np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1) for p in parts]
        offsets, counts = [], []
        for part in parts:
            stored = _compress(part.tobytes(), compression)
            offsets.append(len(body))
            counts.append(len(stored))
            body += stored + b"\0" * (len(stored) % 2)
        tags = {WIDTH: [width], LENGTH: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1]}
        tags |= {PREDICTOR: [2]} if predictor == 2 else {}
        if tile:
            tags |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts}
        else:
            tags |= {ROWS_PER_STRIP: [rows_per_strip], STRIP_OFFSETS: offsets, STRIP_COUNTS: counts}
        fields = bytearray()
        for tag, values in sorted(tags.items()):
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(packed) > 4:
                place = len(body)
                body += packed
                packed = struct.pack(order + "I", place)
            fields += struct.pack(order + "HHI", tag, 4, len(values)) + packed
        struct.pack_into(order + "I", body, link, len(body))
        body += struct.pack(order + "H", len(tags)) + fields
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and whole-number tags of each image directory."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            code = {1: "B", 3: "H", 4: "I"}.get(kind)
            if code is None:
                continue
            place = at + 10 + 12 * i
            if TYPE_SIZE[kind] * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + TYPE_SIZE[kind] * count > len(data):
                raise ValueError("values lie beyond the file")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def decode_page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    """The samples of a page: height x width x samples, 8 bits each."""
    width, height = tags[WIDTH][0], tags[LENGTH][0]
    samples = tags.get(SAMPLES, [1])[0]
    if set(tags.get(BITS, [1])) != {8}:
        raise ValueError("only samples of 8 bits are read")
    compression, predictor = tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not read")
    if TILE_OFFSETS in tags:
        across, down = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        across, down = width, min(tags.get(ROWS_PER_STRIP, [height])[0], height)
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if min(width, height, samples, across, down) < 1:
        raise ValueError("a size is zero")
    columns = -(-width // across)
    if len(offsets) != columns * -(-height // down):
        raise ValueError("strips or tiles do not cover the page")
    stored = sum(min(n, max(0, len(data) - at)) for at, n in zip(offsets, counts, strict=True))
    if width * height * samples > min(MOST_BYTES, stored * _EXPANSION.get(compression, 0) + 64):
        raise ValueError("the page is larger than its stored bytes can fill")
    if across * down * samples > 4 * max(width * height * samples, 1 << 20):
        raise ValueError("tiles are much larger than the page")
    out = np.zeros((height, width, samples), np.uint8)
    for i, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        y, x = i // columns * down, i % columns * across
        rows = down if TILE_OFFSETS in tags else min(down, height - y)
        size = rows * across * samples
        part = np.frombuffer(_decompress(data[at : at + n], compression, size), np.uint8, size).reshape(rows, across, samples)
        if predictor == 2:
            part = np.add.accumulate(part, axis=1, dtype=np.uint8)
        out[y : y + down, x : x + across] = part[: height - y, : width - x]
    return out


def feature(page: np.ndarray) -> str:
    """Size, mean, spread and entropy of a page's samples."""
    counts = np.bincount(page.reshape(-1), minlength=256)
    share = counts[counts > 0] / page.size
    mean = float(counts @ np.arange(256)) / page.size
    spread = (float(counts @ (np.arange(256) ** 2)) / page.size - mean**2) ** 0.5
    entropy = abs(float(-(share * np.log2(share)).sum()))
    return f"{page.shape[1]}x{page.shape[0]};mean={mean:.4f};spread={spread:.4f};bits={entropy:.4f}"


#: Ways to store a page; the ``mixed`` codec deals payloads among them by CRC-32.
LAYOUTS = (
    {"compression": PACKBITS}, {"compression": PACKBITS, "tile": 64},
    {"compression": LZW, "predictor": 2}, {"compression": LZW, "tile": 64},
    {"compression": DEFLATE, "predictor": 2}, {"compression": DEFLATE, "tile": 64, "predictor": 2},
)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layouts=LAYOUTS) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a TIFF of one page.

    The layout is chosen by the CRC-32 of the padded bytes, so equal texts
    give equal files.  A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8")
                padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
                sizes.append(len(raw))
                files.append(encode([padded], **layouts[zlib.crc32(padded) % len(layouts)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pages(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: the input's columns, then page, width, height,
    samples, pixels, feature and error."""
    from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField

    added = [
        ("page", IntegerType(), pa.int32()), ("width", IntegerType(), pa.int32()), ("height", IntegerType(), pa.int32()),
        ("samples", IntegerType(), pa.int32()), ("pixels", BinaryType(), pa.binary()),
        ("feature", StringType(), pa.string()), ("error", StringType(), pa.string()),
    ]
    names = others(files.columns, *[n for n, _, _ in added])
    place = names.index(media_col)

    def pages(data: bytes) -> Iterator[tuple]:
        n = 0
        try:
            for n, (_, tags) in enumerate(directories(data)):
                page = decode_page(data, tags)
                yield n, page.shape[1], page.shape[0], page.shape[2], page.tobytes(), feature(page), None
        except (ValueError, KeyError, IndexError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
            yield n, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, data in enumerate(batch.column(place)):
                if data.is_valid:
                    for row in pages(data.as_py()):
                        at.append(i)
                        rows.append(row)
            own = batch.take(pa.array(at, pa.int64()))
            made = [pa.array([r[j] for r in rows], t) for j, (_, _, t) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], [*own.schema.names, *[n for n, _, _ in added]])

    return map_beside(files.select(*[F.col(f"`{n}`") for n in names]), run, [StructField(n, t, True) for n, t, _ in added])
