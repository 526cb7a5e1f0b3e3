"""Media columns (8): TIFF images as binary columns.

`read_pages` walks the chain of image directories and decodes strips or tiles stored raw or by PackBits, LZW
or deflate, undoes horizontal prediction, and gives one row per page. `write_pages` makes multi-page files.
`store_payload` / `load_payload` keep arbitrary bytes losslessly as 8-bit grey samples, 64 to a row; a payload's checksum
says in which of the layouts (compression, strips or tiles, prediction, byte order), so that a corpus has files of all of them.

Layout and code points follow the public TIFF 6.0 specification.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import free_name, map_arrow, slices, text_sizes, texts_of

# Fixed values of the format: tags, field sizes by type, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST_FREE, MOST_BITS = 256, 257, 258, 12


class TiffError(ValueError):
    """The bytes aren't a TIFF file this reader can decode."""


# --- codecs -------------------------------------------------------------------------------------------


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


RUN = re.compile(rb"(.)\1{2,}", re.S)


def pack_bits(data: bytes) -> bytes:
    """Runs of three bytes or more as runs, all else as literals."""
    out, at = bytearray(), 0

    def literals(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(end, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in RUN.finditer(data):
        literals(m.start())
        at = m.end()
        for k in range(m.start(), at, 128):
            out += bytes(((257 - min(128, at - k)) & 255, data[k]))  # a rest of one byte has code 0, a literal
    literals(len(data))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Variable-length codes, most significant bit first; the width grows one code early."""
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, out, before = list(single), bytearray(), b""
    bits = held = at = 0
    width = 9
    while len(out) < size:
        while held < width:
            if at >= len(data):
                return bytes(out)
            bits, held, at = (bits << 8) | data[at], held + 8, at + 1
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == END:
            break
        if code == CLEAR:
            words, width, before = list(single), 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif before and code == len(words):
            word = before + before[:1]
        else:
            raise TiffError(f"LZW code {code} out of range")
        out += word
        if before:
            words.append(before + word[:1])
        before = word
        width = min(MOST_BITS, (len(words) + 1).bit_length())
        width = max(9, width)
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    table = {bytes((i,)): i for i in range(256)}
    out, bits, held, width, free = bytearray(), CLEAR, 9, 9, FIRST_FREE
    word = b""

    def drain() -> None:
        nonlocal bits, held
        while held >= 8:
            held -= 8
            out.append((bits >> held) & 255)
        bits &= (1 << held) - 1

    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        bits, held = (bits << width) | table[word], held + width
        drain()
        table[longer] = free
        free += 1
        if free == (1 << MOST_BITS) - 1:
            bits, held = (bits << width) | CLEAR, held + width
            drain()
            table, width, free = {bytes((k,)): k for k in range(256)}, 9, FIRST_FREE
        else:
            width = min(MOST_BITS, max(9, free.bit_length()))
        word = data[i : i + 1]
    if word:
        bits, held, free = (bits << width) | table[word], held + width, free + 1
        drain()
        width = min(MOST_BITS, max(9, free.bit_length()))
    bits, held = (bits << width) | END, held + width
    drain()
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def decompress(data: bytes, kind: int, size: int) -> bytes:
    if kind == RAW:
        return data
    if kind == PACKBITS:
        return unpack_bits(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, max(1, size))  # no more than the strip can hold
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    raise TiffError(f"compression {kind} isn't supported")


def compress(data: bytes, kind: int, level: int) -> bytes:
    return {RAW: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, level)}[kind](data)


# --- reading ------------------------------------------------------------------------------------------


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x width x samples


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, list], int]:
    if at + 2 > len(data):
        raise TiffError("directory beyond the end")
    (n,) = struct.unpack_from(f"{order}H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("directory beyond the end")
    found: dict[int, list] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind not in FIELD_CODE or not count:
            continue
        room = FIELD_BYTES[kind] * count
        place = at + 10 + 12 * k
        if room > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if place + room > len(data):
            raise TiffError(f"field {tag} beyond the end")
        found[tag] = list(struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", data, place))
    return found, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _segment(data: bytes, order: str, f: dict, place: int, room: int, height: int, width: int, samples: int, bits: int) -> np.ndarray:
    if place + room > len(data):
        raise TiffError("image data beyond the end")
    size = height * width * samples * bits // 8
    raw = decompress(data[place : place + room], f.get(COMPRESSION, [RAW])[0], size)
    if len(raw) < size:
        raise TiffError("image data too short")
    grid = np.frombuffer(raw, dtype=f"{order}u{bits // 8}", count=height * width * samples).reshape(height, width, samples)
    predictor = f.get(PREDICTOR, [1])[0]
    if predictor == 2:  # each sample was stored as its difference from the left neighbour
        grid = np.cumsum(grid, axis=1, dtype=grid.dtype.newbyteorder("="))
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} isn't supported")
    return grid


#: Bytes of samples that a compressed byte can stand for at most, by compression: a header that claims more is damaged.
MOST_GROWTH = {RAW: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1100, OLD_DEFLATE: 1100}


def _plausible(f: dict, sizes: list[int], cells: int, cell_bytes: int) -> None:
    """Raises where the strips or tiles can't fill the page, so that no memory is taken on a damaged header's word."""
    growth = MOST_GROWTH.get(f.get(COMPRESSION, [RAW])[0])
    if growth is None:
        raise TiffError(f"compression {f[COMPRESSION][0]} isn't supported")
    if cells * cell_bytes > growth * sum(sizes) + cell_bytes and cells * cell_bytes > 1 << 16:
        raise TiffError("the image data can't fill a page of this size")


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page of a file in directory order. Raises TiffError on what it can't decode."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen, number = set(), 0
    while at:
        if at in seen:
            raise TiffError("the directories form a ring")
        seen.add(at)
        f, following = _fields(data, order, at)
        if WIDTH not in f or HEIGHT not in f:
            raise TiffError("page without a size")
        width, height, samples = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, [1])[0]
        bits = f.get(BITS, [1])[0]
        if bits not in (8, 16, 32) or len(set(f[BITS])) > 1:
            raise TiffError(f"{f.get(BITS)} bits a sample aren't supported")
        planes = samples if f.get(PLANAR, [1])[0] == 2 else 1
        inner = samples // planes
        if not (width > 0 and height > 0 and samples > 0):
            raise TiffError("page without samples")
        tiled = TILE_OFFSETS in f
        if tiled:
            if any(not f.get(t, [0])[0] > 0 for t in (TILE_WIDTH, TILE_HEIGHT)):
                raise TiffError("tiles without a size")
            tw, th = f[TILE_WIDTH][0], f[TILE_HEIGHT][0]
        else:
            tw, th = width, min(height, f.get(ROWS_PER_STRIP, [height])[0]) or 1
        across, down = -(-width // tw), -(-height // th)
        places, rooms = (f[TILE_OFFSETS], f.get(TILE_BYTES, [])) if tiled else (f.get(STRIP_OFFSETS, []), f.get(STRIP_BYTES, []))
        if len(places) < across * down * planes or len(rooms) < len(places):
            raise TiffError("too few strips or tiles")
        _plausible(f, rooms, across * down * planes, tw * min(th, height) * inner * bits // 8)
        pixels = np.zeros((height, width, samples), dtype=f"u{bits // 8}")
        for k in range(across * down * planes):
            plane, cell = divmod(k, across * down)
            y, x = cell // across * th, cell % across * tw
            tall = th if tiled else min(th, height - y)
            grid = _segment(data, order, f, places[k], rooms[k], tall, tw, inner, bits)
            own = slice(plane, plane + 1) if planes > 1 else slice(None)
            pixels[y : y + th, x : x + tw, own] = grid[: height - y, : width - x]
        yield Page(number, width, height, samples, bits, f.get(COMPRESSION, [RAW])[0], f.get(PREDICTOR, [1])[0], pixels)
        at, number = following, number + 1


# --- writing ------------------------------------------------------------------------------------------


def write_pages(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, level: int = 1, order: str = "<",
) -> bytes:
    """A file of pages (height x width [x samples], unsigned 8, 16 or 32 bits). `tile`: height and width, multiples of 16."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        grid = page.reshape(page.shape[0], page.shape[1], -1)
        height, width, samples = grid.shape
        bits = grid.dtype.itemsize * 8
        th, tw = tile or (min(rows_per_strip, height), width)
        places, rooms = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                part = grid[y : y + th, x : x + tw]
                if tile and part.shape[:2] != (th, tw):
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                stored = compress(part.astype(part.dtype.newbyteorder(order)).tobytes(), compression, level)
                places.append(len(out))
                rooms.append(len(stored))
                out += stored
        if len(out) % 2:
            out.append(0)
        fields = [
            (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [bits] * samples), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [2 if samples == 3 else 1]),
            (SAMPLES, "H", [samples]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor]), (SAMPLE_FORMAT, "H", [1] * samples),
        ]
        fields += [(TILE_WIDTH, "I", [tw]), (TILE_HEIGHT, "I", [th]), (TILE_OFFSETS, "I", places), (TILE_BYTES, "I", rooms)] if tile else [(STRIP_OFFSETS, "I", places), (ROWS_PER_STRIP, "I", [th]), (STRIP_BYTES, "I", rooms)]
        fields.sort()
        at = len(out)
        struct.pack_into(f"{order}I", out, link, at)
        beyond = at + 2 + 12 * len(fields) + 4
        head, tail = bytearray(struct.pack(f"{order}H", len(fields))), bytearray()
        for tag, code, values in fields:
            packed = struct.pack(f"{order}{len(values)}{code}", *values)
            head += struct.pack(f"{order}HHI", tag, 3 if code == "H" else 4, len(values))
            if len(packed) > 4:
                head += struct.pack(f"{order}I", beyond + len(tail))
                tail += packed + b"\0" * (len(packed) % 2)
            else:
                head += packed.ljust(4, b"\0")
        link = at + len(head)
        out += head + b"\0\0\0\0" + tail
    return bytes(out)


ROW = 64
PAGE_ROWS = 16_384


#: Layouts of stored payloads: (compression, predictor, tile, byte order).
LAYOUTS = (
    (DEFLATE, 1, None, "<"), (LZW, 1, None, "<"), (PACKBITS, 1, None, ">"), (DEFLATE, 2, None, ">"), (LZW, 2, (64, 64), "<"), (PACKBITS, 2, (128, 32), "<"), (DEFLATE, 1, (256, 32), "<"), (RAW, 1, (64, 32), ">"),
)


def store_payload(payload: bytes) -> bytes:
    """A payload whose size is a positive multiple of 64, as pages of 64 samples a row and 16,384 rows at most; equal payloads, equal files."""
    grid = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    compression, predictor, tile, order = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    return write_pages([grid[k : k + PAGE_ROWS] for k in range(0, len(grid), PAGE_ROWS)], compression, predictor, tile=tile, order=order)


def load_payload(stored: bytes) -> tuple[bytes, list[Page]]:
    """(payload, pages) of a file that store_payload() made."""
    pages = list(read_pages(stored))
    if not pages:
        raise TiffError("a file without pages")
    return b"".join(p.pixels.tobytes() for p in pages), pages


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % ROW or (ROW if not data else 0))


def features(payload: bytes, pages: list[Page]) -> str:
    """Sizes and exact integer statistics of the samples: page count, last page, sum, distinct values, eight-bin histogram."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    bins = counts.reshape(8, 32).sum(axis=1)
    return f"pages={len(pages)};width={pages[-1].width};height={pages[-1].height};sum={int(counts @ np.arange(256))};distinct={int((counts > 0).sum())};hist=" + ",".join(map(str, bins.tolist()))


# --- DataFrames ---------------------------------------------------------------------------------------

#: Bytes of texts or files that are taken up at once (a larger one alone).
SLICE_BYTES = 1 << 21


def texts_to_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as one TIFF file. Null and empty texts become 64 zero samples; repeated rows each have a file; an empty table gives none."""
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("n_bytes long, media binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_sizes(whole.column(1)), SLICE_BYTES):
                texts = texts_of(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([store_payload(padded(x)) for x in texts], pa.binary())], ["id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, out).withColumnRenamed("id", id_col)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"
FAULTS = (TiffError, struct.error, ValueError, KeyError, IndexError, OverflowError)


def _rows(media: DataFrame, id_col: str, media_cols: list[str], schema: str, make) -> DataFrame:
    """Rows that `make` gives for the values of each file's columns, the bytes last, behind the file's id."""
    own = T.StructType.fromDDL(schema)
    key = free_name(own.names, "id")
    out = T.StructType([T.StructField(key, media.schema[id_col].dataType), *own.fields])
    arrow = [to_arrow_type(f.dataType) for f in own.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_sizes(whole.columns[-1]), SLICE_BYTES):
                rows, of = [], []
                for i in range(batch.num_rows):
                    found = make(*(c[i].as_py() for c in batch.columns[1:]))
                    rows += found
                    of += [i] * len(found)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], out.names)

    return map_arrow(media.select(F.col(id_col).alias(key), *media_cols), run, out).withColumnRenamed(key, id_col)


def explode_pages(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row per page of each file: id, sizes, codes, and the samples row by row, little-endian.

    Null bytes give no row. A file that can't be decoded gives the pages before the fault and one row whose
    `error` says why; the job goes on. Ids may be of any type, and null or repeated; further columns aren't read.
    """

    def make(data: bytes | None) -> list[tuple]:
        rows: list[tuple] = []
        try:
            for p in read_pages(data) if data is not None else ():
                rows.append((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), None))
        except FAULTS as e:
            rows.append((len(rows), *[None] * 7, f"{type(e).__name__}: {e}"))
        return rows

    return _rows(media, id_col, [media_col], PAGE_SCHEMA, make)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored texts back from their TIFF bytes: one row of digests and features per file.

    A file that can't be decoded has null digests, and `error=` with the reason as its feature; null bytes have null media digests, too.
    """

    def make(n: int | None, data: bytes | None) -> list[tuple]:
        try:
            if data is None:
                raise TiffError("no bytes")
            payload, pages = load_payload(data)
            own = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:])), features(payload, pages)
        except FAULTS as e:
            own = (None, None, None), f"error={e}"
        return [(n, *own[0], None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), own[1])]

    return _rows(media, id_col, ["n_bytes", "media"], DIGEST, make)
