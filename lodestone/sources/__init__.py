"""Packed assets as DataFrames: scans of folders, decoded rows, normal tables, and file sinks.

Scans go through Spark's binaryFile, so files are listed, filtered and split over tasks by Spark. One file decodes in one
task; a malformed one becomes a row with _error_code and _error, never a failed job. A batch holds many small files, or one that is large.
Files of no bytes at all never show up: binaryFile passes over them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import extension, le_uint, stem
from . import audio, images, tbin, xact, xnb
from .cursor import AssetError

#: Faults of a file: those that parsers name, and what else damaged bytes can raise in them.
FAULTS = (AssetError, pa.ArrowInvalid, pa.ArrowTypeError, OverflowError, RecursionError, IndexError, KeyError, TypeError, ValueError, MemoryError, struct.error)

#: Columns of a scan, and of every decoded row before its own.
FILE = "path string, _error_code string, _error string"

#: What a batch of rows made in Python holds at most: rows, and their bytes, which only a single larger row exceeds.
BATCH_ROWS, BATCH_BYTES = 1_000, 256 << 10


def in_batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema, failed: Callable[[dict, Exception], dict] | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each given with its bytes: a batch of its own for each small row costs far more than the row.

    With `failed`, a row that the schema can't hold is replaced by what that makes of it; the others stay.
    """

    def made(part: list[dict]) -> Iterator[pa.RecordBatch]:
        try:
            batch = pa.RecordBatch.from_pylist(part, schema=schema)
        except FAULTS as e:
            if failed is None:
                raise
            if len(part) == 1:
                yield pa.RecordBatch.from_pylist([failed(part[0], e)], schema=schema)
            else:
                yield from made(part[: len(part) // 2])
                yield from made(part[len(part) // 2 :])
        else:
            yield batch

    held, size = [], 0
    for row, n in rows:
        if held and (len(held) == BATCH_ROWS or size + n > BATCH_BYTES):
            yield from made(held)
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield from made(held)


def _bytes_in(row: dict) -> int:
    """Bytes and characters of a row and of the structs in it; what lists hold is left out, as the file itself counts for that."""
    n = 0
    for v in row.values():
        if isinstance(v, (bytes, str)):
            n += len(v)
        elif isinstance(v, dict):
            n += _bytes_in(v)
    return n


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a path (or one file) with their extension and stem; contents are read only if a plan uses them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return found.withColumns({"ext": extension(F.col("path")), "stem": stem(F.col("path"))})


def container_headers(found: DataFrame) -> DataFrame:
    """Header fields and a state for each container, in Catalyst alone: no Python reads a byte."""
    flags = le_uint("content", 5, 1)
    target = F.substring("content", 4, 1).cast("string")
    cols = {
        "target": target,
        "format_version": le_uint("content", 4, 1).cast("int"),
        "compressed_flag": flags.bitwiseAND(F.lit(0xC0)).cast("int"),
        "hidef": flags.bitwiseAND(F.lit(1)) == 1,
        "file_size": le_uint("content", 6, 4),
        "raw_size": F.when(flags.bitwiseAND(F.lit(0xC0)) != 0, le_uint("content", 10, 4)),
    }
    state = (
        F.when(F.length("content") < 10, "truncated")
        .when(F.hex(F.substring("content", 1, 3)) != "584E42", "bad_magic")
        .when(~target.isin(*xnb.TARGETS), "bad_target")
        .when(le_uint("content", 6, 4) != F.length("content"), "size_mismatch")
        .when(~le_uint("content", 4, 1).between(3, 5), "odd_version")  # a warning: such files are decoded
        .otherwise("ok")
    )
    return found.select("path", *[c.alias(n) for n, c in cols.items()], state.alias("state"))


def decode(found: DataFrame, parse: Callable[[bytes], dict], schema: str) -> DataFrame:
    """One row per file: what `parse` makes of its content, or why it could not."""
    out = T.StructType.fromDDL(f"{FILE}, {schema}")

    def failed(row: dict, e: Exception) -> dict:
        return {"path": row["path"], "_error_code": getattr(e, "code", "bad_value"), "_error": str(e)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                row, data = {"path": path.as_py()}, None
                try:
                    data = content.as_py()
                    if data is None:
                        raise AssetError("missing", "no content")
                    row |= parse(data)
                except FAULTS as e:
                    row = failed(row, e)
                yield row, len(data or b"") + _bytes_in(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), to_arrow_schema(out), failed)

    return found.select("path", "content").mapInArrow(run, out)


def read_xnb(found: DataFrame, classes: dict[str, dict] | None = None) -> DataFrame:
    return decode(found, lambda data: xnb.parse(data, classes), xnb.SCHEMA)


def read_tbin(found: DataFrame) -> DataFrame:
    return decode(found, tbin.parse, tbin.SCHEMA)


def read_xgs(found: DataFrame) -> DataFrame:
    return decode(found, xact.parse_engine, xact.ENGINE_SCHEMA)


def read_xsb(found: DataFrame) -> DataFrame:
    return decode(found, xact.parse_sound_bank, xact.SOUND_BANK_SCHEMA)


def read_xwb(found: DataFrame) -> DataFrame:
    return decode(found, xact.parse_wave_bank, xact.WAVE_BANK_SCHEMA)


def read_wav(found: DataFrame) -> DataFrame:
    return decode(found, audio.parse_wave, "format_tag int, channels int, rate bigint, byte_rate bigint, block_align int, bits int, extra binary, fact_samples bigint, data binary")


def read_png(found: DataFrame) -> DataFrame:
    def parse(data: bytes) -> dict:
        width, height, raster = images.png_decode(data)
        return {"width": width, "height": height, "data": raster}

    return decode(found, parse, "width int, height int, data binary")


def exploded(df: DataFrame, array: str, ordinal: str, keys: list[str]) -> DataFrame:
    """The items of an array column as rows, with their place and the keys of their owner."""
    return df.select(*keys, F.posexplode(array).alias(ordinal, "_item")).select(*keys, ordinal, "_item.*")


def map_tables(maps: DataFrame) -> dict[str, DataFrame]:
    """Normal tables of decoded maps: sheets, layers, tiles, frames and the properties of all of them."""
    keys = ["path"]
    sheets = exploded(maps, "sheets", "sheet_ord", keys)
    layers = exploded(maps, "layers", "layer_ord", keys)
    tiles = layers.select("path", "layer_ord", F.explode("tiles").alias("_tile")).select("path", "layer_ord", "_tile.*")
    frames = exploded(tiles, "frames", "frame_ord", ["path", "layer_ord", "pos"])

    def owned(df: DataFrame, kind: str, *cols: str) -> DataFrame:
        place = [F.col(c).cast("int").alias(c) if c in cols else F.lit(None).cast("int").alias(c) for c in ("sheet_ord", "layer_ord", "pos", "frame_ord")]
        return df.select("path", F.lit(kind).alias("owner_kind"), *place, F.posexplode("properties").alias("prop_ord", "_p")).select("path", "owner_kind", "sheet_ord", "layer_ord", "pos", "frame_ord", "prop_ord", "_p.*")

    properties = owned(maps, "map").unionByName(owned(sheets, "sheet", "sheet_ord")).unionByName(owned(layers, "layer", "layer_ord"))
    properties = properties.unionByName(owned(tiles, "tile", "layer_ord", "pos")).unionByName(owned(frames, "frame", "layer_ord", "pos", "frame_ord"))
    return {"sheets": sheets.drop("properties"), "layers": layers.drop("tiles", "properties"), "tiles": tiles.drop("frames", "properties"), "frames": frames.drop("properties"), "properties": properties}


def wave_entries(banks: DataFrame) -> DataFrame:
    """Entries of decoded wave banks; bank columns take the prefix bank_."""
    return banks.select("path", F.col("name").alias("bank_name"), F.col("version").alias("bank_version"), F.explode("entries").alias("_e")).select("path", "bank_name", "bank_version", "_e.*")


def cue_waves(sound_banks: DataFrame) -> DataFrame:
    """A row for every wave that a sound of a cue may play, with the name of the wave bank it points into."""
    cues = sound_banks.select("path", "wave_banks", F.explode("cues").alias("c"))
    sounds = cues.select("path", "wave_banks", F.col("c.cue_ord").alias("cue_ord"), F.col("c.name").alias("cue_name"), F.posexplode("c.sounds").alias("sound_ord", "s"))
    waves = sounds.select("path", "wave_banks", "cue_ord", "cue_name", "sound_ord", F.col("s.category_id").alias("category_id"), F.explode("s.waves").alias("w"))
    return waves.select("path", "cue_ord", "cue_name", "sound_ord", "category_id", F.get("wave_banks", F.col("w.bank_index")).alias("bank_name"), "w.*")


@F.pandas_udf(T.BinaryType())
def _wave(data, codec, channels, rate, align, bits):
    import pandas as pd

    def one(d, *args):
        try:
            return audio.wave_file(d, *map(int, args))
        except AssetError:
            return None  # a codec without a wave file

    return pd.Series([one(*row) for row in zip(data, codec, channels, rate, align, bits)], dtype=object)


def sound_pairs(rows: DataFrame) -> DataFrame:
    """(path, json, wave) of decoded sound effects: loop and length as JSON, format and samples as a wave file."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                root = json.loads(content.as_py())
                wave = audio.riff(bytes.fromhex(root.pop("fmt")), bytes.fromhex(root.pop("data")))
                row = {"path": path.as_py(), "json": json.dumps(root), "wave": wave}
                yield row, _bytes_in(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(made(batches), pa.schema({"path": pa.string(), "json": pa.string(), "wave": pa.binary()}))

    return rows.where("_error_code IS NULL AND extension = 'wav'").select("path", "content").mapInArrow(run, "path string, json string, wave binary")


def wave_files(entries: DataFrame) -> DataFrame:
    """(bank_name, entry_idx, content) of wave files; content is null for codecs that have none."""
    return entries.select("bank_name", "entry_idx", _wave("data", "codec", "channels", "rate", "align", "bits").alias("content"))


def write_files(df: DataFrame, root: str) -> None:
    """Writes (rel_path, content) rows as files below `root`, a folder that all executors share.

    A file is written whole beside its place and then moved there, so a retried task leaves the same files; rows
    without content write nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            for rel, content in zip(batch["rel_path"], batch["content"]):
                name = rel.as_py().lstrip("/")
                if ".." in name.split("/"):
                    raise ValueError(f"{name} leaves its folder")
                target = f"{base}/{name}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(draft) as out:
                    out.write(content.as_py())
                store.move(draft, target)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch["content"])], pa.int64())})

    found = df.where(F.col("content").isNotNull()).select("rel_path", F.col("content").cast("binary").alias("content"))
    found.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
