"""Queries that build assets of the driver tables' rows and decode them again: the decoders at work, each beside SQL for what must come out."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources as src
from ..sources import audio, images, tbin, xnb
from ..sources.compression import lz4_decode, lz4_encode
from .kernels import table
from .map_queries import IDS, SQL_TILES, tiles_of
from .registry import query

NS = "Microsoft.Xna.Framework.Content."


def keys(spark, sf_dir: str, name: str, *cols) -> DataFrame:
    """Columns of a table's rows to make files of, dealt out evenly: the table's own parts may be fewer than the cores."""
    return table(spark, sf_dir, name).select(*cols).repartition(2 * spark.sparkContext.defaultParallelism)


def packed(rows: DataFrame, make) -> DataFrame:
    """(path, content) of files that `make` builds of each row's columns, the first of which names the file."""

    def files(batches):
        for batch in batches:
            for values in zip(*batch.columns):
                row = [v.as_py() for v in values]
                content = make(*row)
                yield {"path": str(row[0]), "content": content}, len(content)

    def run(batches):
        return src.in_batches(files(batches), pa.schema({"path": pa.string(), "content": pa.binary()}))

    return rows.mapInArrow(run, "path string, content binary")


def container(readers: list[str], compress: bool = False, **root) -> bytes:
    row = {"target": "w", "format_version": 5, "compressed_flag": 0, "hidef": False, "readers": [{"type": NS + r, "version": 0} for r in readers], "texture": None, "data": None, "content": None}
    return xnb.build(row | root, None, compress)


def _dictionary(key, pairs) -> bytes:
    kinds = ["DictionaryReader`2[[System.Int32, mscorlib],[System.String, mscorlib]]", "Int32Reader", "StringReader"]
    return container(kinds, compress=True, content=json.dumps({str(p["k"]): p["v"] for p in pairs}))


@query("container_round_trip", "SELECT CAST(l_suppkey % 50 AS VARCHAR) AS path, CAST(l_partkey AS INT) AS key, min(l_returnflag || l_linestatus) AS value FROM lineitem GROUP BY 1, 2")
def container_round_trip(spark, sf_dir):
    """Dictionaries written as compressed containers and decoded: header, LZ4, manifest, tagged values, JSON to a map."""
    pairs = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("path"), F.col("l_partkey").alias("k")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("v"))
    rows = pairs.groupBy("path").agg(F.collect_list(F.struct("k", "v")).alias("pairs"))
    decoded = src.read_xnb(packed(rows, _dictionary))
    return decoded.select("path", F.explode(F.from_json("content", "map<string,string>")).alias("key", "value")).select("path", F.col("key").cast("int").alias("key"), "value")


def _map(path, cells) -> bytes:
    pair = {"x": 16, "y": 16}
    layers = [
        {"id": IDS[o - 1], "visible": True, "description": "", "layer_size": {"x": 20, "y": 10}, "tile_size": pair, "properties": [],
         "tiles": [{"pos": c["pos"], "kind": "static", "tile_sheet": c["tile_sheet"], "tile_index": c["tile_index"], "blend_mode": 0, "frame_interval": None, "frames": [], "properties": []} for c in sorted(cells, key=lambda c: c["pos"]) if c["layer_ord"] == o]}
        for o in range(1, 8)
    ]
    sheets = [{"id": s, "description": "", "image": f"town_{s}.png", "sheet_size": pair, "tile_size": pair, "margin": pair, "spacing": pair, "properties": []} for s in "ANR"]
    return tbin.build({"id": str(path), "description": "made", "properties": [], "sheets": sheets, "layers": layers})


def _maps(spark, sf_dir) -> DataFrame:
    return packed(tiles_of(spark, sf_dir).groupBy("path").agg(F.collect_list(F.struct("layer_ord", "pos", "tile_sheet", "tile_index")).alias("cells")), _map)


@query("map_tables", f"WITH t AS ({SQL_TILES}) SELECT CAST(path AS VARCHAR) AS path, layer_ord - 1 AS layer_ord, pos, tile_sheet, tile_index FROM t")
def map_tables(spark, sf_dir):
    """Tile maps written and decoded into their normal tables."""
    return src.map_tables(src.read_tbin(_maps(spark, sf_dir)))["tiles"].select("path", "layer_ord", "pos", "tile_sheet", "tile_index")


@query("map_bytes_stripped", "SELECT CAST(p AS VARCHAR) AS path, CAST(o AS INT) AS sheet_ord, 'town_' || ['A', 'N', 'R'][o + 1] AS image, true AS same_tail FROM (SELECT DISTINCT l_suppkey % 10 AS p FROM lineitem) a, range(3) b(o)")
def map_bytes_stripped(spark, sf_dir):
    """Extensions taken out of the sheets of packed maps; layers are copied as bytes, never parsed."""
    maps = _maps(spark, sf_dir)

    def made(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                old = content.as_py()
                new = tbin.strip_images(old)
                yield {"path": path.as_py(), "content": new, "same_tail": new[-64:] == old[-64:]}, len(new)

    def run(batches):
        return src.in_batches(made(batches), pa.schema({"path": pa.string(), "content": pa.binary(), "same_tail": pa.bool_()}))

    stripped = maps.mapInArrow(run, "path string, content binary, same_tail boolean")
    sheets = src.map_tables(src.read_tbin(stripped))["sheets"].select("path", "sheet_ord", "image")
    return sheets.join(stripped.select("path", "same_tail"), "path")


def _texture(key, color) -> bytes:
    block = color.to_bytes(2, "little") * 2 + b"\0" * 4
    return container(["Texture2DReader"], texture={"format": images.DXT1, "width": 4, "height": 4, "data": block})


@query("texture_decode", """SELECT CAST(p_partkey AS VARCHAR) AS path, ((c >> 11) & 31) * 8 + (((c >> 11) & 31) >> 2) AS red, ((c >> 5) & 63) * 4 + (((c >> 5) & 63) >> 4) AS green, (c & 31) * 8 + ((c & 31) >> 2) AS blue, CAST(4080 AS BIGINT) AS alphas
FROM (SELECT p_partkey, p_partkey * 2654435761 % 65536 AS c FROM part) p""")
def texture_decode(spark, sf_dir):
    """Block-coded textures in containers, decoded to pixels."""
    rows = keys(spark, sf_dir, "part", "p_partkey", F.expr("p_partkey * 2654435761 % 65536").alias("color"))
    textures = src.read_xnb(packed(rows, _texture)).select("path", "texture.*")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, src.BATCH_ROWS):
                part = batch.slice(at, src.BATCH_ROWS)
                given = list(zip(*(part.column(c).to_pylist() for c in ("data", "width", "height", "format"))))
                rasters = images.dxt_decode_all(given)
                columns = [[r[i] for r in rasters] for i in range(3)] + [[sum(r[3::4]) for r in rasters]]
                yield pa.RecordBatch.from_arrays([part.column("path"), *(pa.array(c, pa.int64()) for c in columns)], ["path", "red", "green", "blue", "alphas"])

    return textures.mapInArrow(run, "path string, red long, green long, blue long, alphas long")


@query("png_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS path, 1 + p_partkey % 9 AS width, 1 + p_partkey % 5 AS height, (1 + p_partkey % 9) * (1 + p_partkey % 5) * (p_partkey % 256 + 255 + 7) AS total FROM part")
def png_round_trip(spark, sf_dir):
    """Rasters written as PNG files and read back."""

    def make(key) -> bytes:
        w, h = 1 + key % 9, 1 + key % 5
        return images.png_encode(bytes((key % 256, 7, 0, 255)) * (w * h), w, h)

    found = src.read_png(packed(keys(spark, sf_dir, "part", "p_partkey"), make))
    total = F.aggregate(F.sequence(F.lit(1), F.length("data")), F.lit(0).cast("long"), lambda s, i: s + F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("long"))
    return found.select("path", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), total.alias("total"))


@query("wave_round_trip", "SELECT CAST(event_id AS VARCHAR) AS path, 1 + event_id % 2 AS channels, 8000 + event_id % 5 * 8000 AS rate, (8000 + event_id % 5 * 8000) * 2 * (1 + event_id % 2) AS byte_rate, CAST(16 AS BIGINT) AS bits, 4 * (event_id % 30) AS n_bytes FROM events")
def wave_round_trip(spark, sf_dir):
    """Waves of bank entries written as RIFF files and read back."""

    def make(key) -> bytes:
        return audio.wave_file(bytes(4 * (key % 30)), audio.PCM, 1 + key % 2, 8000 + key % 5 * 8000, 0, 1)

    found = src.read_wav(packed(keys(spark, sf_dir, "events", "event_id"), make))
    return found.select("path", F.col("channels").cast("long").alias("channels"), "rate", "byte_rate", F.col("bits").cast("long").alias("bits"), F.length("data").cast("long").alias("n_bytes"))


@query("lz4_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS path, strlen(text) AS n_bytes, sha256(text) AS digest FROM documents")
def lz4_round_trip(spark, sf_dir):
    """Whole texts as LZ4 blocks and back."""

    def make(key, text) -> bytes:
        data = (text or "").encode()
        return len(data).to_bytes(4, "little") + lz4_encode(data)

    found = src.decode(packed(table(spark, sf_dir, "documents").select("doc_id", "text"), make), lambda data: {"data": lz4_decode(data[4:], int.from_bytes(data[:4], "little"))}, "data binary")
    return found.select("path", F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


def _sound(key, n) -> bytes:
    fmt = audio.format_bytes({"format_tag": 1, "channels": 1 + key % 2, "rate": 22050, "byte_rate": 44100, "block_align": 2, "bits": 16, "extra": b""})
    root = {"fmt": fmt.hex(), "data": bytes(2 * n).hex(), "loop_start": key % 7, "loop_length": n, "duration_ms": n * 10}
    return container(["SoundEffectReader"], content=json.dumps(root))


@query("sound_effects", "SELECT CAST(s_suppkey AS VARCHAR) AS path, CAST(s_suppkey % 7 AS INT) AS loop_start, CAST(s_suppkey % 40 AS INT) AS loop_length, CAST(1 + s_suppkey % 2 AS INT) AS channels, CAST(22050 AS BIGINT) AS rate, 2 * (s_suppkey % 40) AS n_bytes FROM supplier")
def sound_effects(spark, sf_dir):
    """Sound effects in containers as pairs of JSON and wave file."""
    rows = keys(spark, sf_dir, "supplier", "s_suppkey", F.expr("s_suppkey % 40").alias("n"))
    pairs = src.sound_pairs(src.read_xnb(packed(rows, _sound)))
    waves = src.read_wav(pairs.select("path", F.col("wave").alias("content"))).select("path", "channels", "rate", F.length("data").cast("long").alias("n_bytes"))
    json_side = pairs.select("path", F.from_json("json", "loop_start int, loop_length int, duration_ms int").alias("j")).select("path", "j.loop_start", "j.loop_length")
    return json_side.join(waves, "path")


@query("container_states", "SELECT CASE s_suppkey % 5 WHEN 0 THEN 'bad_magic' WHEN 1 THEN 'size_mismatch' WHEN 2 THEN 'truncated' WHEN 3 THEN 'odd_version' ELSE 'ok' END AS state, count(*) AS n FROM supplier GROUP BY 1")
def container_states(spark, sf_dir):
    """Headers of sound and broken containers, checked without a byte read in Python."""

    def make(key) -> bytes:
        good = container(["EffectReader"], data=b"abc")
        return [b"ABC" + good[3:], good + b"x", good[:8], good[:4] + b"\x09" + good[5:], good][key % 5]

    return src.container_headers(packed(keys(spark, sf_dir, "supplier", "s_suppkey"), make)).groupBy("state").agg(F.count("*").alias("n"))


@query("fixed_integers", "SELECT o_orderkey, o_orderkey * 97 AS unsigned, CAST(-(o_orderkey % 30000) AS BIGINT) AS signed, o_orderkey * 97 AS varint FROM orders WHERE o_orderkey * 97 < 4294967296")
def fixed_integers(spark, sf_dir):
    """Integers written low byte first and in groups of seven bits, and taken from the bytes by Catalyst alone."""
    from ..sources.cursor import Writer

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data = [bytes(Writer().write("Ih", k * 97, -(k % 30000)).varint(k * 97).data) for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["o_orderkey", "b"])

    rows = table(spark, sf_dir, "orders").where("o_orderkey * 97 < 4294967296").select("o_orderkey").mapInArrow(run, "o_orderkey long, b binary")
    varint = fn.varint_at(F.col("b"), F.lit(6))["value"].cast("long")
    return rows.select("o_orderkey", fn.le_uint("b", 0, 4).cast("long").alias("unsigned"), fn.le_int("b", 4, 2).cast("long").alias("signed"), varint.alias("varint"))
