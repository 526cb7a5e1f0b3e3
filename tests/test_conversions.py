"""Faults that become rows, names by the rule of several sounds, sound effects as pairs, and errors that are meant."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from test_sources import DATA, NS, TEXTURE, container, put, s7

from lodestone import sources as src
from lodestone.operators import relational as rel
from lodestone.plans import convert
from lodestone.sources import audio, tbin, xnb
from lodestone.sources.compression import lz4_decode, lz4_encode
from lodestone.sources.cursor import AssetError


def test_damaged_files_are_rows(spark, tmp_path):
    """A generic reader without types, a texture shorter than its size, and sound files beside them."""
    short = container([NS + "Texture2DReader"], b"\x01" + struct.pack("<iiiiI", 0, 9, 9, 1, 8) + b"12345678")
    files = {"good": DATA, "bare": container([NS + "ListReader`1"], b"\x01" + struct.pack("<I", 0)), "short": short, "pixels": container([NS + "Texture2DReader"], TEXTURE)}
    for name, data in files.items():
        put(tmp_path, f"in/{name}.xnb", data)
    report = convert.unpack(spark, str(tmp_path / "in"), str(tmp_path / "mid"))
    assert {r.path.rsplit("/", 1)[1]: r._error_code for r in report.collect()} == {"good.xnb": None, "bare.xnb": "bad_type", "short.xnb": "truncated", "pixels.xnb": None}
    head = struct.pack(">I", 4) + b"IHDR" + b"1234"
    (tmp_path / "mid/pixels.png").write_bytes(b"\x89PNG\r\n\x1a\n" + head + struct.pack(">I", zlib.crc32(head[4:])))
    packed = convert.pack(spark, str(tmp_path / "mid"), str(tmp_path / "back"))
    assert {r.path: r._error_code for r in packed.collect()} == {"good.xnb": None, "pixels.xnb": "bad_png"}
    assert (tmp_path / "back/good.xnb").read_bytes() == DATA and not (tmp_path / "back/pixels.xnb").exists()


def test_sound_effect_pair(spark, tmp_path):
    fmt = struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16) + struct.pack("<H", 0)
    root = b"\x01" + struct.pack("<I", len(fmt)) + fmt + struct.pack("<I", 5) + b"abcde" + struct.pack("<iii", 1, 2, 3)
    data = container([NS + "SoundEffectReader"], root)
    put(tmp_path, "in/s.xnb", data)
    convert.unpack(spark, str(tmp_path / "in"), str(tmp_path / "mid"))
    assert json.loads((tmp_path / "mid/s.json").read_bytes()) == {"loop_start": 1, "loop_length": 2, "duration_ms": 3}
    wave = audio.parse_wave((tmp_path / "mid/s.wav").read_bytes())
    assert wave["data"] == b"abcde" and wave["rate"] == 8000 and wave["extra"] == b"\0\0"
    convert.pack(spark, str(tmp_path / "mid"), str(tmp_path / "back"))
    assert (tmp_path / "back/s.xnb").read_bytes() == data


CUES = "path string, cue_ord int, cue_name string, sound_ord int, category_id int, bank_name string, track_index int, clip_ord int, event_ord int"


def test_numbers_follow_sounds_and_banks_stay_apart(spark):
    """Two sounds on one wave number it; one sound with two waves doesn't; cues of two sound banks with one number are two; the last engine counts."""
    cues = spark.createDataFrame([
        ("a.xsb", 0, "twice", 0, 1, "w", 0, None, None), ("a.xsb", 0, "twice", 1, 1, "w", 0, None, None),
        ("a.xsb", 1, "pair", 0, 2, "w", 1, 0, 0), ("a.xsb", 1, "pair", 0, 2, "w", 2, 0, 1), ("b.xsb", 0, "other", 0, 1, "w", 3, None, None),
    ], CUES)
    entries = spark.createDataFrame([("w.xwb", "w", i) for i in range(5)], "path string, bank_name string, entry_idx int")
    categories = spark.createDataFrame([("1.xgs", 1, "Old"), ("2.xgs", 1, "Music"), ("2.xgs", 2, "Sound")], "path string, category_id int, name string")
    got = {r.entry_idx: (r.name, r.category) for r in convert.name_project(cues, entries, categories).collect()}
    assert got == {0: ("twice_0", "Music"), 1: ("pair", "Sound"), 2: ("pair", "Sound"), 3: ("other", "Music"), 4: ("00000004", None)}


def test_header_states(spark, tmp_path):
    put(tmp_path, "in/old.xnb", DATA[:4] + b"\x02" + DATA[5:])
    put(tmp_path, "in/new.xnb", DATA)
    states = {r.path.rsplit("/", 1)[1]: r.state for r in src.container_headers(src.files(spark, str(tmp_path / "in"))).collect()}
    assert states == {"old.xnb": "odd_version", "new.xnb": "ok"}


def test_fields_and_keys_that_clash(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6)], "g int, k string, v int")
    with pytest.raises(ValueError, match="no fields"):
        rel.matched_fields(df, {"g": "bigint"})
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        rel.keyed_map(df, ["g"], "k", "v", "m").collect()


def test_stripped_images_keep_layers():
    pair = {"x": 1, "y": 1}
    sheet = {"id": "s", "description": "", "image": "a.png.png", "sheet_size": pair, "tile_size": pair, "margin": pair, "spacing": pair, "properties": []}
    value = {"id": "m", "description": "d", "properties": [], "sheets": [sheet], "layers": []}
    assert tbin.parse(tbin.strip_images(tbin.build(value))) == value | {"sheets": [sheet | {"image": "a"}]}
    with pytest.raises(AssetError):
        tbin.strip_images(b"tBIN10")


def test_far_matches():
    data = bytes(range(256)) * 300 + b"tail"
    assert lz4_decode(lz4_encode(data), len(data)) == data


def test_types_that_lack_arguments():
    with pytest.raises(AssetError, match="lacks"):
        xnb.type_of(NS + "DictionaryReader`2[[System.Int32]]")
    assert xnb.parse(container([NS + "StringReader"], b"\x01" + s7("x")))["content"] == '"x"'


def test_empty_and_short_lists(spark):
    from lodestone import functions as fn

    df = spark.createDataFrame([([1, 2],), ([],), ([1, 2, 3, 4, 5],)], "a array<int>")
    got = df.select(fn.tuples(F.col("a"), 4), fn.tuples(F.col("a"), 2), fn.lcm(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [([], [[1, 2]], 2), ([], [], 1), ([[1, 2, 3, 4]], [[1, 2], [3, 4]], 60)]
