"""Decoders and encoders on bytes assembled by hand, and the DataFrames over them."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import sources as src
from lodestone import streaming
from lodestone.plans import convert
from lodestone.sources import audio, images, tbin, xact, xnb
from lodestone.sources.compression import lz4_decode, lz4_encode, lzx_decode
from lodestone.sources.cursor import AssetError, Reader, Writer

NS = "Microsoft.Xna.Framework.Content."


def s32(text):
    return struct.pack("<i", len(text.encode())) + text.encode()


def s7(text):
    assert len(text) < 128 * 128
    n = len(text.encode())
    return (bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])) + text.encode()


def container(manifest, root, target=b"w", flags=0):
    body = bytes([len(manifest)]) + b"".join(s7(m) + struct.pack("<I", 0) for m in manifest) + b"\0" + root
    return b"XNB" + target + struct.pack("<BBI", 5, flags, 10 + len(body)) + body


TEXTURE = b"\x01" + struct.pack("<iiiiI", 0, 2, 1, 1, 8) + bytes([10, 20, 30, 255, 0, 0, 0, 0])
DATA = container([NS + "DictionaryReader`2[[System.Int32, mscorlib],[System.String, mscorlib]]", NS + "Int32Reader", NS + "StringReader"],
                 b"\x01" + struct.pack("<Ii", 2, 7) + b"\x03" + s7("seven") + struct.pack("<i", -1) + b"\x00")


def test_varint():
    for n in (0, 127, 128, 300, 2**32 - 1):
        assert Reader(bytes(Writer().varint(n).data)).varint() == n
    for bad in (-1, 2**32):
        with pytest.raises(AssetError):
            Writer().varint(bad)
    with pytest.raises(AssetError, match="five"):
        Reader(b"\xff" * 6).varint()


def test_container_with_nulls_and_numbers():
    row = xnb.parse(DATA)
    assert json.loads(row["content"]) == {"7": "seven", "-1": None}
    assert row["extension"] == "json" and row["format_version"] == 5
    assert xnb.build(row) == DATA


def test_container_texture_and_effect_and_xml_and_map():
    row = xnb.parse(container([NS + "Texture2DReader"], TEXTURE))
    assert row["texture"]["width"] == 2 and xnb.build(row) == container([NS + "Texture2DReader"], TEXTURE)
    effect = container([NS + "EffectReader"], b"\x01" + struct.pack("<I", 3) + b"abc")
    assert xnb.parse(effect)["data"] == b"abc" and xnb.build(xnb.parse(effect)) == effect
    tide = container(["xTile.Pipeline.TideReader, xTile"], b"\x01" + struct.pack("<i", 2) + b"hi")
    assert xnb.parse(tide)["extension"] == "tbin" and xnb.build(xnb.parse(tide)) == tide
    text = container(["BmFont.XmlSourceReader, BmFont"], b"\x01" + s7("<a/>"))
    assert xnb.parse(text)["content"] == "<a/>" and xnb.build(xnb.parse(text)) == text


def test_container_font():
    types = ["SpriteFontReader", "Texture2DReader", "ListReader`1[[Microsoft.Xna.Framework.Rectangle, X]]", "RectangleReader",
             "ListReader`1[[System.Char, mscorlib]]", "CharReader", "ListReader`1[[Microsoft.Xna.Framework.Vector3, X]]", "Vector3Reader"]
    box = b"\x03" + struct.pack("<Iiiii", 1, 0, 0, 1, 1)
    root = b"\x01" + b"\x02" + TEXTURE[1:] + box + box + b"\x05" + struct.pack("<I", 2) + "é漢".encode()
    root += struct.pack("<if", 12, 0.5) + b"\x07" + struct.pack("<Ifff", 1, 1, 2, 3) + b"\x01?"
    data = container([NS + t for t in types], root)
    row = xnb.parse(data)
    found = json.loads(row["content"])
    assert found["character_map"] == ["é", "漢"] and found["default_character"] == "?" and found["line_spacing"] == 12
    assert row["texture"]["height"] == 1 and xnb.build(row) == data


def test_container_class_with_base():
    classes = {"G.Item": {"base": "G.Thing", "fields": [("price", "System.Int32"), ("tags", "System.Collections.Generic.List`1[[System.String, m]]")]},
               "G.Thing": {"fields": [("name", "System.String"), ("seen", "System.Nullable`1[[System.Int32, m]]")]}}
    types = [NS + "ReflectiveReader`1[[G.Item, G]]", NS + "StringReader", NS + "ListReader`1[[System.String, m]]"]
    root = b"\x01" + b"\x02" + s7("axe") + b"\x00" + struct.pack("<i", 5) + b"\x03" + struct.pack("<I", 1) + b"\x02" + s7("t")
    row = xnb.parse(container(types, root), classes)
    assert json.loads(row["content"]) == {"name": "axe", "seen": None, "price": 5, "tags": ["t"]}
    assert xnb.build(row, classes) == container(types, root)
    with pytest.raises(AssetError, match="no reader"):
        xnb.parse(container(types, root))


@pytest.mark.parametrize("data, code", [
    (b"XNA" + DATA[3:], "bad_magic"), (DATA[:-1], "size_mismatch"), (b"XNBq" + DATA[4:], "bad_target"), (b"XN", "truncated"), (b"", "truncated"),
    (container([NS + "StringReader"], b"\x09"), "bad_tag"),
    (container([], b""), "bad_count"),
])
def test_malformed_containers(data, code):
    with pytest.raises(AssetError) as e:
        xnb.parse(data)
    assert e.value.code == code


@pytest.mark.parametrize("data", [b"", b"a", b"abc" * 5000, bytes(range(256)) * 3, np.random.default_rng(1).bytes(5000), b"x" * 70000 + b"tail"])
def test_lz4_round_trip(data):
    assert lz4_decode(lz4_encode(data), len(data)) == data


def test_lz4_by_hand():
    # "ab" then a match of 6 at distance 2, then five literals
    assert lz4_decode(bytes([0x22]) + b"ab" + b"\x02\x00" + bytes([0x50]) + b"12345", 13) == b"abababab12345"
    for bad in (bytes([0x22]) + b"ab" + b"\x05\x00", bytes([0x40]) + b"a", bytes([0x22]) + b"ab" + b"\x02"):
        with pytest.raises(AssetError):
            lz4_decode(bad, 13)


class BitsOut:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def done(self):
        self.bits += [0] * (-len(self.bits) % 16)
        words = [int("".join(map(str, self.bits[i : i + 16])), 2) for i in range(0, len(self.bits), 16)]
        return struct.pack(f"<{len(words)}H", *words)


def raw_frame(payload, first):
    out = BitsOut()
    if first:
        out.put(0, 1)
    out.put(3, 3)
    out.put(len(payload), 24)
    return out.done() + struct.pack("<III", 1, 1, 1) + payload


def test_lzx_uncompressed_frames():
    a, b = bytes(range(256)) * 128, b"second" * 10
    fa, fb = raw_frame(a, True), raw_frame(b, False)
    framed = struct.pack(">H", len(fa)) + fa + b"\xff" + struct.pack(">HH", len(b), len(fb)) + fb
    assert lzx_decode(framed, len(a) + len(b)) == a + b
    with pytest.raises(AssetError):
        lzx_decode(framed[:-3], len(a) + len(b))


def test_lzx_verbatim_block():
    # Literals "a" and "b" and one match symbol: lengths 2, 2, 1 in the main tree, nothing in the length tree.
    lengths = [0] * 512
    lengths[97], lengths[98] = 2, 2
    lengths[256 + 4 * 8 + 2] = 1  # slot 4: distance 2 or 3 by one extra bit; length 4
    out = BitsOut()
    out.put(0, 1)
    out.put(1, 3)
    out.put(10, 24)

    def table(values):
        """Lengths as differences from zero under a fixed tree: every symbol 0..19 has five bits or four."""
        pre = [4] * 12 + [5] * 8
        codes, code = {}, 0
        for n in (4, 5):
            code <<= 1
            for i, length in enumerate(pre):
                if length == n:
                    codes[i] = (code, n)
                    code += 1
        for n in pre:
            out.put(n, 4)
        for v in values:
            out.put(*codes[-v % 17])

    table(lengths[:256])
    table(lengths[256:])
    table([0] * 249)
    literal = {97: (2, 2), 98: (3, 2)}
    for symbol in (97, 98):
        out.put(*literal[symbol])
    for _ in range(2):
        out.put(0, 1)  # the match: slot 4, length 4
        out.put(0, 1)  # distance 4 - 2 + 0
    frame = out.done()
    assert lzx_decode(b"\xff" + struct.pack(">HH", 10, len(frame)) + frame, 10) == b"ab" * 5


def test_dxt_by_hand():
    red_blue = struct.pack("<HHI", 0xF800, 0x001F, 0b11100100)
    got = np.frombuffer(images.dxt_decode(red_blue, 4, 4, images.DXT1), np.uint8).reshape(4, 4, 4)
    assert got[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    clear = np.frombuffer(images.dxt_decode(struct.pack("<HHI", 0, 0xFFFF, 3), 1, 1, images.DXT1), np.uint8)
    assert clear.tolist() == [0, 0, 0, 0]
    got = images.dxt_decode(bytes([0x10] + [0] * 7) + red_blue, 2, 1, images.DXT3)
    assert (got[3], got[7]) == (0, 17)
    got = images.dxt_decode(bytes([200, 100, 0b10001000, 0, 0, 0, 0, 0]) + red_blue, 3, 1, images.DXT5)
    assert (got[3], got[7], got[11]) == (200, 100, 185)


@pytest.mark.parametrize("kind", [images.DXT1, images.DXT3, images.DXT5])
@pytest.mark.parametrize("w, h", [(1, 1), (2, 3), (5, 7), (16, 16)])
def test_dxt_encode_is_close(kind, w, h):
    y, x = np.mgrid[:h, :w]
    px = np.stack([x * 8, x * 8 + y, 128 + 0 * x, 255 + 0 * x], -1).astype(np.uint8)
    got = np.frombuffer(images.dxt_decode(images.dxt_encode(px.tobytes(), w, h, kind), w, h, kind), np.uint8).reshape(px.shape)
    assert np.abs(got.astype(int) - px).max() <= 12


def test_png_and_alpha():
    px = np.random.default_rng(3).bytes(5 * 3 * 4)
    assert images.png_decode(images.png_encode(px, 5, 3)) == (5, 3, px)
    assert images.premultiply(bytes([200, 100, 0, 128])) == bytes([100, 50, 0, 128])
    assert images.unpremultiply(bytes([100, 50, 0, 128, 9, 0, 0, 0])) == bytes([200, 100, 0, 128, 255, 0, 0, 0])
    assert images.region_opaque(b"\xff" * 64, 4, 0, 0, 4, 4) and not images.region_opaque(b"\xff" * 63 + b"\0", 4, 0, 0, 4, 4)


def a_map():
    no_props = struct.pack("<i", 0)
    props = struct.pack("<i", 4) + s32("b") + b"\0\1" + s32("i") + b"\1" + struct.pack("<i", -2) + s32("f") + b"\2" + struct.pack("<f", 0.5) + s32("s") + b"\3" + s32("")
    sheet = s32("sh") + s32("") + s32("img.png") + struct.pack("<8i", 4, 4, 16, 16, 0, 0, 0, 0) + props
    static = b"S" + struct.pack("<iB", 3, 0) + no_props
    animated = b"A" + struct.pack("<ii", 100, 2) + b"T" + s32("sh") + static + static + props
    layer = s32("Back") + b"\1" + s32("") + struct.pack("<4i", 3, 2, 64, 64) + no_props
    layer += b"N" + struct.pack("<i", 1) + b"T" + s32("sh") + static + animated + b"N" + struct.pack("<i", 3)
    return b"tBIN10" + s32("m") + s32("d") + props + struct.pack("<i", 1) + sheet + struct.pack("<i", 1) + layer


def test_map_round_trip():
    found = tbin.parse(a_map())
    tiles = found["layers"][0]["tiles"]
    assert [(t["pos"], t["kind"]) for t in tiles] == [(1, "static"), (2, "animated")]
    assert [f["tile_sheet"] for f in tiles[1]["frames"]] == ["sh", "sh"]
    assert tbin.build(found) == a_map()
    bad_run = a_map().replace(b"N" + struct.pack("<i", 3), b"N" + struct.pack("<i", 4))
    with pytest.raises(AssetError) as e:
        tbin.parse(bad_run)
    assert e.value.code == "bad_run"


def wave_bank(name="Wave Bank", order="<", version=43):
    head = 12 + 40
    entries = [(0, 1 << 2 | 22050 << 5, 0, 4), (0, 2 | 1 << 2 | 11025 << 5 | 48 << 23, 8, 70)]
    bank = struct.pack(order + "II", 0, 2) + name.encode().ljust(64, b"\0") + struct.pack(order + "IiI", 24, 64, 4)
    table_at = head + len(bank)
    table = b"".join(struct.pack(order + "IIIIII", *e, 0, 0) for e in entries)
    data_at = table_at + len(table)
    data = b"abcd" + b"gap!" + bytes(70)
    segments = struct.pack(order + "10I", head, len(bank), table_at, len(table), 0, 0, 0, 0, data_at, len(data))
    return (b"WBND" if order == "<" else b"DNBW") + struct.pack(order + "II", version, 44) + segments + bank + table + data


@pytest.mark.parametrize("order", ["<", ">"])
def test_wave_bank(order):
    found = xact.parse_wave_bank(wave_bank(order=order))
    first, second = found["entries"]
    assert (found["name"], first["data"], first["rate"], first["codec"]) == ("Wave Bank", b"abcd", 22050, audio.PCM)
    assert (second["codec"], second["align"], second["gap"]) == (audio.ADPCM, 48, 4)


def test_wave_bank_compact():
    bank = struct.pack("<II", xact.COMPACT, 2) + b"c".ljust(64, b"\0") + struct.pack("<IiII", 4, 0, 2, 1 << 2 | 8000 << 5)
    table = struct.pack("<II", 0, 3)
    at = 52 + len(bank)
    data = b"WBND" + struct.pack("<II", 43, 44) + struct.pack("<10I", 52, len(bank), at, 8, 0, 0, 0, 0, at + 8, 10) + bank + table + b"0123456789"
    assert [e["data"] for e in xact.parse_wave_bank(data)["entries"]] == [b"012345", b"6789"]


def test_wave_bank_version_one():
    data = b"WBND" + struct.pack("<III", 1, 0, 1) + b"old".ljust(64, b"\0") + struct.pack("<5I", 1 | 1 << 1 | 8000 << 5, 0, 3, 0, 0) + b"xyz"
    entry = xact.parse_wave_bank(data)["entries"][0]
    assert (entry["data"], entry["codec"], entry["channels"]) == (b"xyz", audio.ADPCM, 1)


def test_wave_file_round_trip():
    found = audio.parse_wave(audio.wave_file(b"abc", audio.PCM, 2, 44100, 0, 1))
    assert found["data"] == b"abc" and found["byte_rate"] == 176400 and found["block_align"] == 4
    found = audio.parse_wave(audio.wave_file(bytes(140), audio.ADPCM, 1, 22050, 48, 0))
    assert (found["format_tag"], found["block_align"], len(found["extra"]), found["fact_samples"]) == (2, 70, 34, 252)
    with pytest.raises(AssetError):
        audio.wave_file(b"", audio.WMA, 1, 1, 0, 0)


def sound_bank():
    """Two simple cues that share wave 0 of the bank, and one with two variations."""
    head = 4 + 6 + 8 + 1 + 4 + 2 + 7 + 2 + 40 + 64
    names = b"one\0two\0many\0"
    names_at, banks_at = head, head + len(names)
    sounds_at = banks_at + 64

    def sound(track):
        return struct.pack("<BHBhBHHB", 0, 1, 90, -500, 0, 12, track, 0)

    sounds = sound(0) + sound(0) + sound(1)
    each = len(sounds) // 3
    var_at = sounds_at + len(sounds)
    variations = struct.pack("<HHI", 2, 1 << 3, 0) + struct.pack("<IBBIBB", sounds_at, 0, 128, sounds_at + 2 * each, 128, 255)
    simple_at = var_at + len(variations)
    simple = struct.pack("<BI", 4, sounds_at) + struct.pack("<BI", 4, sounds_at + each)
    complex_at = simple_at + len(simple)
    cues = struct.pack("<BIIBHHB", 0, var_at, 0, 255, 0, 0, 0)
    out = b"SDBK" + struct.pack("<HHHIIBHH", 46, 43, 0, 0, 0, 1, 2, 1) + b"\0\0" + struct.pack("<HBHH", 3, 1, 3, len(names)) + b"\0\0"
    out += struct.pack("<10I", simple_at, complex_at, names_at, 0, var_at, 0, banks_at, 0, 0, sounds_at) + b"Sound Bank".ljust(64, b"\0")
    assert len(out) == head
    return out + names + b"Wave Bank".ljust(64, b"\0") + sounds + variations + simple + cues


def engine():
    names = b"Global\0Music\0"
    var_names = b"Pitch\0"
    head = 4 + 6 + 8 + 1 + 4 + 4 + 6 + 8 + 4 + 4 + 4 + 24
    cats_at = head
    cats = struct.pack("<BHHBHBB", 255, 1000, 500, 2 | 3 << 3, 0, 180, 2) * 2
    vars_at = cats_at + len(cats)
    variables = struct.pack("<Bfff", 3, 0.0, -1.0, 1.0)
    names_at = vars_at + len(variables)
    rpc_at = names_at + len(names) + len(var_names)
    rpc = struct.pack("<HBH", 0, 1, 2) + struct.pack("<ffB", 0.5, 1.5, 1)
    out = b"XGSF" + struct.pack("<HHHIIBHH", 46, 42, 0, 0, 0, 0, 2, 1) + bytes(4) + struct.pack("<HHHII", 1, 0, 0, cats_at, vars_at) + bytes(4)
    out += bytes(4) + bytes(4) + struct.pack("<6I", 0, names_at, names_at + len(names), rpc_at, 0, 0)
    assert len(out) == head
    return out + cats + variables + names + var_names + rpc


def test_sound_bank_and_engine():
    found = xact.parse_sound_bank(sound_bank())
    assert [c["name"] for c in found["cues"]] == ["one", "two", "many"] and found["wave_banks"] == ["Wave Bank"]
    assert [s["waves"][0]["track_index"] for s in found["cues"][2]["sounds"]] == [0, 1]
    found = xact.parse_engine(engine())
    assert [c["name"] for c in found["categories"]] == ["Global", "Music"] and found["categories"][0]["behavior"] == 3
    assert found["curves"][0]["variable"] == "Pitch" and found["variables"][0]["is_global"]


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_scan_headers_and_faults(spark, tmp_path):
    put(tmp_path, "a/good.xnb", DATA)
    put(tmp_path, "short.xnb", DATA[:-1])
    put(tmp_path, "stub.xnb", b"XNBw")
    put(tmp_path, "other.txt", b"no")
    found = src.files(spark, str(tmp_path), "*.xnb")
    heads = {r.path.rsplit("/", 1)[1]: r for r in src.container_headers(found).collect()}
    assert {k: v.state for k, v in heads.items()} == {"good.xnb": "ok", "short.xnb": "size_mismatch", "stub.xnb": "truncated"}
    assert heads["good.xnb"].file_size == len(DATA) and heads["good.xnb"].target == "w" and heads["good.xnb"].format_version == 5
    rows = src.read_xnb(found)
    assert rows.select(F.count_if(F.col("_error_code").isNull())).first()[0] == 1
    assert convert.report(rows).first().asDict() == {"success": 1, "fail": 2, "total": 3}


def test_map_tables(spark, tmp_path):
    put(tmp_path, "m.tbin", a_map())
    tables = src.map_tables(src.read_tbin(src.files(spark, str(tmp_path))))
    assert {k: t.count() for k, t in tables.items()} == {"sheets": 1, "layers": 1, "tiles": 2, "frames": 2, "properties": 12}
    kept = tables["properties"].where("owner_kind = 'tile'").orderBy("prop_ord").collect()
    assert [(r.key, r.value_bool, r.value_int, r.value_float, r.value_string) for r in kept] == [("b", True, None, None, None), ("i", None, -2, None, None), ("f", None, None, 0.5, None), ("s", None, None, None, "")]


def test_audio_project(spark, tmp_path):
    put(tmp_path, "in/a.xwb", wave_bank())
    put(tmp_path, "in/a.xsb", sound_bank())
    put(tmp_path, "in/a.xgs", engine())
    named = convert.unpack_project(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.entry_idx: (r.name, r.cue_name, r.category) for r in named.collect()}
    assert got == {0: ("one", "one", "Music"), 1: ("many_0", "many", "Music")}
    assert (tmp_path / "out/Wave Bank/one.wav").read_bytes() == audio.wave_file(b"abcd", audio.PCM, 1, 22050, 0, 0)


def test_unpack_and_pack(spark, tmp_path):
    files = {"d/data": DATA, "t": container([NS + "Texture2DReader"], TEXTURE), "e": container([NS + "EffectReader"], b"\x01" + struct.pack("<I", 3) + b"abc"), "map": container(["xTile.Pipeline.TideReader, xTile"], b"\x01" + struct.pack("<i", 2) + b"hi")}
    for name, data in files.items():
        put(tmp_path, f"in/{name}.xnb", data)
    put(tmp_path, "in/bad.xnb", b"XNB")
    report = convert.unpack(spark, str(tmp_path / "in"), str(tmp_path / "mid"))
    assert {r.path.rsplit("/", 1)[1]: r._error_code for r in report.collect()}["bad.xnb"] == "truncated"
    assert convert.report(report).first().success == 4
    convert.pack(spark, str(tmp_path / "mid"), str(tmp_path / "back"))
    assert {n: (tmp_path / f"back/{n}.xnb").read_bytes() for n in files} == files
    assert not list((tmp_path / "back").rglob("*.part"))


def test_packed_round_trip():
    row = xnb.parse(container([NS + "StringReader"], b"\x01" + s7("x" * 5000)))
    small = xnb.build(row, compress=True)
    assert len(small) < 200 and xnb.parse(small)["content"] == row["content"] and xnb.parse(small)["compressed_flag"] == xnb.LZ4


def test_watched_folder(spark, tmp_path):
    put(tmp_path, "in/a.xnb", DATA)
    for _ in range(2):
        streaming.convert(streaming.watch(spark, str(tmp_path / "in"), "*.xnb"), src.read_xnb, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        put(tmp_path, "in/b.xnb", DATA[:-1])
    rows = spark.read.parquet(str(tmp_path / "out")).select("_error_code").collect()
    assert sorted(str(r[0]) for r in rows) == ["None", "size_mismatch"]


class Plan:
    """Takes the place of a DataFrame, to see the batches that a step makes."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_small_files_share_a_batch_and_large_ones_do_not(spark):
    import pyarrow as pa

    n, large = 3_000, bytes(300 << 10)
    contents = [audio.wave_file(large if i in (7, 8) else b"", audio.PCM, 1, 8_000 + i, 0, 1) for i in range(n)]
    contents[5], contents[6] = b"RIFX", None
    found = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(n)], "content": pa.array(contents, pa.binary())})
    batches = list(src.read_wav(Plan()).run(iter([found])))
    assert len(batches) < 10 and max(b.num_rows for b in batches) <= src.BATCH_ROWS
    assert [b.num_rows for b in batches if b.nbytes > len(large)] == [1, 1]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [str(i) for i in range(n)]
    assert [(i, r["_error_code"]) for i, r in enumerate(rows) if r["_error_code"]] == [(5, "bad_magic"), (6, "missing")]
    assert all(r["rate"] == 8_000 + i for i, r in enumerate(rows) if i not in (5, 6))


def test_a_value_beyond_its_column_spoils_one_row_of_a_batch(spark):
    import pyarrow as pa

    found = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(100)], "content": pa.array([i.to_bytes(8, "little") for i in [2**40 if i in (3, 60) else i for i in range(100)]], pa.binary())})
    batches = list(src.decode(Plan(), lambda data: {"n": int.from_bytes(data, "little")}, "n int").run(iter([found])))
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [str(i) for i in range(100)] and len(batches) < 50
    assert all((r["n"], r["_error_code"]) == ((None, "bad_value") if i in (3, 60) else (i, None)) for i, r in enumerate(rows))


def test_built_files_share_a_batch():
    import pyarrow as pa

    from lodestone.plans import codec_queries

    keys = pa.RecordBatch.from_pydict({"key": pa.array(range(2_500), pa.int64())})
    batches = list(codec_queries.packed(Plan(), lambda key: bytes(key % 9)).run(iter([keys])))
    assert len(batches) == 3
    assert [r for b in batches for r in b.to_pylist()] == [{"path": str(i), "content": bytes(i % 9)} for i in range(2_500)]


def test_small_textures_are_decoded_together(monkeypatch):
    random = np.random.default_rng(3)
    sizes = [(4, 4, images.DXT1)] * 500 + [(5, 7, images.DXT5)] * 300 + [(8, 2, images.DXT3)] * 200 + [(260, 260, images.DXT1)] * 2 + [(4, 4, images.DXT1)]
    textures = [(random.bytes(-(-w // 4) * -(-h // 4) * (8 if k == images.DXT1 else 16) + i % 3), w, h, k) for i, (w, h, k) in enumerate(sizes)]
    single, calls = images.dxt_decode, []
    want = [single(*t) for t in textures]
    monkeypatch.setattr(images, "dxt_decode", lambda *t: calls.append(t) or single(*t))
    assert images.dxt_decode_all(textures) == want and len(calls) < 12
    assert images.dxt_decode_all([]) == []
    for bad, code in (((b"\0" * 7, 4, 4, images.DXT1), "truncated"), ((b"\0" * 16, 4, 4, 99), "bad_format")):
        with pytest.raises(AssetError) as e:
            images.dxt_decode_all([textures[0], bad, bad, textures[0]])
        assert e.value.code == code
