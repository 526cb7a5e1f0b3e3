"""Content containers: header, compression, reader manifest and one root value.

A manifest names a reader for each type in the file. A value of a value type lies bare; any other begins with a tag,
0 for null, else the reader's place in the manifest plus one.
"""

from __future__ import annotations

import json
from functools import lru_cache

from .compression import lz4_decode, lz4_encode, lzx_decode
from .cursor import AssetError, Reader, Writer

HIDEF, LZ4, LZX = 0x01, 0x40, 0x80
TARGETS = "wmxailX"
_NUMBERS = {"Int32": "i", "UInt32": "I", "Single": "f", "Double": "d", "Boolean": "?"}
_TUPLES = {
    "Point": ("ii", ("x", "y")),
    "IntVector2": ("ii", ("x", "y")),
    "Rectangle": ("iiii", ("x", "y", "width", "height")),
    "Vector2": ("ff", ("x", "y")),
    "Vector3": ("fff", ("x", "y", "z")),
    "Vector4": ("ffff", ("x", "y", "z", "w")),
}
_GENERIC = {"List", "Array", "Dictionary", "Nullable", "Enum", "Reflective"}


@lru_cache(1024)
def type_of(text: str) -> tuple[str, tuple]:
    """(name, arguments) of a type or of what a reader reads, without assemblies and namespaces.

    "Ns.ListReader`1[[System.String, lib]]" is ("List", (("String", ()),)). A class of the user keeps its full name.
    """
    open_at = text.find("[[")
    head, args = (text, []) if open_at < 0 else (text[:open_at], [])
    depth, start = 0, 0
    for i in range(open_at + 1, len(text)) if open_at >= 0 else ():
        if text[i] == "[":
            depth += 1
            if depth == 1:
                start = i + 1
        elif text[i] == "]":
            depth -= 1
            if depth == 0:
                args.append(type_of(text[start:i]))
            if depth < 0:
                break
    full = head.split(",")[0].strip()
    if full.endswith("[]"):
        return "Array", (type_of(full[:-2]),)
    name = full.split("`")[0].rsplit(".", 1)[-1]
    short = name.removesuffix("Reader") or name
    if len(args) < {"Dictionary": 2, "List": 1, "Array": 1, "Nullable": 1, "Reflective": 1}.get(short, 0):
        raise AssetError("bad_type", f"{text} lacks its types")
    if short == "Reflective":
        return args[0]
    if short == "Tide" or short == "TBin":
        return "TBin", ()
    if short in _NUMBERS or short in _TUPLES or short in _GENERIC or short in ("String", "Char", "Texture2D", "SpriteFont", "Effect", "XmlSource", "SoundEffect"):
        return short, tuple(args)
    return full, tuple(args)


class Decoder:
    """Reads values by the manifest of one file; `classes` describes the user's classes.

    A class is {"fields": [(name, type), ...], "base": a class or None, "value": whether it is a value type}.
    """

    def __init__(self, r: Reader, manifest: list[str], classes: dict[str, dict] | None = None):
        self.r, self.types, self.classes = r, [type_of(t) for t in manifest], classes or {}

    def bare(self, kind: tuple) -> bool:
        name = kind[0]
        return name in _NUMBERS or name in _TUPLES or name in ("Char", "Enum", "Nullable") or bool(self.classes.get(name, {}).get("value")) or "enum" in self.classes.get(name, {})

    def tagged(self):
        tag = self.r.varint()
        if tag > len(self.types):
            raise AssetError("bad_tag", f"reader {tag} of {len(self.types)}")
        return self.value(self.types[tag - 1]) if tag else None

    def item(self, kind: tuple):
        return self.value(kind) if self.bare(kind) else self.tagged()

    def value(self, kind: tuple):
        name, args = kind
        r = self.r
        if name in _NUMBERS:
            return r.read(_NUMBERS[name])
        if name in _TUPLES:
            pattern, names = _TUPLES[name]
            return dict(zip(names, r.read(pattern)))
        if name == "Char":
            return r.char()
        if name in ("String", "XmlSource"):
            return r.short_text()
        if name == "Effect":
            return r.take(r.read("I"))
        if name == "TBin":
            return r.take(r.read("i"))
        if name == "Enum":
            return r.read("i")
        if name == "Nullable":
            return self.item(args[0]) if r.read("?") else None
        if name in ("List", "Array"):
            return [self.item(args[0]) for _ in range(self.count())]
        if name == "Dictionary":
            pairs = [(self.item(args[0]), self.item(args[1])) for _ in range(self.count())]
            return dict(pairs) if all(isinstance(k, (str, int)) for k, _ in pairs) else [{"key": k, "value": v} for k, v in pairs]
        if name == "Texture2D":
            return self.texture()
        if name == "SpriteFont":
            names = ("texture", "glyphs", "cropping", "character_map")
            found = {n: self.tagged() for n in names}
            found["line_spacing"], found["spacing"] = r.read("if")
            found["kerning"] = self.tagged()
            found["default_character"] = r.char() if r.read("?") else None
            return found
        if name == "SoundEffect":
            fmt = r.take(r.read("I"))
            data = r.take(r.read("I"))
            return {"fmt": fmt, "data": data} | dict(zip(("loop_start", "loop_length", "duration_ms"), r.read("iii")))
        return self.reflective(name)

    def count(self) -> int:
        n = self.r.read("I")
        if n > len(self.r.data):
            raise AssetError("bad_count", f"{n} items")
        return n

    def texture(self) -> dict:
        kind, width, height, mips, size = self.r.read("iiiiI")
        data = self.r.take(size)
        for _ in range(mips - 1):
            self.r.take(self.r.read("I"))
        return {"format": kind, "width": width, "height": height, "mip_count": mips, "data_size": size, "data": data}

    def reflective(self, name: str) -> dict:
        known = self.classes.get(name)
        if known is None:
            raise AssetError("unknown_reader", f"no reader for {name}")
        if "enum" in known:
            return self.r.read("i")
        found = self.reflective(known["base"]) if known.get("base") else {}
        return found | {field: self.item(type_of(kind)) for field, kind in known["fields"]}


class Encoder:
    """Writes values as Decoder reads them."""

    def __init__(self, manifest: list[str], classes: dict[str, dict] | None = None):
        self.w, self.types = Writer(), [type_of(t) for t in manifest]
        self.decoder = Decoder(Reader(b""), manifest, classes)

    def tagged(self, kind: tuple, value) -> None:
        if value is None:
            self.w.varint(0)
            return
        if kind not in self.types:
            raise AssetError("unknown_reader", f"the manifest has no reader for {kind[0]}")
        self.w.varint(self.types.index(kind) + 1)
        self.value(kind, value)

    def item(self, kind: tuple, value) -> None:
        self.value(kind, value) if self.decoder.bare(kind) else self.tagged(kind, value)

    def value(self, kind: tuple, value) -> None:
        name, args = kind
        w = self.w
        if name in _NUMBERS:
            w.write(_NUMBERS[name], value)
        elif name in _TUPLES:
            pattern, names = _TUPLES[name]
            w.write(pattern, *(value[n] for n in names))
        elif name == "Char":
            w.raw(value.encode())
        elif name in ("String", "XmlSource"):
            w.short_text(value)
        elif name == "Effect" or name == "TBin":
            w.write("I", len(value)).raw(value)
        elif name == "Enum":
            w.write("i", value)
        elif name == "Nullable":
            w.write("?", value is not None)
            if value is not None:
                self.item(args[0], value)
        elif name in ("List", "Array"):
            w.write("I", len(value))
            for v in value:
                self.item(args[0], v)
        elif name == "Dictionary":
            pairs = list(value.items()) if isinstance(value, dict) else [(p["key"], p["value"]) for p in value]
            w.write("I", len(pairs))
            for k, v in pairs:
                self.item(args[0], int(k) if args[0][0] in ("Int32", "UInt32", "Enum") else k)
                self.item(args[1], v)
        elif name == "Texture2D":
            w.write("iiiiI", value["format"], value["width"], value["height"], 1, len(value["data"])).raw(value["data"])
        elif name == "SpriteFont":
            self.tagged(("Texture2D", ()), value["texture"])
            self.tagged(("List", (("Rectangle", ()),)), value["glyphs"])
            self.tagged(("List", (("Rectangle", ()),)), value["cropping"])
            self.tagged(("List", (("Char", ()),)), value["character_map"])
            w.write("if", value["line_spacing"], value["spacing"])
            self.tagged(("List", (("Vector3", ()),)), value["kerning"])
            w.write("?", value["default_character"] is not None)
            if value["default_character"] is not None:
                w.raw(value["default_character"].encode())
        elif name == "SoundEffect":
            w.write("I", len(value["fmt"])).raw(value["fmt"]).write("I", len(value["data"])).raw(value["data"])
            w.write("iii", value["loop_start"], value["loop_length"], value["duration_ms"])
        else:
            self.reflective(name, value)

    def reflective(self, name: str, value) -> None:
        known = self.decoder.classes.get(name)
        if known is None:
            raise AssetError("unknown_reader", f"no reader for {name}")
        if "enum" in known:
            self.w.write("i", value)
            return
        if known.get("base"):
            self.reflective(known["base"], value)
        for field, kind in known["fields"]:
            self.item(type_of(kind), value[field])


def unwrap(data: bytes) -> tuple[dict, bytes]:
    """(header, body expanded)."""
    r = Reader(data)
    if r.take(3) != b"XNB":
        raise AssetError("bad_magic", "not a content container")
    target, version, flags, size = r.read("cBBI")
    if target not in (t.encode() for t in TARGETS):
        raise AssetError("bad_target", f"target {target!r}")
    if size != len(data):
        raise AssetError("size_mismatch", f"{len(data)} bytes where {size} were declared")
    packed = flags & (LZ4 | LZX)
    raw = r.read("I") if packed else None
    body = r.take(len(data) - r.at)
    if packed:
        body = (lz4_decode if flags & LZ4 else lzx_decode)(body, raw)
    return {"target": target.decode(), "format_version": version, "compressed_flag": packed, "hidef": flags & HIDEF != 0, "file_size": size, "raw_size": raw}, body


KINDS = {"Texture2D": "png", "SpriteFont": "font", "Effect": "cso", "XmlSource": "xml", "TBin": "tbin", "SoundEffect": "wav"}


def _plain(value):
    """A value as JSON can hold it: bytes in hex."""
    return value.hex() if isinstance(value, bytes) else value


def parse(data: bytes, classes: dict[str, dict] | None = None) -> dict:
    """One container as a row: header, manifest, and the root by kind."""
    row, body = unwrap(data)
    r = Reader(body)
    manifest = [{"type": r.short_text(), "version": r.read("I")} for _ in range(r.varint())]
    if not manifest:
        raise AssetError("bad_count", "an empty manifest")
    if r.varint():
        raise AssetError("shared_resources", "shared resources are not supported")
    decoder = Decoder(r, [m["type"] for m in manifest], classes)
    root = decoder.tagged()
    name = decoder.types[0][0]
    row |= {"readers": manifest, "extension": KINDS.get(name, "json"), "texture": None, "data": None, "content": None}
    if name == "Texture2D":
        row["texture"] = root
    elif isinstance(root, bytes):
        row["data"] = root
    elif name == "XmlSource":
        row["content"] = root
    else:
        if name == "SpriteFont":
            row["texture"], root = root["texture"], root | {"texture": None}
        row["content"] = json.dumps(root, default=_plain, ensure_ascii=False)
    return row


def build(row: dict, classes: dict[str, dict] | None = None, compress: bool = False) -> bytes:
    """The bytes of a row as parse() gives it; with `compress` as LZ4 where that is smaller, else plain."""
    manifest = [m["type"] for m in row["readers"]]
    e = Encoder(manifest, classes)
    kind = e.types[0]
    if kind[0] == "Texture2D":
        root = row["texture"]
    elif kind[0] in ("Effect", "TBin"):
        root = row["data"]
    elif kind[0] == "XmlSource":
        root = row["content"]
    else:
        root = json.loads(row["content"])
        if kind[0] == "SpriteFont":
            root["texture"] = row["texture"]
        elif kind[0] == "SoundEffect":
            root |= {k: bytes.fromhex(root[k]) for k in ("fmt", "data")}
    head = Writer().varint(len(manifest))
    for m in row["readers"]:
        head.short_text(m["type"]).write("I", m["version"])
    head.varint(0)
    e.tagged(kind, root)
    body, flags = bytes(head.data + e.w.data), HIDEF if row["hidef"] else 0
    packed = lz4_encode(body) if compress else body
    if compress and len(packed) + 4 < len(body):
        return bytes(Writer().raw(b"XNB").write("cBBII", row["target"].encode(), row["format_version"], flags | LZ4, 14 + len(packed), len(body)).raw(packed).data)
    return bytes(Writer().raw(b"XNB").write("cBBI", row["target"].encode(), row["format_version"], flags, 10 + len(body)).raw(body).data)


SCHEMA = (
    "target string, format_version int, compressed_flag int, hidef boolean, file_size bigint, raw_size bigint, readers array<struct<type:string,version:bigint>>, extension string, "
    "texture struct<format:int,width:int,height:int,mip_count:int,data_size:bigint,data:binary>, data binary, content string"
)
