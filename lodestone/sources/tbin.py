"""Tile maps: bytes to nested values and back."""

from __future__ import annotations

from .cursor import AssetError, Reader, Writer

MAGIC = b"tBIN10"
_PROPERTY = ["bool", "int", "float", "string"]


def _pair(r: Reader) -> dict:
    x, y = r.read("ii")
    return {"x": x, "y": y}


def _properties(r: Reader) -> list[dict]:
    found = []
    for _ in range(_count(r)):
        item = {"key": r.long_text(), "type": r.read("B")}
        if item["type"] > 3:
            raise AssetError("bad_property", f"property type {item['type']}")
        value = (lambda: r.read("B") != 0, lambda: r.read("i"), lambda: r.read("f"), r.long_text)[item["type"]]()
        item |= {f"value_{k}": value if i == item["type"] else None for i, k in enumerate(_PROPERTY)}
        found.append(item)
    return found


def _count(r: Reader) -> int:
    n = r.read("i")
    if not 0 <= n <= len(r.data):
        raise AssetError("bad_count", f"{n} items at {r.at}")
    return n


def _static(r: Reader, sheet: str) -> dict:
    return {"kind": "static", "tile_sheet": sheet, "tile_index": r.read("i"), "blend_mode": r.read("B"), "frame_interval": None, "frames": [], "properties": _properties(r)}


def _tile(r: Reader, kind: bytes, sheet: str) -> dict:
    if kind == b"S":
        return _static(r, sheet)
    if kind != b"A":
        raise AssetError("bad_tile", f"tile code {kind!r}")
    interval, count = r.read("i"), _count(r)
    frames, sheet = [], ""
    while len(frames) < count:
        code = r.take(1)
        if code == b"T":
            sheet = r.long_text()
        elif code == b"S":
            frames.append(_static(r, sheet))
        else:
            raise AssetError("bad_tile", f"frame code {code!r}")
    return {"kind": "animated", "tile_sheet": None, "tile_index": None, "blend_mode": None, "frame_interval": interval, "frames": frames, "properties": _properties(r)}


def _layer(r: Reader) -> dict:
    layer = {"id": r.long_text(), "visible": r.read("B") != 0, "description": r.long_text(), "layer_size": _pair(r), "tile_size": _pair(r), "properties": _properties(r), "tiles": []}
    width, sheet, pos = layer["layer_size"]["x"], "", 0
    for _ in range(layer["layer_size"]["y"]):
        edge = pos + width
        while pos < edge:
            code = r.take(1)
            if code == b"T":
                sheet = r.long_text()
                continue
            if code == b"N":
                run = r.read("i")
                if not 0 <= run <= edge - pos:
                    raise AssetError("bad_run", f"{run} empty cells where a row has {edge - pos} left")
                pos += run
                continue
            layer["tiles"].append({"pos": pos} | _tile(r, code, sheet))
            pos += 1
    return layer


def parse(data: bytes) -> dict:
    """A map with its sheets and layers. Empty cells take no entry: `pos` tells where a tile lies."""
    r = Reader(data)
    if r.take(6) != MAGIC:
        raise AssetError("bad_magic", "not a tile map")
    found = {"id": r.long_text(), "description": r.long_text(), "properties": _properties(r), "sheets": [], "layers": []}
    for _ in range(_count(r)):
        sheet = {"id": r.long_text(), "description": r.long_text(), "image": r.long_text()}
        sheet |= {k: _pair(r) for k in ("sheet_size", "tile_size", "margin", "spacing")}
        found["sheets"].append(sheet | {"properties": _properties(r)})
    found["layers"] = [_layer(r) for _ in range(_count(r))]
    return found


MOST_LAYERS = 100


def strip_images(data: bytes) -> bytes:
    """A packed map whose sheets' images are named without `.png`. What follows the sheets is copied, not parsed, but for its number of layers."""
    r, w = Reader(data), Writer()
    if r.take(6) != MAGIC:
        raise AssetError("bad_magic", "not a tile map")
    r.long_text()
    r.long_text()
    _properties(r)
    sheets = _count(r)
    w.raw(data[: r.at])
    for _ in range(sheets):
        start = r.at
        r.long_text()
        r.long_text()
        w.raw(data[start : r.at]).long_text(r.long_text().replace(".png", ""))
        start = r.at
        r.take(32)
        _properties(r)
        w.raw(data[start : r.at])
    layers = r.jump(r.at).read("i")
    if not 0 <= layers <= MOST_LAYERS:
        raise AssetError("bad_count", f"{layers} layers")
    return bytes(w.raw(data[r.at :]).data)


def _put_properties(w: Writer, items) -> None:
    w.write("i", len(items))
    for item in items:
        kind = item["type"]
        if not 0 <= kind <= 3:
            raise AssetError("bad_property", f"property type {kind}")
        w.long_text(item["key"]).write("B", kind)
        value = item[f"value_{_PROPERTY[kind]}"]
        w.long_text(value) if kind == 3 else w.write("Bif"[kind], value)


def _put_static(w: Writer, tile) -> None:
    w.raw(b"S").write("iB", tile["tile_index"], tile["blend_mode"])
    _put_properties(w, tile["properties"])


def _put_layer(w: Writer, layer) -> None:
    w.long_text(layer["id"]).write("B", layer["visible"]).long_text(layer["description"])
    width, height = layer["layer_size"]["x"], layer["layer_size"]["y"]
    w.write("iiii", width, height, layer["tile_size"]["x"], layer["tile_size"]["y"])
    _put_properties(w, layer["properties"])
    tiles, sheet, pos = {t["pos"]: t for t in layer["tiles"]}, "", 0
    if any(not 0 <= p < width * height for p in tiles):
        raise AssetError("bad_run", "a tile lies outside its layer")
    while pos < width * height:
        tile = tiles.get(pos)
        if tile is None:
            end = (pos // width + 1) * width
            run = 1
            while pos + run < end and pos + run not in tiles:
                run += 1
            w.raw(b"N").write("i", run)
            pos += run
            continue
        if tile["kind"] == "static":
            if tile["tile_sheet"] != sheet:
                sheet = tile["tile_sheet"]
                w.raw(b"T").long_text(sheet)
            _put_static(w, tile)
        else:
            w.raw(b"A").write("ii", tile["frame_interval"], len(tile["frames"]))
            inner = ""
            for frame in tile["frames"]:
                if frame["tile_sheet"] != inner:
                    inner = frame["tile_sheet"]
                    w.raw(b"T").long_text(inner)
                _put_static(w, frame)
            _put_properties(w, tile["properties"])
        pos += 1


def build(value: dict) -> bytes:
    """The bytes of a map as parse() gives it."""
    w = Writer().raw(MAGIC)
    w.long_text(value["id"]).long_text(value["description"])
    _put_properties(w, value["properties"])
    w.write("i", len(value["sheets"]))
    for sheet in value["sheets"]:
        for k in ("id", "description", "image"):
            w.long_text(sheet[k])
        for k in ("sheet_size", "tile_size", "margin", "spacing"):
            w.write("ii", sheet[k]["x"], sheet[k]["y"])
        _put_properties(w, sheet["properties"])
    w.write("i", len(value["layers"]))
    for layer in value["layers"]:
        _put_layer(w, layer)
    return bytes(w.data)


_P = "array<struct<key:string,type:int,value_bool:boolean,value_int:int,value_float:float,value_string:string>>"
_XY = "struct<x:int,y:int>"
_FRAME = f"struct<kind:string,tile_sheet:string,tile_index:int,blend_mode:int,frame_interval:int,properties:{_P}>"
_TILE = f"struct<pos:int,kind:string,tile_sheet:string,tile_index:int,blend_mode:int,frame_interval:int,frames:array<{_FRAME}>,properties:{_P}>"
SCHEMA = (
    f"id string, description string, properties {_P}, "
    f"sheets array<struct<id:string,description:string,image:string,sheet_size:{_XY},tile_size:{_XY},margin:{_XY},spacing:{_XY},properties:{_P}>>, "
    f"layers array<struct<id:string,visible:boolean,description:string,layer_size:{_XY},tile_size:{_XY},properties:{_P},tiles:array<{_TILE}>>>"
)
