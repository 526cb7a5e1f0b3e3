"""Audio projects: engine settings, sound banks and wave banks, bytes to nested values."""

from __future__ import annotations

from .audio import wave_format
from .cursor import AssetError, Reader

COMPACT = 0x20000


def _names(r: Reader, count: int) -> list[str]:
    return [r.c_text() for _ in range(count)]


def parse_engine(data: bytes) -> dict:
    """Categories, variables and curves of an engine file; `is_global` comes from bit 1 of a variable's flags."""
    r = Reader(data)
    if r.take(4) != b"XGSF":
        raise AssetError("bad_magic", "not an audio engine file")
    tool, version, _, _, _, _, n_cats, n_vars = r.read("HHHIIBHH")
    r.take(4)
    n_rpc, n_presets, n_params, cats_at, vars_at = r.read("HHHII")
    r.take(4)
    r.read("I")
    r.take(4)
    _, cat_names_at, var_names_at, rpc_at, _, params_at = r.read("IIIIII")
    out = {"tool_version": tool, "version": version, "categories": [], "variables": [], "curves": [], "dsp": []}
    names, c = (_names(r.jump(cat_names_at), n_cats) if n_cats else []), r.jump(cats_at)
    for i, name in enumerate(names):
        limit, fade_in, fade_out, flags, _, volume, seen = c.read("BHHBHBB")
        out["categories"].append({"category_id": i, "name": name, "max_instances": limit, "instance_limit": limit != 255, "fade_in": fade_in / 1000, "fade_out": fade_out / 1000, "fade_type": flags & 7, "behavior": flags >> 3, "volume_db": volume, "is_music": seen & 1 != 0, "is_public": seen & 2 != 0})
    names, v = (_names(r.jump(var_names_at), n_vars) if n_vars else []), r.jump(vars_at)
    for i, name in enumerate(names):
        flags, init, low, high = v.read("Bfff")
        out["variables"].append({"variable_id": i, "name": name, "flags": flags, "is_global": flags & 2 != 0, "init": init, "min": low, "max": high})
    p = r.jump(rpc_at) if n_rpc else None
    for i in range(n_rpc):
        at = p.at
        variable, count, parameter = p.read("HBH")
        if variable >= n_vars:
            raise AssetError("bad_index", f"curve of variable {variable}")
        points = [dict(zip(("x", "y", "type"), p.read("ffB"))) for _ in range(count)]
        out["curves"].append({"curve_ord": i, "file_offset": at, "variable": names[variable], "parameter": parameter, "points": points})
    if n_presets:
        if n_presets != 1 or n_params != 22:
            raise AssetError("bad_count", f"{n_presets} presets of {n_params} parameters")
        d = r.jump(params_at)
        for i in range(n_params):
            _, value, low, high, _ = d.read("BfffH")
            out["dsp"].append({"param_ord": i, "value": value, "min": low, "max": high})
    return out


def _tracks(r: Reader, count: int) -> list[tuple[int, int]]:
    return [r.read("HBBB")[:2] for _ in range(count)]


def _event(r: Reader) -> list[dict]:
    """The waves that one event may play; kinds that play none are faults, as they have no known layout here."""
    info, offset = r.read("IH")
    kind = info & 31
    base = {"event_type": kind, "random_offset": offset * 0.001, "loop_count": None, "pan_angle": None, "pan_arc": None}
    if kind in (1, 4):
        _, _, track, bank, loops, angle, arc = r.read("BBHBBHH")
        tracks = [(track, bank)]
        if kind == 4:
            r.take(24)  # pitch, volume, frequency and Q ranges, then one unknown byte and flags
    elif kind in (3, 6):
        _, _, loops, angle, arc = r.read("BBBHH")
        if kind == 6:
            r.take(24)
        count, _ = r.read("HB")
        r.take(5)
        tracks = _tracks(r, count)
    else:
        raise AssetError("bad_event", f"event type {kind}")
    base |= {"loop_count": loops, "pan_angle": angle / 100, "pan_arc": arc / 100}
    return [base | {"track_index": t, "bank_index": b} for t, b in tracks]


def _sound(r: Reader, weight: tuple[float, float] | None = None) -> dict:
    at = r.at
    flags, category, volume, pitch, priority, length = r.read("BHBhBH")
    waves, clips = [], 0
    if flags & 1:
        clips = r.read("B")
    else:
        track, bank = r.read("HB")
        waves = [{"event_type": None, "random_offset": None, "loop_count": None, "pan_angle": None, "pan_arc": None, "track_index": track, "bank_index": bank, "clip_ord": None, "event_ord": None}]
    if flags & 0x0E:
        extra = r.at
        r = r.jump(extra + r.read("H"))
    if flags & 0x10:
        r.take(7)
    for c in range(clips):
        _, clip_at, _, _ = r.read("BIHH")
        clip = r.jump(clip_at)
        for e in range(clip.read("B")):
            waves += [w | {"clip_ord": c, "event_ord": e} for w in _event(clip)]
    return {"sound_offset": at, "flags": flags, "category_id": category, "volume": volume, "pitch": pitch / 1000, "priority": priority, "entry_length": length, "weight_min": weight and weight[0], "weight_max": weight and weight[1], "waves": waves}


def _direct(track: int, bank: int, weight) -> dict:
    """A variation that names a wave itself: it has no sound, so no category."""
    wave = {"event_type": None, "random_offset": None, "loop_count": None, "pan_angle": None, "pan_arc": None, "track_index": track, "bank_index": bank, "clip_ord": None, "event_ord": None}
    return dict.fromkeys(["sound_offset", "flags", "category_id", "volume", "pitch", "priority", "entry_length"]) | {"weight_min": weight and weight[0], "weight_max": weight and weight[1], "waves": [wave]}


def _variations(r: Reader) -> list[dict]:
    count, flags = r.read("HH")
    r.take(4)
    kind, found = flags >> 3 & 7, []
    for _ in range(count):
        if kind in (0, 4):
            track, bank = r.read("HB")
            found.append(_direct(track, bank, tuple(map(float, r.read("BB"))) if kind == 0 else None))
        elif kind in (1, 3):
            at = r.read("I")
            weight = tuple(map(float, r.read("BB"))) if kind == 1 else r.read("ffI")[:2]
            found.append(_sound(r.jump(at), weight))
        else:
            raise AssetError("bad_variation", f"variation table of type {kind}")
    return found


def parse_sound_bank(data: bytes) -> dict:
    """Cues by name, each with its sounds and the waves that these play."""
    r = Reader(data)
    if r.take(4) != b"SDBK":
        raise AssetError("bad_magic", "not a sound bank")
    tool, version, _, _, _, platform, n_simple, n_complex = r.read("HHHIIBHH")
    r.take(2)
    _, n_banks, _, names_len = r.read("HBHH")
    r.take(2)
    simple_at, complex_at, names_at = r.read("III")
    r.take(4)
    r.read("I")
    r.take(4)
    banks_at, _, _, _ = r.read("IIII")
    out = {"name": r.padded(64), "tool_version": tool, "version": version, "platform": platform, "wave_banks": [], "cues": []}
    b = r.jump(banks_at)
    out["wave_banks"] = [b.padded(64) for _ in range(n_banks)]
    names = r.jump(names_at).text(names_len).split("\0")
    if len(names) < n_simple + n_complex:
        raise AssetError("bad_count", f"{len(names)} names for {n_simple + n_complex} cues")
    c = r.jump(simple_at) if n_simple else r
    for i in range(n_simple):
        flags, at = c.read("BI")
        out["cues"].append({"cue_ord": i, "name": names[i], "flags": flags, "sounds": [_sound(r.jump(at))]})
    c = r.jump(complex_at) if n_complex else r
    for i in range(n_simple, n_simple + n_complex):
        flags, at, _ = c.read("BII")
        sounds = [_sound(r.jump(at))] if flags & 4 else _variations(r.jump(at))
        c.read("BHHB")
        out["cues"].append({"cue_ord": i, "name": names[i], "flags": flags, "sounds": sounds})
    return out


def parse_wave_bank(data: bytes) -> dict:
    """Entries of a wave bank with their bytes; "DNBW" banks are big-endian."""
    magic = data[:4]
    if magic not in (b"WBND", b"DNBW"):
        raise AssetError("bad_magic", "not a wave bank")
    r = Reader(data, "<" if magic == b"WBND" else ">")
    r.at = 4
    version = r.read("I")
    last = 3 if version in (2, 3) else 4
    segments = [(0, 0)] * 5
    if version != 1:
        if version >= 42:
            r.read("I")
        segments = [r.read("II") for _ in range(last + 1)]
        r = r.jump(segments[0][0])
    flags, count = r.read("II")
    name = r.padded(16 if version in (2, 3) else 64)
    each, align = 20, 1
    if version != 1:
        each, _, align = r.read("IiI")
    packed = r.read("I") if flags & COMPACT else None
    table = segments[1][0] if version != 1 else r.at
    if count * (4 if flags & COMPACT else each) > len(data):
        raise AssetError("bad_count", f"{count} entries in {len(data)} bytes")
    base = segments[last][0] or table + count * each
    length = segments[last][1]
    rows, e = [], r.jump(table)
    if flags & COMPACT:
        starts = [(e.read("I") & 0x1FFFFF) * align for _ in range(count)]
        rows = [(0, packed, s, n - s, 0, 0) for s, n in zip(starts, starts[1:] + [length])]
    for i in range(0 if flags & COMPACT else count):
        e.at = table + i * each
        if version == 1:
            rows.append((0, *e.read("IIIII")))
            continue
        fields = min(each // 4, 6)
        found = e.read("I" * fields) if fields else ()
        row = list((found if isinstance(found, tuple) else (found,)) + (0,) * (6 - fields))
        if each < 24 and row[3] == 0:
            row[3] = length
        rows.append(tuple(row))
    entries, end = [], None
    for i, (duration, fmt, offset, size, loop_at, loop_size) in enumerate(rows):
        start = base + offset
        if size < 0:
            raise AssetError("bad_offset", f"entry {i} has {size} bytes")
        entries.append({"entry_idx": i, "flags_duration": duration, "format": fmt} | wave_format(version, fmt) | {"play_offset": start, "play_length": size, "loop_offset": loop_at, "loop_length": loop_size, "gap": None if end is None else start - end, "data": r.jump(start).take(size)})
        end = start + size
    return {"name": name, "version": version, "flags": flags, "alignment": align, "entry_count": count, "entries": entries}


ENGINE_SCHEMA = (
    "tool_version int, version int, "
    "categories array<struct<category_id:int,name:string,max_instances:int,instance_limit:boolean,fade_in:double,fade_out:double,fade_type:int,behavior:int,volume_db:int,is_music:boolean,is_public:boolean>>, "
    "variables array<struct<variable_id:int,name:string,flags:int,is_global:boolean,init:float,min:float,max:float>>, "
    "curves array<struct<curve_ord:int,file_offset:bigint,variable:string,parameter:int,points:array<struct<x:float,y:float,type:int>>>>, "
    "dsp array<struct<param_ord:int,value:float,min:float,max:float>>"
)
_WAVE = "struct<event_type:int,random_offset:double,loop_count:int,pan_angle:double,pan_arc:double,track_index:int,bank_index:int,clip_ord:int,event_ord:int>"
_SOUND = f"struct<sound_offset:bigint,flags:int,category_id:int,volume:int,pitch:double,priority:int,entry_length:int,weight_min:double,weight_max:double,waves:array<{_WAVE}>>"
SOUND_BANK_SCHEMA = f"name string, tool_version int, version int, platform int, wave_banks array<string>, cues array<struct<cue_ord:int,name:string,flags:int,sounds:array<{_SOUND}>>>"
WAVE_BANK_SCHEMA = (
    "name string, version bigint, flags bigint, alignment bigint, entry_count bigint, "
    "entries array<struct<entry_idx:int,flags_duration:bigint,format:bigint,codec:int,channels:int,rate:int,align:int,bits:int,"
    "play_offset:bigint,play_length:bigint,loop_offset:bigint,loop_length:bigint,gap:bigint,data:binary>>"
)
