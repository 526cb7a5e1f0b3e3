"""RIFF waves: reading chunks, and the header of a packed wave."""

from __future__ import annotations

from .cursor import AssetError, Reader, Writer

#: Codecs of a wave bank entry, and format tags of a wave file. Fixed values.
PCM, XMA, ADPCM, WMA = 0, 1, 2, 3
TAG_PCM, TAG_ADPCM = 1, 2
#: Coefficient pairs that every MS-ADPCM header lists. Fixed values of the format.
ADPCM_PAIRS = [(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)]


def wave_format(version: int, packed: int) -> dict:
    """Codec, channels, rate, align and bits of a packed format; banks up to version 3 write ADPCM as XMA."""
    wide = 1 if version == 1 else 2
    codec = packed & (1 << wide) - 1
    if version <= 3 and codec == XMA:
        codec = ADPCM
    return {"codec": codec, "channels": packed >> wide & 7, "rate": packed >> 5 & 0x3FFFF, "align": packed >> 23 & 255, "bits": packed >> 31 & 1}


def wave_file(data: bytes, codec: int, channels: int, rate: int, align: int, bits: int) -> bytes:
    """A RIFF file around the bytes of one bank entry. Only PCM and MS-ADPCM have one."""
    channels = max(channels, 1)
    fmt, fact = Writer(), b""
    if codec == PCM:
        depth = 8 << bits
        block = depth // 8 * channels
        fmt.write("HHIIHH", TAG_PCM, channels, rate, rate * block, block, depth)
    elif codec == ADPCM:
        block = (align + 22) * channels
        samples = (block - 7 * channels) * 8 // (4 * channels) + 2
        fmt.write("HHIIHH", TAG_ADPCM, channels, rate, rate // samples * block, block, 4)
        fmt.write("HHH", 32, samples, len(ADPCM_PAIRS))
        for pair in ADPCM_PAIRS:
            fmt.write("hh", *pair)
        count = len(data) // block * ((block - 7 * channels) * 8 // 4) // channels
        fact = bytes(Writer().raw(b"fact").write("II", 4, count).data)
    else:
        raise AssetError("bad_codec", f"codec {codec} has no wave file")
    pad = b"\0" * (len(data) % 2)
    body = Writer().raw(b"WAVEfmt ").write("I", len(fmt.data)).raw(fmt.data).raw(fact)
    body.raw(b"data").write("I", len(data)).raw(data).raw(pad)
    return bytes(Writer().raw(b"RIFF").write("I", len(body.data)).raw(body.data).data)


FIELDS = ("format_tag", "channels", "rate", "byte_rate", "block_align", "bits")


def format_bytes(fields: dict) -> bytes:
    """The format of parse_wave()'s fields as a wave file and a sound effect hold it."""
    return bytes(Writer().write("HHIIHH", *(fields[k] for k in FIELDS)).raw(fields["extra"] or b"").data)


def format_fields(fmt: bytes) -> dict:
    r = Reader(fmt)
    return dict(zip(FIELDS, r.read("HHIIHH"))) | {"extra": fmt[16:]}


def riff(fmt: bytes, data: bytes) -> bytes:
    """A wave file of a format and its samples as they are."""
    body = Writer().raw(b"WAVEfmt ").write("I", len(fmt)).raw(fmt).raw(b"\0" * (len(fmt) % 2))
    body.raw(b"data").write("I", len(data)).raw(data).raw(b"\0" * (len(data) % 2))
    return bytes(Writer().raw(b"RIFF").write("I", len(body.data)).raw(body.data).data)


def parse_wave(data: bytes) -> dict:
    """The chunks of a wave file; unknown ones are passed over, pad bytes too."""
    r = Reader(data)
    if r.take(4) != b"RIFF":
        raise AssetError("bad_magic", "not a RIFF file")
    r.read("I")
    if r.take(4) != b"WAVE":
        raise AssetError("bad_magic", "not a wave")
    out = dict.fromkeys((*FIELDS, "extra", "fact_samples", "data"))
    while r.at + 8 <= len(data):
        kind, size = r.read("4sI")
        part = Reader(r.take(size))
        if size % 2 and r.at < len(data):
            r.take(1)
        if kind == b"fmt ":
            out.update(zip(FIELDS, part.read("HHIIHH")), extra=part.data[16:])
        elif kind == b"fact":
            out["fact_samples"] = part.read("I")
        elif kind == b"data":
            out["data"] = part.data
    if out["format_tag"] is None or out["data"] is None:
        raise AssetError("missing_chunk", "no fmt or no data chunk")
    return out
