"""Rasters: DXT blocks, straight and premultiplied alpha, and PNG. All pixels of a raster at once, in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .cursor import AssetError

#: Surface formats of a texture. Fixed values.
RGBA, DXT1, DXT3, DXT5 = 0, 4, 5, 6
#: Blocks of small textures that are decoded together, each of about 1 KB while it is.
BLOCKS_AT_ONCE = 4096


def _expand(colors: np.ndarray) -> np.ndarray:
    """(n,) of 5-6-5 bits to (n, 3) of 8 bits, high bits repeated below."""
    r, g, b = colors >> 11 & 31, colors >> 5 & 63, colors & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], -1)


def _palette(c0: np.ndarray, c1: np.ndarray, three: np.ndarray) -> np.ndarray:
    """(n, 4, 4) of RGBA: two ends and what lies between; three-colour blocks hold a midpoint and clear black."""
    a, b = _expand(c0), _expand(c1)
    mid = three[:, None]
    third = np.where(mid, (a + b) // 2, (2 * a + b) // 3)
    fourth = np.where(mid, 0, (a + 2 * b) // 3)
    rgb = np.stack([a, b, third, fourth], 1)
    alpha = np.full(rgb.shape[:2] + (1,), 255)
    alpha[:, 3, 0] = np.where(three, 0, 255)
    return np.concatenate([rgb, alpha], -1)


def _ramp(a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """(n, 8) of alpha: eight even steps where the first is larger, else six and the two extremes."""
    i = np.arange(8)
    eight = np.where(i == 0, a0, np.where(i == 1, a1, ((8 - i) * a0 + (i - 1) * a1) // 7))
    six = np.where(i == 0, a0, np.where(i == 1, a1, ((6 - i) * a0 + (i - 1) * a1) // 5))
    six = np.where(i == 6, 0, np.where(i == 7, 255, six))
    return np.where(a0 > a1, eight, six)


def _blocks_to_raster(blocks: np.ndarray, width: int, height: int) -> bytes:
    across, down = -(-width // 4), -(-height // 4)
    grid = blocks.reshape(down, across, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(down * 4, across * 4, 4)
    return grid[:height, :width].astype(np.uint8).tobytes()


def dxt_decode(data: bytes, width: int, height: int, kind: int) -> bytes:
    """Raster of RGBA8 rows from 4x4 blocks in row order."""
    each = 8 if kind == DXT1 else 16
    count = -(-width // 4) * -(-height // 4)
    if kind not in (DXT1, DXT3, DXT5):
        raise AssetError("bad_format", f"surface format {kind}")
    if len(data) < count * each:
        raise AssetError("truncated", f"{len(data)} bytes for {count} blocks")
    return _blocks_to_raster(_pixels(np.frombuffer(data, np.uint8, count * each).reshape(count, each), kind), width, height)


def dxt_decode_all(textures: list[tuple[bytes, int, int, int]]) -> list[bytes]:
    """dxt_decode() of many textures: neighbours of one size and format up to BLOCKS_AT_ONCE are decoded as one that is so much higher."""
    out, at = [], 0
    while at < len(textures):
        data, width, height, kind = textures[at]
        down, count = -(-height // 4), max(-(-width // 4) * -(-height // 4), 1)
        size, n = count * (8 if kind == DXT1 else 16), 1
        while at + n < len(textures) and (n + 1) * count <= BLOCKS_AT_ONCE and textures[at + n][1:] == (width, height, kind):
            n += 1
        part = [d[:size] for d, *_ in textures[at : at + n]]
        if n == 1 or width <= 0 or height <= 0 or any(len(d) < size for d in part):  # a fault is that of its texture
            out += [dxt_decode(d, width, height, kind) for d in part]
        else:
            raster = dxt_decode(b"".join(part), width, 4 * down * n, kind)
            tall, wanted = 4 * down * width * 4, height * width * 4
            out += [raster[i * tall : i * tall + wanted] for i in range(n)]
        at += n
    return out


def _pixels(raw: np.ndarray, kind: int) -> np.ndarray:
    """(n, 16, 4) of RGBA from n blocks."""
    count = len(raw)
    color = raw[:, -8:].astype(np.int64)
    c0, c1 = color[:, 0] | color[:, 1] << 8, color[:, 2] | color[:, 3] << 8
    three = (c0 <= c1) if kind == DXT1 else np.zeros(count, bool)
    codes = (color[:, 4:, None] >> (np.arange(4) * 2) & 3).reshape(count, 16)
    pixels = np.take_along_axis(_palette(c0, c1, three), codes[:, :, None], 1)
    if kind == DXT3:
        nibbles = (raw[:, :8, None].astype(np.int64) >> np.array([0, 4]) & 15).reshape(count, 16)
        pixels[:, :, 3] = nibbles * 17
    elif kind == DXT5:
        head = raw[:, :8].astype(np.int64)
        bits = (head[:, 2:] << (np.arange(6) * 8)).sum(1)
        steps = bits[:, None] >> (np.arange(16) * 3) & 7
        pixels[:, :, 3] = np.take_along_axis(_ramp(head[:, :1], head[:, 1:2]), steps, 1)
    return pixels


def dxt_encode(data: bytes, width: int, height: int, kind: int) -> bytes:
    """Blocks whose ends are the extremes of each block's pixels along its main axis.

    Decoding gives the raster back within a bound of error, not exactly: block codes lose colour.
    """
    if kind not in (DXT1, DXT3, DXT5):
        raise AssetError("bad_format", f"surface format {kind}")
    image = np.frombuffer(data, np.uint8).reshape(height, width, 4)
    image = np.pad(image, ((0, -height % 4), (0, -width % 4), (0, 0)), "edge").astype(np.int64)
    down, across = image.shape[0] // 4, image.shape[1] // 4
    px = image.reshape(down, 4, across, 4, 4).transpose(0, 2, 1, 3, 4).reshape(-1, 16, 4)
    rgb, alpha = px[:, :, :3].astype(float), px[:, :, 3]
    clear = (alpha < 128) if kind == DXT1 else np.zeros_like(alpha, bool)
    weight = np.where(clear, 0.0, 1.0)[:, :, None]
    mean = (rgb * weight).sum(1, keepdims=True) / np.maximum(weight.sum(1, keepdims=True), 1)
    off = (rgb - mean) * weight
    axis = np.linalg.eigh(np.einsum("npi,npj->nij", off, off))[1][:, :, -1]
    along = np.einsum("npi,ni->np", off, axis)
    rows = np.arange(len(px))
    ends = []
    for pick in (np.where(clear, -np.inf, along).argmax(1), np.where(clear, np.inf, along).argmin(1)):
        end = rgb[rows, pick]
        q = np.rint(end * np.array([31, 63, 31]) / 255).astype(np.int64)
        ends.append(q[:, 0] << 11 | q[:, 1] << 5 | q[:, 2])
    three = clear.any(1)
    c0, c1 = np.maximum(*ends), np.minimum(*ends)
    c0, c1 = np.where(three, c1, c0), np.where(three, c0, c1)
    equal = (c0 <= c1) if kind == DXT1 else np.zeros(len(px), bool)
    table = _palette(c0, c1, equal)[:, :, :3]
    error = ((rgb[:, :, None] - table[:, None]) ** 2).sum(-1)
    error[:, :, 3] = np.where(equal[:, None], np.inf, error[:, :, 3])
    code = np.where(clear, 3, error.argmin(-1)).reshape(-1, 4, 4)
    out = np.zeros((len(px), 8 if kind == DXT1 else 16), np.uint8)
    tail = out[:, -8:]
    tail[:, 0], tail[:, 1], tail[:, 2], tail[:, 3] = c0 & 255, c0 >> 8, c1 & 255, c1 >> 8
    tail[:, 4:] = (code << (np.arange(4) * 2)).sum(-1)
    if kind == DXT3:
        n = np.rint(alpha / 17).astype(np.int64).reshape(-1, 8, 2)
        out[:, :8] = n[:, :, 0] | n[:, :, 1] << 4
    elif kind == DXT5:
        a0, a1 = alpha.max(1, keepdims=True), alpha.min(1, keepdims=True)
        step = np.abs(alpha[:, :, None] - _ramp(a0, a1)[:, None]).argmin(-1)
        bits = (step << (np.arange(16) * 3)).sum(1)
        out[:, 0], out[:, 1] = a0[:, 0], a1[:, 0]
        out[:, 2:8] = bits[:, None] >> (np.arange(6) * 8) & 255
    return out.tobytes()


def premultiply(data: bytes) -> bytes:
    """Colours times alpha, rounded down."""
    px = np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.int64)
    return np.concatenate([px[:, :3] * px[:, 3:] // 255, px[:, 3:]], 1).astype(np.uint8).tobytes()


def unpremultiply(data: bytes) -> bytes:
    """Colours over alpha, rounded up and at most 255; a clear pixel keeps 0 and takes 255 where it had colour."""
    px = np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.int64)
    alpha = px[:, 3:]
    color = np.where(alpha > 0, -(-px[:, :3] * 255 // np.maximum(alpha, 1)), np.where(px[:, :3] > 0, 255, 0))
    return np.concatenate([np.minimum(color, 255), alpha], 1).astype(np.uint8).tobytes()


def region_opaque(data: bytes, width: int, x: int, y: int, w: int = 16, h: int = 16) -> bool:
    """Whether every pixel of a rectangle has full alpha."""
    return bool((np.frombuffer(data, np.uint8).reshape(-1, width, 4)[y : y + h, x : x + w, 3] == 255).all())


def png_encode(data: bytes, width: int, height: int) -> bytes:
    """An RGBA8 raster as PNG, rows unfiltered."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width * 4)
    body = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 6)

    def chunk(kind: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA8 raster) of an 8-bit, not interlaced PNG: grey, RGB, palette, with or without alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise AssetError("bad_magic", "not a PNG")
    at, parts, head, palette, clear = 8, [], None, None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            if len(part) != 13:
                raise AssetError("bad_png", "a header of the wrong size")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE" and len(part) % 3 == 0:
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            parts.append(part)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise AssetError("bad_png", f"header {head}")
    width, height, _, color = head[:4]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise AssetError("bad_png", str(e)) from None
    if len(raw) < height * (width * n + 1):
        raise AssetError("truncated", "the image data is short")
    above, rows = bytearray(width * n), []
    for y in range(height):
        start = y * (width * n + 1)
        mode, row = raw[start], bytearray(raw[start + 1 : start + 1 + width * n])
        if mode > 4:
            raise AssetError("bad_png", f"filter {mode}")
        if mode == 1:  # sums along each channel
            row = np.cumsum(np.frombuffer(row, np.uint8).reshape(-1, n), axis=0, dtype=np.uint8).tobytes()
        elif mode == 2:
            row = (np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8)).tobytes()
        for i in range(len(row) if mode > 2 else 0):
            a, b = row[i - n] if i >= n else 0, above[i]
            if mode == 3:
                guess = (a + b) // 2
            else:
                c = above[i - n] if i >= n else 0
                guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row[i] = row[i] + guess & 255
        rows.append(bytes(row))
        above = row
    px = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, n)
    if color == 3:
        if palette is None:
            raise AssetError("bad_png", "no palette")
        alpha = np.frombuffer(clear.ljust(len(palette), b"\xff")[: len(palette)], np.uint8)
        if px.max(initial=0) >= len(palette):
            raise AssetError("bad_png", "a colour beyond the palette")
        px = np.concatenate([palette, alpha[:, None]], 1)[px[:, 0]]
    elif color in (0, 4):
        px = np.concatenate([px[:, :1].repeat(3, 1), px[:, 1:]], 1)
    if px.shape[1] == 3:
        px = np.concatenate([px, np.full((len(px), 1), 255, np.uint8)], 1)
    return width, height, px.tobytes()
