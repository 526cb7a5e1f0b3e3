"""LZ4 raw blocks and LZX frames."""

from __future__ import annotations

from .cursor import AssetError


def lz4_decode(data: bytes, size: int) -> bytes:
    """Expands one raw LZ4 block to exactly `size` bytes."""
    out, at, end = bytearray(), 0, len(data)

    def length(n: int) -> int:
        nonlocal at
        while n >= 15:
            more = data[at]
            at += 1
            n += more
            if more < 255:
                break
        return n

    try:
        while at < end:
            token = data[at]
            at += 1
            literals = length(token >> 4)
            if at + literals > end:
                raise AssetError("bad_lz4", "literals run past the end")
            out += data[at : at + literals]
            at += literals
            if at >= end:
                break
            back = data[at] | data[at + 1] << 8
            at += 2
            match = length(token & 15) + 4
            if not 0 < back <= len(out):
                raise AssetError("bad_lz4", f"distance {back} with {len(out)} bytes written")
            if len(out) + match > size:
                raise AssetError("bad_lz4", f"more than {size} bytes")
            start = len(out) - back
            run = bytes(out[start : start + match])
            out += (run * (match // back + 1))[:match]
    except IndexError:
        raise AssetError("truncated", "the LZ4 block ends inside a sequence") from None
    if len(out) != size:
        raise AssetError("size_mismatch", f"{len(out)} bytes where {size} were declared")
    return bytes(out)


def lz4_encode(data: bytes) -> bytes:
    """A raw LZ4 block: greedy matches through a table of four-byte keys; the last five bytes are literals."""
    out, table, at, anchor, n = bytearray(), {}, 0, 0, len(data)

    def tail(count: int) -> bytes:
        """Length bytes after a nibble of 15."""
        if count < 15:
            return b""
        return b"\xff" * ((count - 15) // 255) + bytes([(count - 15) % 255])

    while at < n - 12:
        key = data[at : at + 4]
        seen = table.get(key)
        table[key] = at
        if seen is None or at - seen > 65_535:
            at += 1
            continue
        length = 4
        while at + length < n - 5 and data[seen + length] == data[at + length]:
            length += 1
        literals = at - anchor
        out.append(min(literals, 15) << 4 | min(length - 4, 15))
        out += tail(literals) + data[anchor:at] + (at - seen).to_bytes(2, "little") + tail(length - 4)
        at += length
        anchor = at
    literals = n - anchor
    out.append(min(literals, 15) << 4)
    return bytes(out + tail(literals) + data[anchor:])


class _Bits:
    """Bits of little-endian 16-bit words, the high bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.have = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.have < n:
            word = int.from_bytes(self.data[self.at : self.at + 2], "little") if self.at < len(self.data) else 0
            if self.at > len(self.data) + 4:
                raise AssetError("truncated", "the LZX frame ends inside a block")
            self.at += 2
            self.held = self.held << 16 | word
            self.have += 16

    def peek(self, n: int) -> int:
        self.need(n)
        return self.held >> (self.have - n) & (1 << n) - 1

    def drop(self, n: int) -> None:
        self.have -= n
        self.held &= (1 << self.have) - 1

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek(n)
        self.drop(n)
        return value

    def align(self) -> None:
        """To the next whole word, where raw bytes begin: a full word is skipped when none is open."""
        if self.have == 0:
            self.at += 2
        self.held = self.have = 0


class _Tree:
    """A canonical Huffman code by its lengths; decodes through a map from (length, code)."""

    def __init__(self, lengths: list[int]):
        self.map, code = {}, 0
        self.longest = max(lengths, default=0)
        for n in range(1, self.longest + 1):
            code <<= 1
            for symbol, length in enumerate(lengths):
                if length == n:
                    self.map[n, code] = symbol
                    code += 1
            if code > 1 << n:
                raise AssetError("bad_lzx", "a Huffman code is over-full")

    def take(self, bits: _Bits) -> int:
        code = 0
        for n in range(1, self.longest + 1):
            code = code << 1 | bits.take(1)
            symbol = self.map.get((n, code))
            if symbol is not None:
                return symbol
        raise AssetError("bad_lzx", "no such Huffman code")


class LzxDecoder:
    """LZX as content containers use it: a window of 2^16, state kept over frames, no call translation."""

    WINDOW_BITS = 16
    #: Extra bits and first offset of each position slot: two slots share a count of bits, which grows by one to 17.
    EXTRA = [0, 0] + [min(max(i // 2 - 1, 0), 17) for i in range(2, 52)]
    BASE = [sum((1 << e) for e in ([0, 0] + [min(max(j // 2 - 1, 0), 17) for j in range(2, 52)])[:i]) for i in range(52)]

    def __init__(self):
        self.slots = self.WINDOW_BITS * 2
        self.main = [0] * (256 + self.slots * 8)
        self.lengths = [0] * 249
        self.recent = [1, 1, 1]
        self.out = bytearray()
        self.started = False
        self.kind = self.left = 0
        self.odd = False

    def _lengths(self, bits: _Bits, table: list[int], first: int, last: int) -> None:
        """Code lengths as differences from those before, run-length coded under a tree of twenty symbols."""
        tree = _Tree([bits.take(4) for _ in range(20)])
        at = first
        while at < last:
            symbol = tree.take(bits)
            if symbol == 17 or symbol == 18:
                run = bits.take(4) + 4 if symbol == 17 else bits.take(5) + 20
                values = [0] * run
            elif symbol == 19:
                run = bits.take(1) + 4
                values = [(table[at] - tree.take(bits)) % 17] * run
            else:
                values = [(table[at] - symbol) % 17]
            if at + len(values) > last:
                raise AssetError("bad_lzx", "code lengths run past their table")
            table[at : at + len(values)] = values
            at += len(values)

    def _begin(self, bits: _Bits) -> None:
        if self.odd:
            bits.at += 1
            self.odd = False
        self.kind, self.left = bits.take(3), bits.take(16) << 8 | bits.take(8)
        if self.kind == 3:
            bits.align()
            raw = bits.data[bits.at : bits.at + 12]
            if len(raw) < 12:
                raise AssetError("truncated", "an uncompressed block without its offsets")
            self.recent = [int.from_bytes(raw[i : i + 4], "little") for i in (0, 4, 8)]
            bits.at += 12
            self.odd = self.left % 2 == 1
        elif self.kind in (1, 2):
            self.aligned = _Tree([bits.take(3) for _ in range(8)]) if self.kind == 2 else None
            self._lengths(bits, self.main, 0, 256)
            self._lengths(bits, self.main, 256, len(self.main))
            self.main_tree = _Tree(self.main)
            self._lengths(bits, self.lengths, 0, 249)
            self.length_tree = _Tree(self.lengths)
        else:
            raise AssetError("bad_lzx", f"block type {self.kind}")

    def _distance(self, bits: _Bits, slot: int) -> int:
        recent = self.recent
        if slot < 3:
            recent[0], recent[slot] = recent[slot], recent[0]
            return recent[0]
        extra, value = self.EXTRA[slot], self.BASE[slot] - 2
        if self.aligned and extra >= 3:
            value += bits.take(extra - 3) << 3
            value += self.aligned.take(bits)
        else:
            value += bits.take(extra)
        self.recent = [value, recent[0], recent[1]]
        return value

    def frame(self, data: bytes, size: int) -> bytes:
        """Expands one frame to `size` bytes."""
        bits, start = _Bits(data), len(self.out)
        if not self.started:
            self.started = True
            if bits.take(1):
                raise AssetError("bad_lzx", "call translation is not supported")
        goal = start + size
        while len(self.out) < goal:
            if not self.left:
                self._begin(bits)
            upto = min(goal, len(self.out) + self.left)
            before = len(self.out)
            if self.kind == 3:
                raw = bits.data[bits.at : bits.at + upto - before]
                if len(raw) < upto - before:
                    raise AssetError("truncated", "an uncompressed block is short")
                self.out += raw
                bits.at += len(raw)
            else:
                while len(self.out) < upto:
                    symbol = self.main_tree.take(bits)
                    if symbol < 256:
                        self.out.append(symbol)
                        continue
                    slot, length = divmod(symbol - 256, 8)
                    length = length + 2 if length < 7 else self.length_tree.take(bits) + 9
                    back = self._distance(bits, slot)
                    if not 0 < back <= min(len(self.out), 1 << self.WINDOW_BITS) or len(self.out) + length > goal:
                        raise AssetError("bad_lzx", f"distance {back} or length {length} out of range")
                    run = bytes(self.out[len(self.out) - back : len(self.out) - back + length])
                    self.out += (run * (length // back + 1))[:length]
            self.left -= len(self.out) - before
            if self.left < 0:
                raise AssetError("bad_lzx", "a match crosses the end of its block")
        return bytes(self.out[start:])


def lzx_decode(data: bytes, size: int) -> bytes:
    """Expands framed LZX to exactly `size` bytes.

    A frame begins with 0xFF, its size and its packed size (big-endian, two bytes each), or with its packed size
    alone, and then holds 32,768 bytes. A size of zero ends the stream.
    """
    decoder, at, out = LzxDecoder(), 0, bytearray()
    while at < len(data) and len(out) < size:
        if data[at] == 0xFF:
            frame, packed = int.from_bytes(data[at + 1 : at + 3], "big"), int.from_bytes(data[at + 3 : at + 5], "big")
            at += 5
        else:
            frame, packed = 32_768, int.from_bytes(data[at : at + 2], "big")
            at += 2
        if not frame or not packed:
            break
        if at + packed > len(data):
            raise AssetError("truncated", "an LZX frame runs past the end")
        out += decoder.frame(data[at : at + packed], min(frame, size - len(out)))
        at += packed
    if len(out) != size:
        raise AssetError("size_mismatch", f"{len(out)} bytes where {size} were declared")
    return bytes(out)
