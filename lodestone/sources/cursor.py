"""Reading and writing packed bytes. Used only inside Arrow functions; a plan never sees a cursor."""

from __future__ import annotations

import struct
from functools import lru_cache

#: Compiled patterns, as a file takes the same few again and again.
_pattern = lru_cache(1024)(struct.Struct)


class AssetError(ValueError):
    """A malformed asset: `code` names the kind of fault and becomes the row's _error_code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Reader:
    """Takes values from the front of a byte string; a read past its end is an AssetError("truncated")."""

    def __init__(self, data: bytes, order: str = "<"):
        self.data, self.at, self.order = data, 0, order

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise AssetError("truncated", f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, kinds: str):
        """Values of a struct pattern, packed: one value bare, several as a tuple."""
        pattern = _pattern(self.order + kinds)
        found = pattern.unpack(self.take(pattern.size))
        return found[0] if len(found) == 1 else found

    def jump(self, at: int) -> Reader:
        """A second reader of the same bytes at another place."""
        if not 0 <= at <= len(self.data):
            raise AssetError("bad_offset", f"offset {at} of {len(self.data)}")
        other = Reader(self.data, self.order)
        other.at = at
        return other

    def varint(self) -> int:
        """An unsigned number of at most 32 bits in groups of seven bits, low first."""
        value = 0
        for shift in range(0, 35, 7):
            byte = self.read("B")
            value |= (byte & 127) << shift
            if byte < 128:
                return value
        raise AssetError("bad_varint", f"more than five bytes before {self.at}")

    def text(self, n: int) -> str:
        try:
            return self.take(n).decode("utf-8")
        except UnicodeDecodeError as e:
            raise AssetError("bad_text", str(e)) from None

    def short_text(self) -> str:
        return self.text(self.varint())

    def long_text(self) -> str:
        return self.text(self.read("i"))

    def c_text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise AssetError("truncated", f"no end of text after {self.at}")
        found = self.text(end - self.at)
        self.at = end + 1
        return found

    def padded(self, n: int) -> str:
        """Text in a field of n bytes, without what follows its first zero byte."""
        return self.take(n).split(b"\0", 1)[0].decode("utf-8", "replace")

    def char(self) -> str:
        """One UTF-8 character, as long as its first byte says."""
        first = self.read("B")
        self.at -= 1
        return self.text(1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)


class Writer:
    """Appends what Reader takes."""

    def __init__(self):
        self.data = bytearray()

    def write(self, kinds: str, *values) -> Writer:
        try:
            self.data += _pattern("<" + kinds).pack(*values)
        except struct.error as e:
            raise AssetError("bad_value", f"{values}: {e}") from None
        return self

    def raw(self, data: bytes) -> Writer:
        self.data += data
        return self

    def varint(self, value: int) -> Writer:
        if not 0 <= value < 1 << 32:
            raise AssetError("bad_varint", f"{value} is not an unsigned number of 32 bits")
        while value > 127:
            self.data.append(value & 127 | 128)
            value >>= 7
        self.data.append(value)
        return self

    def short_text(self, text: str) -> Writer:
        data = text.encode()
        return self.varint(len(data)).raw(data)

    def long_text(self, text: str) -> Writer:
        data = text.encode()
        return self.write("i", len(data)).raw(data)
