"""Integers, bit fields and strings out of binary columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def le_uint(content: Column | str, offset: int, size: int) -> Column:
    """Unsigned little-endian integer of `size` bytes (1 to 7) at a byte offset; null where the bytes end before."""
    content = F.col(content) if isinstance(content, str) else content
    digits = F.concat(*[F.hex(F.substring(content, offset + 1 + i, 1)) for i in reversed(range(size))])
    return F.when(F.octet_length(content) >= offset + size, F.conv(digits, 16, 10).cast("long"))


def be_uint(content: Column | str, offset: int, size: int) -> Column:
    """Unsigned big-endian integer of `size` bytes (1 to 7) at a byte offset."""
    content = F.col(content) if isinstance(content, str) else content
    own = F.substring(content, offset + 1, size)
    return F.when(F.octet_length(own) == size, F.conv(F.hex(own), 16, 10).cast("long"))


def le_int(content: Column | str, offset: int, size: int) -> Column:
    """Signed little-endian integer of `size` bytes (1 to 4)."""
    value = le_uint(content, offset, size)
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)


def ascii_at(content: Column | str, offset: int, size: int) -> Column:
    """`size` bytes as a string."""
    content = F.col(content) if isinstance(content, str) else content
    return F.decode(F.substring(content, offset + 1, size), "ISO-8859-1")


def bits(value: Column, low: int, width: int) -> Column:
    """`width` bits of an integer from bit `low` on."""
    return F.shiftright(value, low).bitwiseAND(F.lit((1 << width) - 1))


def varint_size(value: Column) -> Column:
    """Bytes of a number in 7-bit groups; null for negative numbers, which the encoding has no form for."""
    expr = F.when(value < 0, F.lit(None).cast("int"))
    for n in range(1, 9):
        expr = expr.when(value < (1 << (7 * n)), n)
    return expr.otherwise(9)


def varint_at(content: Column, offset: Column) -> Column:
    """struct<value, size> of a number in 7-bit groups at a byte offset (five groups at most)."""
    each = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.conv(F.hex(F.substring(content, offset + 1 + i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("size"), F.lit(False).alias("over"))

    def step(s: Column, b: Column) -> Column:
        added = s["value"] + b.bitwiseAND(F.lit(127)) * F.pow(F.lit(128), s["size"]).cast("long")
        return F.when(s["over"] | b.isNull(), s).otherwise(F.struct(added.alias("value"), (s["size"] + 1).alias("size"), (b < 128).alias("over")))

    return F.aggregate(each, start, step, lambda s: F.struct(s["value"].alias("value"), s["size"].alias("size")))
