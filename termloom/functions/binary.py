"""Functions of binary columns: bytes at a place, integers of both byte orders, bit tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.bits import long, reversed_bytes


def get_byte(b: Column, at: Column | int) -> Column:
    """0 to 255; null outside the bytes."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(b, at.cast("int") + 1, F.lit(1))), 16, 10).cast("long")


def slice_bytes(b: Column, start: Column | int, length: Column | int) -> Column:
    start, length = (F.lit(x) if isinstance(x, int) else x for x in (start, length))
    return F.substring(b, start.cast("int") + 1, length.cast("int"))


def byte_values(b: Column) -> Column:
    """The bytes as an array of numbers."""
    return F.transform(F.regexp_extract_all(F.hex(b), F.lit("(..)"), 1), lambda h: F.conv(h, 16, 10).cast("long"))


def read_int(b: Column, at: Column | int, size: int = 4, little: bool = False, signed: bool = True) -> Column:
    """The integer of 4 or 8 bytes from a place on; null if they reach beyond the end."""
    part = slice_bytes(b, at, size)
    raw = F.hex(reversed_bytes(part) if little else part)
    n = F.conv(raw, 16, -10).cast("long")
    if size == 4 and signed:
        n = F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)
    return F.when(F.length(part) == size, n)


def write_int(n: Column, size: int = 4, little: bool = False) -> Column:
    """Two's complement in so many bytes."""
    b = F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * size)))
    return reversed_bytes(b) if little else b


def write_string(s: Column) -> Column:
    """A length of one byte group or more, then UTF-8."""
    from termloom.functions.bits import vint

    raw = F.encode(s, "UTF-8")
    return F.concat(F.unhex(vint(F.octet_length(raw).cast("long"))), raw)


def read_string(b: Column, at: Column | int = 0) -> Column:
    """The string that :func:`write_string` wrote there."""
    at = F.lit(at) if isinstance(at, int) else at
    size = read_vint(b, at)
    return F.decode(slice_bytes(b, at + vint_bytes(b, at), size), "UTF-8")


def vint_bytes(b: Column, at: Column | int = 0) -> Column:
    """Bytes of the variable-length number that starts there: up to the first one below 128."""
    at = F.lit(at) if isinstance(at, int) else at
    rest = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: get_byte(b, at + i))
    return F.array_position(F.transform(rest, lambda x: F.coalesce(x < 128, F.lit(False))), True)


def read_vint(b: Column, at: Column | int = 0) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.transform(F.sequence(long(0), vint_bytes(b, at) - 1), lambda i: F.call_function("shiftleft", get_byte(b, at + i).bitwiseAND(127), (7 * i).cast("int")))
    return F.aggregate(digits, long(0), lambda a, x: a.bitwiseOR(x))


def is_bit_set(table: Column, index: Column | int) -> Column:
    """A bit of a table, lowest first in each byte."""
    index = F.lit(index) if isinstance(index, int) else index
    return F.call_function("shiftright", get_byte(table, F.floor(index / 8)), (index % 8).cast("int")).bitwiseAND(1) == 1


def count_bits(table: Column) -> Column:
    return F.aggregate(byte_values(table), long(0), lambda a, x: a + F.bit_count(x))


def rank(table: Column, index: int) -> Column:
    """Set bits before a bit."""
    whole, odd = divmod(index, 8)
    return count_bits(F.substring(table, F.lit(1), F.lit(whole))) + F.coalesce(F.bit_count(get_byte(table, whole).bitwiseAND((1 << odd) - 1)), F.lit(0))
