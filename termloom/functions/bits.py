"""Bit, byte and variable-length integer functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long(n: int) -> Column:
    return F.lit(n).cast("long")


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(1)))


def msb(n: Column) -> Column:
    """Number of the highest set bit from 1; 0 for 0. For non-negative numbers."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n))).cast("long")


def rank(n: Column, upto: int) -> Column:
    """Set bits below bit upto."""
    return F.bit_count(n.bitwiseAND((1 << upto) - 1)).cast("long")


def binary(n: Column, width: int) -> Column:
    """Two's complement digits."""
    return F.lpad(F.bin(n.bitwiseAND((1 << width) - 1) if width < 64 else n), width, "0")


def hex_pairs(b: Column) -> Column:
    """Upper-case pairs, each with a blank behind it."""
    return F.regexp_replace(F.hex(b), "(..)", "$1 ")


def byte_list(b: Column) -> Column:
    """'[ 1; 2 ]'."""
    values = F.transform(F.regexp_extract_all(F.hex(b), F.lit("(..)"), 1), lambda h: F.conv(h, 16, 10))
    return F.concat(F.lit("[ "), F.array_join(values, "; "), F.lit(" ]"))


def reversed_bytes(b: Column) -> Column:
    """The bytes in opposite order (reverse() would work on characters)."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(b), F.lit("(..)"), 1)), ""))


def vint_length(n: Column) -> Column:
    """Bytes of a number in groups of seven bits; a negative one is taken as 32 bits and has five."""
    return F.when(n < 0, long(5)).otherwise(F.greatest(long(1), F.ceil(msb(n) / 7))).cast("long")


def vint(n: Column) -> Column:
    """The bytes of a number, low groups first, as hexadecimal digits; a negative one is taken as 32 bits."""
    n = F.when(n < 0, n.bitwiseAND(long(0xFFFFFFFF))).otherwise(n)
    groups = F.transform(F.sequence(long(0), vint_length(n) - 1), lambda i: F.call_function("shiftrightunsigned", n, (i * 7).cast("int")).bitwiseAND(127) + F.when(i < vint_length(n) - 1, 128).otherwise(0))
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.hex(g), 2, "0")), "")


def unvint(digits: Column) -> Column:
    """The number that :func:`vint` wrote."""
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), 1)
    parts = F.transform(pairs, lambda h, i: F.call_function("shiftleft", F.conv(h, 16, 10).cast("long").bitwiseAND(127), (i * 7).cast("int")))
    return F.aggregate(parts, long(0), lambda a, x: a.bitwiseOR(x))


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))
    return F.array_max(same).cast("long")


def packed_long(items: Column, bits: int) -> Column:
    """Numbers of so many bits in one long, the first one highest."""
    return F.aggregate(items, long(0), lambda a, x: F.shiftleft(a, bits).bitwiseOR(x))


def unpacked_long(word: Column, bits: int, count: int) -> Column:
    return F.transform(F.sequence(F.lit(count - 1), F.lit(0)), lambda i: F.call_function("shiftrightunsigned", word, i * bits).bitwiseAND((1 << bits) - 1))


def chunks(items: Column, size: int) -> Column:
    """Pieces of an array; the last may be short, an empty array gives one empty piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda i: F.slice(items, i, size))


def flag(n: Column, mask: int) -> Column:
    return n.bitwiseAND(mask) != 0


def set_flag_if(condition: Column, mask: int) -> Column:
    """The flag, or nothing."""
    return F.when(condition, mask).otherwise(0).cast("long")


#: Fixed value: the multiplier of the match finder's hash.
HASH_FACTOR = 2654435761


def match_hash(n: Column, bits: int) -> Column:
    """The highest bits of the low 32 of n times the multiplier, taken by halves, so that nothing overflows."""
    n = n.bitwiseAND(long(0xFFFFFFFF))
    high = F.shiftleft((n * (HASH_FACTOR >> 16)).bitwiseAND(0xFFFF), 16)
    return F.shiftright((high + n * (HASH_FACTOR & 0xFFFF)).bitwiseAND(long(0xFFFFFFFF)), 32 - bits)
