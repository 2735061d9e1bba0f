"""Byte and integer block codecs, on whole Arrow batches where bytes must be built.

Where published formats and known readers disagree, the documented format holds: exceptions of patched
frames are prefixes that are joined to the stored low bits, a match may overlap what it writes, and the bytes that only
bridge a gap of 255 or more between exceptions count as exceptions.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from termloom.sources.cursor import Cursor, varying

BLOCK = 128


def compressable(b: np.ndarray) -> np.ndarray:
    """Bytes of [0x1F, 0x3F) and [0x5F, 0x7F): those that six bits tell apart."""
    return ((b >= 0x1F) & (b < 0x3F)) | ((b >= 0x5F) & (b < 0x7F))


def shrink(b: np.ndarray) -> np.ndarray:
    """Eight bits to six; the sixth tells the range."""
    up = b.astype(np.uint16) + 1
    return ((up & 0x1F) | (up & 0x40) >> 1).astype(np.uint8)


def unshrink(b: np.ndarray) -> np.ndarray:
    return (((b & 0x20) << 1 | 0x20 | (b & 0x1F)) - 1).astype(np.uint8)


def ascii_exceptions(b: np.ndarray) -> np.ndarray:
    """Places of the bytes that stand apart, with one after every 255 bytes without any before the next."""
    odd = np.flatnonzero(~compressable(b))
    gap = np.diff(odd, prepend=0)
    bridges = np.maximum(gap - 1, 0) // 255
    if not bridges.any():
        return odd
    size = bridges + 1
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    before = np.repeat(odd - gap, size)
    return np.where(step == np.repeat(bridges, size), np.repeat(odd, size), before + 255 * (step + 1))


def ascii_compress(data: bytes) -> bytes:
    """Six bits a byte: the last quarter's go into the two high bits of the first three; then the exceptions."""
    b = np.frombuffer(data, np.uint8)
    six, quarter = shrink(b), len(b) // 4
    kept = six[: len(b) - quarter].copy()
    last = six[len(b) - quarter :]
    for part, shift in enumerate((4, 2, 0)):
        kept[part * quarter : (part + 1) * quarter] |= (last >> shift & 3) << 6
    odd = ascii_exceptions(b)
    pairs = np.stack([np.diff(odd, prepend=0).astype(np.uint8), b[odd]], 1)
    return kept.tobytes() + varying(len(odd)) + pairs.tobytes()


def ascii_decompress(c: Cursor, length: int) -> bytes:
    quarter = length // 4
    kept = np.frombuffer(c.take(length - quarter), np.uint8)
    parts = [kept[k * quarter : (k + 1) * quarter] >> 6 for k in range(3)]
    last = parts[0] << 4 | parts[1] << 2 | parts[2]
    out = unshrink(np.concatenate([kept & 0x3F, last]))
    count = c.varying()
    pairs = np.frombuffer(c.take(2 * count), np.uint8).reshape(-1, 2)
    out[np.cumsum(pairs[:, 0], dtype=np.int64)] = pairs[:, 1]
    return out.tobytes()


#: Fixed values of the LZ4 block format: the last match starts so many bytes before the end at least.
MIN_MATCH, LAST_LITERALS, LAST_START, FARTHEST, HASH_FACTOR = 4, 5, 12, 65535, 2654435761


def lz4_hash(words: np.ndarray, bits: int = 16) -> np.ndarray:
    return (words * np.uint64(HASH_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


def _length(n: int) -> bytes:
    """What a length has beyond the nibble's 15."""
    return b"" if n < 15 else b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])


def matches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a match of the four bytes there starts, how far back it lies, and where it ends.

    The last place before with the same hash is tried, found for all places at once. A match goes on as far as
    the places behind it lead equally far back."""
    end = len(data) - LAST_START
    none = np.zeros(0, np.int64)
    if end < 0:
        return none, none, none
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    words = b[:-3] << np.uint64(24) | b[1:-2] << np.uint64(16) | b[2:-1] << np.uint64(8) | b[3:]
    hashed = lz4_hash(words)
    order = np.argsort(hashed, kind="stable")
    before = np.full(len(words), -1)
    same = hashed[order[1:]] == hashed[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    places = np.arange(len(words))
    good = (before >= 0) & (places - before <= FARTHEST) & (words == words[before])
    at = np.flatnonzero(good)
    back = at - before[at]
    # The last place of each run of neighbours that lead equally far back.
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(back) != 0))
    last = np.append(breaks, len(at) - 1)[np.searchsorted(breaks, np.arange(len(at)), "left")] if len(at) else none
    stop = np.minimum(at[last] + MIN_MATCH, len(data) - LAST_LITERALS)
    some = (at <= end) & (stop - at >= MIN_MATCH)
    return at[some], back[some], stop[some]


def lz4_compress(data: bytes) -> bytes:
    """An LZ4 block: from left to right, each match that starts behind the one before."""
    out, done = bytearray(), 0
    starts, backs, stops = (x.tolist() for x in matches(data))
    k = 0
    while k < len(starts):
        at, stop = starts[k], stops[k]
        literals, n = at - done, stop - at - MIN_MATCH
        if literals < 15 and n < 15:
            out.append(literals << 4 | n)
            out += data[done:at]
            out += backs[k].to_bytes(2, "little")
        else:
            out.append(min(literals, 15) << 4 | min(n, 15))
            out += _length(literals) + data[done:at] + backs[k].to_bytes(2, "little") + _length(n)
        done = stop
        k = bisect.bisect_left(starts, done, k + 1)
    literals = len(data) - done
    out.append(min(literals, 15) << 4)
    return bytes(out + _length(literals) + data[done:])


def lz4_decompress(c: Cursor, length: int) -> bytes:
    """An LZ4 block of so many bytes."""
    out, data, at = bytearray(), bytes(c.data), c.at
    while True:
        token = data[at]
        at += 1
        n = token >> 4
        if n == 15:
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        out += data[at : at + n]
        at += n
        if len(out) >= length:
            break
        back = data[at] | data[at + 1] << 8
        at, n = at + 2, token & 15
        if n == 15:
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        n += MIN_MATCH
        if back >= n:
            start = len(out) - back
            out += out[start : start + n]
        else:  # it reads what it writes
            piece = out[-back:]
            out += (piece * (n // back + 1))[:n]
    c.at = at
    if len(out) != length:
        raise ValueError("wrong length")
    return bytes(out)


class Codec(NamedTuple):
    name: str
    compress: Callable[[bytes], bytes]
    decompress: Callable[[Cursor, int], bytes]


#: By the code that a block names.
CODECS = {0: Codec("none", lambda data: data, lambda c, n: c.take(n)), 1: Codec("lowercase_ascii", ascii_compress, ascii_decompress), 2: Codec("lz4", lz4_compress, lz4_decompress)}


def codec(code: int) -> Codec:
    """The codec of a code; an unknown code raises."""
    if code not in CODECS:
        raise ValueError(f"unknown codec {code}")
    return CODECS[code]


def lane_masks(width: int) -> list[int]:
    """For 1 to width bits, a 64-bit word whose lanes of that width have the low bits set; first none."""
    ones = sum(1 << k for k in range(0, 64, width))
    return [ones * ((1 << bits) - 1) for bits in range(width + 1)]


def lane_width(bits: int) -> int:
    if not 1 <= bits <= 32:
        raise ValueError("1 to 32 bits")
    return 8 if bits <= 8 else 16 if bits <= 16 else 32


def spilled(values: np.ndarray, bits: int, room: int) -> np.ndarray:
    """Numbers of so many bits (last axis) cut anew into numbers of ``room`` bits, high bits first."""
    digits = values[..., None] >> np.arange(bits - 1, -1, -1) & 1
    flat = digits.reshape(*values.shape[:-1], -1)
    cut = flat.reshape(*values.shape[:-1], -1, room)
    return cut @ (1 << np.arange(room - 1, -1, -1))


def pack_lanes(values: np.ndarray, bits: int) -> np.ndarray:
    """Blocks of 128 numbers (one a row) in 2 * bits words each: lanes side by side, the first lane highest."""
    width = lane_width(bits)
    lanes, words, full = 64 // width, 2 * bits, width // bits
    m = values.astype(np.int64).reshape(len(values), lanes, -1)
    held = np.zeros((len(values), lanes, words), np.int64)
    for k in range(full):
        held |= m[:, :, k * words : (k + 1) * words] << (width - bits * (k + 1))
    room = width - bits * full
    if room:
        held |= spilled(m[:, :, full * words :], bits, room)
    shift = np.arange(64 - width, -1, -width, dtype=np.uint64)
    return np.bitwise_or.reduce(held.astype(np.uint64) << shift[None, :, None], 1)


def unpack_lanes(words: np.ndarray, bits: int) -> np.ndarray:
    width = lane_width(bits)
    lanes, full = 64 // width, width // bits
    shift = np.arange(64 - width, -1, -width, dtype=np.uint64)
    held = (words[:, None, :] >> shift[None, :, None] & np.uint64((1 << width) - 1)).astype(np.int64)
    parts = [held >> (width - bits * (k + 1)) & ((1 << bits) - 1) for k in range(full)]
    room = width - bits * full
    if room:
        parts.append(spilled(held & ((1 << room) - 1), room, bits))
    return np.concatenate(parts, 2).reshape(len(words), BLOCK)


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of non-negative numbers below 2^52."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pfor_plan(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Width, number of exceptions, and whether no number has more than eight bits and all low bits are one number, for each block (row of 128).

    At most seven numbers exceed the width, each by at most eight bits."""
    top = np.sort(values, 1)
    need = bit_length(top[:, [-8, -1]])
    bits = np.maximum(1, np.maximum(need[:, 0], need[:, 1] - 8))
    low = values & ((1 << bits) - 1)[:, None]
    return bits, (values >> bits[:, None] > 0).sum(1), (need[:, 1] <= 8) & (low == low[:, :1]).all(1)


def pfor_encode(values: np.ndarray) -> list[bytes]:
    """Each block (row of 128): a byte of width and exceptions, the low bits in lanes, then place and high bits of each exception.

    Where all low bits are one number and none has more than eight bits, the width is 0, that number follows, and
    the exceptions' high bits stand in their places."""
    bits, odd, equal = pfor_plan(values)
    out: list[bytes] = [b""] * len(values)
    for b in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == b)
        words = pack_lanes(values[rows] & ((1 << b) - 1), b).astype("<u8")
        for r, w in zip(rows.tolist(), words, strict=True):
            high = values[r] >> b
            places = np.flatnonzero(high)
            patches = np.stack([places, high[places] << (b if equal[r] else 0)], 1).astype(np.uint8).tobytes()
            if equal[r]:
                out[r] = bytes([len(places) << 5]) + varying(int(values[r, 0]) & ((1 << b) - 1)) + patches
            else:
                out[r] = bytes([b | len(places) << 5]) + w.tobytes() + patches
    return out


def pfor_decode(blocks: list[bytes]) -> np.ndarray:
    """The blocks, 128 numbers a row."""
    out = np.zeros((len(blocks), BLOCK), np.int64)
    width = np.array([b[0] & 31 for b in blocks])
    for bits in np.unique(width).tolist():
        rows = np.flatnonzero(width == bits)
        if bits:
            words = np.frombuffer(b"".join(blocks[r][1 : 1 + 16 * bits] for r in rows.tolist()), "<u8").reshape(len(rows), 2 * bits)
            out[rows] = unpack_lanes(words, bits)
        for r in rows.tolist():
            c = Cursor(blocks[r], start=1 + 16 * bits)
            if not bits:
                out[r] = c.varying()
            patches = np.frombuffer(c.take(2 * (blocks[r][0] >> 5)), np.uint8).reshape(-1, 2).astype(np.int64)
            out[r, patches[:, 0]] |= patches[:, 1] << bits
    return out


def encode_deltas(values: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    """Differences of sorted numbers to the one before, the first to base, and the bits that hold them all."""
    deltas = np.diff(values, prepend=base)
    return deltas, int(bit_length(np.bitwise_or.reduce(deltas, keepdims=True))[0]) if len(deltas) else 0


def decode_deltas(deltas: np.ndarray, base: int) -> np.ndarray:
    return base + np.cumsum(deltas)


def round_trips(df: DataFrame, column: str) -> DataFrame:
    """df with, for each byte codec, the size of the compressed bytes and the SHA-256 of what they give back; null bytes stay null."""
    own = [(f"{c.name}_{what}", kind) for c in CODECS.values() for what, kind in (("bytes", T.LongType()), ("sha256", T.StringType()))]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made: dict[str, list] = {n: [] for n, _ in own}
            for data in b.column(column).to_pylist():
                for c in CODECS.values():
                    packed = None if data is None else c.compress(data)
                    made[f"{c.name}_bytes"].append(None if data is None else len(packed))
                    made[f"{c.name}_sha256"].append(None if data is None else hashlib.sha256(c.decompress(Cursor(packed), len(data))).hexdigest())
            rest = [b.column(n) for n in b.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(made[n], to_arrow_type(k)) for n, k in own)], names=[*(n for n in b.schema.names if n != column), *made])

    # A small table may lie in fewer partitions than there are cores; a large one is read where it lies.
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df.mapInArrow(batches, T.StructType([f for f in df.schema.fields if f.name != column] + [T.StructField(n, k) for n, k in own]))


def packed_blocks(df: DataFrame, column: str) -> DataFrame:
    """df with, for each block (an array of 128 numbers), its patched frame's first byte and size and the numbers that come back."""
    fields = [T.StructField("token", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("back", T.ArrayType(T.LongType()))]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            values = b.column(column).flatten().to_numpy().reshape(-1, BLOCK)
            blocks = pfor_encode(values)
            back = pa.FixedSizeListArray.from_arrays(pa.array(pfor_decode(blocks).reshape(-1), pa.int64()), BLOCK).cast(pa.list_(pa.int64()))
            rest = [b.column(n) for n in b.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x[0] for x in blocks], pa.int64()), pa.array([len(x) for x in blocks], pa.int64()), back], names=[*(n for n in b.schema.names if n != column), "token", "bytes", "back"])

    return df.mapInArrow(batches, T.StructType([f for f in df.schema.fields if f.name != column] + fields))
