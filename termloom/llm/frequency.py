"""A table of shingle frequencies of fixed size, counted over all documents.

A shingle's bucket is the top ``BITS`` bits of its mixed hash. Tasks count into a table of their own and hand
on its filled buckets by slices, which are added up in rounds of ``FAN`` tables each, so that no task ever holds more than
``FAN`` slices. What is left is one byte a bucket, on a logarithmic scale: 16 MB at any size of input.

Counts only order shingles from rare to frequent. Any order gives exact joins; with more shingles than
buckets it tells only frequent shingles from the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .hashing import mix, window_hashes, word_hashes

BITS, SLICES, FAN = 24, 256, 64
WIDTH = (1 << BITS) // SLICES
#: Hashes that a task gathers before it counts them.
BUFFER = 1 << 20


def bucket_of(mixed: np.ndarray) -> np.ndarray:
    return mixed >> np.uint64(64 - BITS)


def pack(counts: np.ndarray) -> bytes:
    """Gaps between filled buckets and their counts, byte plane by byte plane."""
    at = np.flatnonzero(counts)
    both = np.stack([np.diff(at, prepend=-1), np.minimum(counts[at], 0xFFFFFFFF)]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes(), 1)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(filled buckets, counts) of a packed slice."""
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(2, 4, -1)
    gaps, counts = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0].astype(np.int64)
    return np.cumsum(gaps) - 1, counts


def added(slices: list[bytes]) -> np.ndarray:
    total = np.zeros(WIDTH, np.int64)
    for raw in slices:
        at, counts = unpack(raw)
        total[at] += counts
    return total


def frequencies(docs: DataFrame, ngram: int) -> np.ndarray:
    """One byte a bucket: 8 * log2(1 + count), rounded up."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = np.zeros(1 << BITS, np.uint32), [], 0

        def settle() -> None:
            bucket, times = np.unique(np.concatenate(held), return_counts=True)
            table[bucket] += times.astype(np.uint32)
            held.clear()

        for b in it:
            for lo in range(0, b.num_rows, 500):
                words, counts = word_hashes(b.slice(lo, 500).column("text").cast(pa.binary()).to_pylist(), lower=True)
                held.append(bucket_of(mix(window_hashes(words, counts, ngram)[0])).astype(np.uint32))
                n += len(held[-1])
                if n >= BUFFER:
                    settle()
                    n = 0
        if n:
            settle()
        part = TaskContext.get().partitionId() // FAN
        for k, own in enumerate(table.reshape(SLICES, WIDTH)):
            if own.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "part": pa.array([part], pa.int64()), "counts": pa.array([pack(own)], pa.binary())})

    def merged(t: pa.Table) -> pa.Table:
        return pa.table({"slice": t.column("slice")[:1], "part": t.column("part")[:1], "counts": pa.array([pack(added(t.column("counts").to_pylist()))], pa.binary())})

    def levels(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [np.ceil(8 * np.log2(1 + added([raw]))).astype(np.uint8).tobytes() for raw in b.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("slice"), pa.array(out, pa.binary())], names=["slice", "levels"])

    rows = docs.select(text_of(docs).alias("text")).mapInArrow(count, "slice int, part long, counts binary")
    while True:
        rows = stored(rows.groupBy("slice", "part").applyInArrow(merged, "slice int, part long, counts binary"), "frequencies")
        if not rows.agg(F.max("part")).first()[0]:
            break
        rows = rows.withColumn("part", F.expr(f"part div {FAN}"))
    out = np.zeros((SLICES, WIDTH), np.uint8)
    for k, raw in rows.mapInArrow(levels, "slice int, levels binary").collect():
        out[k] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1)
