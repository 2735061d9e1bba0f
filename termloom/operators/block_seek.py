"""The exact-term path by bytes: prefix index, floor block, suffix.

Terms that share their first characters form a group, split into floor blocks by the next byte. A transducer per field
leads from a prefix to its group's pointer, the pointer and the target's next byte to one block, and only that block's
suffixes are read. Blocks are rows, found by an equi-join on where they start.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.operators import byte_fst
from termloom.sources import blocks as B

#: Bytes of all prefix transducers that travel with the tasks; beyond, they are joined to the targets.
MOST_INDEX_BYTES = 64 << 20


class Index(NamedTuple):
    """blocks: field, prefix, start, content; prefixes: field, content, start_node, empty_output (one transducer of pointers a field)."""

    blocks: DataFrame
    prefixes: DataFrame


def build(dictionary: DataFrame, length: int = 2, codec: int = 1) -> Index:
    """dictionary: field, term, doc_freq, total_term_freq, singleton_doc; (field, term) unique, terms not null.

    A block holds the terms with one prefix and next byte: choose the prefix length so that these are of bounded number."""

    def block(key: tuple, t: pa.Table) -> pa.Table:
        field, prefix, label = (k.as_py() for k in key)
        cut = len(prefix.encode())
        rows = sorted((term.encode()[cut:], df, ttf, doc) for term, df, ttf, doc in zip(*(t.column(c).to_pylist() for c in ("term", "doc_freq", "total_term_freq", "singleton_doc")), strict=True))
        states, doc_start = [], 0
        for _, df, ttf, doc in rows:
            states.append(B.State(df, ttf, doc_start, doc if df == 1 else None, skip=doc_start if df > B.BLOCK else None))
            doc_start += df if df > 1 else 0
        data = B.block_bytes([r[0] for r in rows], states, codec=codec)
        return pa.table({"field": [field], "prefix": [prefix], "label": pa.array([label], pa.int32()), "content": pa.array([data], pa.binary())})

    next_byte = F.conv(F.hex(F.substring(F.encode(F.expr(f"substring(term, {length + 1})"), "UTF-8"), 1, 1)), 16, 10).cast("int")
    d = dictionary.withColumns({"prefix": F.left("term", F.lit(length)), "label": F.coalesce(next_byte, F.lit(-1))})
    cut = d.select("field", "prefix", "label", "term", "doc_freq", "total_term_freq", "singleton_doc").groupBy("field", "prefix", "label").applyInArrow(block, "field string, prefix string, label int, content binary")
    # At most 257 blocks a prefix.
    w = W.partitionBy("field", "prefix").orderBy("label").rowsBetween(W.unboundedPreceding, -1)
    placed = cut.withColumn("start", F.coalesce(F.sum(F.octet_length("content")).over(w), F.lit(0)).cast("long"))

    def index(key: tuple, t: pa.Table) -> pa.Table:
        floors: dict[bytes, list] = {}
        for prefix, label, start in zip(*(t.column(c).to_pylist() for c in ("prefix", "label", "start")), strict=True):
            floors.setdefault(prefix.encode(), []).append((label, start))
        # Below all labels the first block holds nothing that matches, but it is where the search goes.
        pointers = [(p, B.pointer_bytes([B.Floor(None if not k else label, start) for k, (label, start) in enumerate(sorted(own))])) for p, own in sorted(floors.items())]
        data, start, empty = byte_fst.compiled(pointers, byte_fst.STRINGS)
        return pa.table({"field": [key[0].as_py()], "content": pa.array([data], pa.binary()), "start_node": pa.array([start], pa.int64()), "empty_output": pa.array([empty], pa.binary())})

    prefixes = placed.select("field", "prefix", "label", "start").groupBy("field").applyInArrow(index, "field string, content binary, start_node long, empty_output binary")
    return Index(placed.select("field", "prefix", "start", "content"), prefixes)


def pointed(data: bytes, start_node: int, empty_output: bytes | None, target: str) -> tuple[str, int] | None:
    """(prefix, start of the block) where a target can be: the longest stored prefix, then the floor block of the next byte."""
    raw = target.encode()
    reader = byte_fst.Reader(data, start_node, empty_output, byte_fst.STRINGS)
    path = reader.path(raw)
    while path and not path[-1].final:
        path.pop()
    if not path:
        return None
    n = len(path) - 1
    at = B.find_block(reader.output(path), raw[n] if n < len(raw) else None)
    return None if at is None else (raw[:n].decode(), at)


def seek(targets: DataFrame, meta: DataFrame, index: Index) -> DataFrame:
    """targets (field, target) with in_range, found, doc_freq, total_term_freq, singleton_doc; targets of unknown fields go, others stay.

    meta: field, min_term, max_term. A null target is not found; repeated targets are answered each."""
    spark = targets.sparkSession
    t = targets.join(meta.select("field", "min_term", "max_term"), "field")
    t = t.select("field", "target", F.coalesce(F.col("target").between(F.col("min_term"), F.col("max_term")), F.lit(False)).alias("in_range"))
    small = (index.prefixes.agg(F.sum(F.octet_length("content"))).first()[0] or 0) <= MOST_INDEX_BYTES
    held = spark.sparkContext.broadcast({r.field: (bytes(r.content), r.start_node, r.empty_output and bytes(r.empty_output)) for r in index.prefixes.collect()}) if small else None
    given = t if small else t.join(index.prefixes, "field")

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names = b.schema.names
            own = (held.value.get(f, (b"\0", 0, None)) for f in b.column("field").to_pylist()) if small else zip(*(b.column(n).to_pylist() for n in ("content", "start_node", "empty_output")), strict=True)
            at = [pointed(*x, target) if inside else None for x, target, inside in zip(own, b.column("target").to_pylist(), b.column("in_range").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:3]), pa.array([x and x[0] for x in at], pa.string()), pa.array([x and x[1] for x in at], pa.int64())], names=[*names[:3], "prefix", "start"])

    led = given.mapInArrow(find, "field string, target string, in_range boolean, prefix string, start long")

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            states = [None if data is None else B.seek_in_block(data, 0, target.encode()[len(prefix.encode()) :]) for target, prefix, data in zip(*(b.column(c).to_pylist() for c in ("target", "prefix", "content")), strict=True)]
            made = [pa.array([s is not None for s in states], pa.bool_()), *(pa.array([s and getattr(s, n) for s in states], pa.int64()) for n in ("doc_freq", "total_term_freq", "singleton"))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("field", "target", "in_range")), *made], names=["field", "target", "in_range", "found", "doc_freq", "total_term_freq", "singleton_doc"])

    read = led.join(index.blocks, ["field", "prefix", "start"], "left").select("field", "target", "in_range", "prefix", "content")
    return read.mapInArrow(scan, "field string, target string, in_range boolean, found boolean, doc_freq long, total_term_freq long, singleton_doc long")
