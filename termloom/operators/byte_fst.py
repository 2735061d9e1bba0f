"""Finite-state transducers as bytes: minimal, read backwards, with three layouts of nodes.

A node's arcs have a common prefix of their outputs taken out and handed to the arc above, so that outputs stand as
early as they can. Equal nodes are stored once. A node with many arcs is laid out for direct addressing (a bit table of
labels), one with several for binary search, others for a linear scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.sources.cursor import Cursor, blob, varying

#: Flags of an arc, and first bytes of a node that has a table.
FINAL, LAST, TARGET_NEXT, STOP, OUTPUT, FINAL_OUTPUT = 1, 2, 4, 8, 16, 32
BINARY, DIRECT = 32, 64
#: Arcs from which a node gets a table.
MANY = 6


class Algebra(NamedTuple):
    """What outputs are: none, the common part of two, the rest after a common part, joined, and their bytes."""

    none: object
    common: Callable
    less: Callable
    add: Callable
    write: Callable
    read: Callable


def _common(a: bytes, b: bytes) -> bytes:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


NUMBERS = Algebra(0, min, lambda prefix, x: x - prefix, lambda a, b: a + b, lambda n: varying(n, 64), lambda c: c.varying())
STRINGS = Algebra(b"", _common, lambda prefix, x: x[len(prefix) :], lambda a, b: a + b, blob, lambda c: c.blob())


class Arc(NamedTuple):
    """target: where the next node starts; 0 a dead end, -1 an end of a key without arcs."""

    label: int
    target: int
    output: object
    final: bool
    final_output: object


class Writer:
    """Writes nodes, children first; equal nodes once."""

    def __init__(self, algebra: Algebra) -> None:
        self.algebra, self.data, self.known = algebra, bytearray(1), {}
        self.last = 0

    def arc(self, a: Arc, last: bool, label: bool, next_node: int) -> bytes:
        none, write = self.algebra.none, self.algebra.write
        near = a.target > 0 and a.target == next_node
        flags = FINAL * a.final | LAST * last | TARGET_NEXT * near | STOP * (a.target <= 0) | OUTPUT * (a.output != none) | FINAL_OUTPUT * (a.final_output != none)
        out = bytes([flags, a.label]) if label else bytes([flags])
        for x in (a.output, a.final_output):
            out += write(x) if x != none else b""
        return out + (varying(a.target, 64) if a.target > 0 and not near else b"")

    def node(self, arcs: tuple[Arc, ...]) -> int:
        """Where the node starts (its last byte, as it is read backwards)."""
        if arcs in self.known:
            return self.known[arcs]
        if len(arcs) < MANY:
            # Only the last arc's target can follow it.
            out = b"".join(self.arc(a, k + 1 == len(arcs), True, self.last if k + 1 == len(arcs) else 0) for k, a in enumerate(arcs))
        else:
            span = arcs[-1].label - arcs[0].label + 1
            direct = span <= 4 * len(arcs)
            parts = [self.arc(a, k + 1 == len(arcs), not direct, 0) for k, a in enumerate(arcs)]
            size = max(map(len, parts))
            fixed = b"".join(p.ljust(size, b"\0") for p in parts)
            if direct:
                table = sum(1 << (a.label - arcs[0].label) for a in arcs).to_bytes((span + 7) // 8, "little")
                out = bytes([DIRECT]) + varying(span) + varying(size) + table + bytes([arcs[0].label]) + fixed
            else:
                out = bytes([BINARY]) + varying(len(arcs)) + varying(size) + fixed
        self.data += out[::-1]
        self.known[arcs] = self.last = len(self.data) - 1
        return self.last


def compiled(entries: Iterable[tuple[bytes, object]], algebra: Algebra = NUMBERS) -> tuple[bytes, int, object]:
    """(bytes, start node, output of the empty key or None) of sorted entries with unique keys."""
    w = Writer(algebra)
    # Of each open node, from the root: its label, its arcs so far (with whole outputs), and its own key's output.
    path: list[list] = [[0, [], None]]

    def close() -> None:
        label, arcs, own = path.pop()
        every = [a.output for a in arcs] + ([own] if own is not None else [])
        shared = every[0]
        for x in every[1:]:
            shared = algebra.common(shared, x)
        target = w.node(tuple(a._replace(output=algebra.less(shared, a.output)) for a in arcs)) if arcs else -1
        path[-1][1].append(Arc(label, target, shared, own is not None, algebra.none if own is None else algebra.less(shared, own)))

    before = b""
    for key, output in entries:
        if key <= before and len(path) > 1:
            raise ValueError("keys are not sorted or not unique")
        shared = len(_common(before, key))
        while len(path) > shared + 1:
            close()
        path += [[b, [], None] for b in key[shared:]]
        path[-1][2], before = output, key
    while len(path) > 1:
        close()
    start = w.node(tuple(path[0][1])) if path[0][1] else 0
    return bytes(w.data), start, path[0][2]


class Reader:
    """Steps through a transducer."""

    def __init__(self, data: bytes, start: int, empty_output=None, algebra: Algebra = NUMBERS) -> None:
        self.c, self.start, self.algebra, self.empty_output = Cursor(data, backward=True), start, algebra, empty_output

    def first_arc(self) -> Arc:
        """A virtual arc to the root, with the empty key's output."""
        return Arc(-1, self.start, self.algebra.none, self.empty_output is not None, self.algebra.none if self.empty_output is None else self.empty_output)

    def _arc(self, label: int | None) -> tuple[Arc, bool]:
        """The arc at the cursor (its label is stored if it is not given) and whether it is the node's last."""
        c, none = self.c, self.algebra.none
        flags = c.byte()
        label = c.byte() if label is None else label
        output = self.algebra.read(c) if flags & OUTPUT else none
        final_output = self.algebra.read(c) if flags & FINAL_OUTPUT else none
        if flags & STOP:
            target = -1 if flags & FINAL else 0
        else:
            target = c.position if flags & TARGET_NEXT else c.varying()
        return Arc(label, target, output, bool(flags & FINAL), final_output), bool(flags & LAST)

    def arcs(self, node: int) -> Iterator[Arc]:
        """All arcs of a node, by label."""
        if node <= 0:
            return
        c = self.c
        c.position = node
        kind = c.peek()
        if kind not in (BINARY, DIRECT):
            last = False
            while not last:
                arc, last = self._arc(None)
                at = c.position
                yield arc
                c.position = at
            return
        c.skip(1)
        count, size = c.varying(), c.varying()
        labels: list = [None] * count
        if kind == DIRECT:
            table = int.from_bytes(c.take((count + 7) // 8), "little")
            low = c.byte()
            labels = [low + k for k in range(count) if table >> k & 1]
        start = c.at
        for k, label in enumerate(labels):
            c.at = start + k * size
            yield self._arc(label)[0]

    def step(self, node: int, label: int) -> Arc | None:
        """The arc of a node with that label."""
        if node <= 0:
            return None
        c = self.c
        c.position = node
        kind = c.peek()
        if kind == DIRECT:
            c.skip(1)
            count, size = c.varying(), c.varying()
            table, low = int.from_bytes(c.take((count + 7) // 8), "little"), c.byte()
            k = label - low
            if not 0 <= k < count or not table >> k & 1:
                return None
            c.skip(size * (table & ((1 << k) - 1)).bit_count())
            return self._arc(label)[0]
        if kind == BINARY:
            c.skip(1)
            count, size = c.varying(), c.varying()
            start, low, high = c.at, 0, count
            while low < high:
                middle = (low + high) // 2
                c.at = start + middle * size
                found = c.peek(1)
                if found == label:
                    return self._arc(None)[0]
                low, high = (middle + 1, high) if found < label else (low, middle)
            return None
        return next((a for a in self.arcs(node) if a.label == label), None)

    def every(self) -> Iterator[tuple[int, Arc]]:
        """(node, arc) of all nodes that the root reaches, each node once."""
        todo, seen = [self.start], {self.start}
        while todo:
            node = todo.pop()
            for arc in list(self.arcs(node)):
                yield node, arc
                if arc.target > 0 and arc.target not in seen:
                    seen.add(arc.target)
                    todo.append(arc.target)

    def path(self, key: bytes) -> list[Arc]:
        """The arcs from the root's virtual one on, as far as the key goes."""
        out = [self.first_arc()]
        for label in key:
            arc = self.step(out[-1].target, label)
            if arc is None:
                break
            out.append(arc)
        return out

    def output(self, path: list[Arc]):
        """The outputs along a path with its last arc's final output, whether or not a key ends there."""
        out = self.algebra.none
        for a in path:
            out = self.algebra.add(out, a.output)
        return self.algebra.add(out, path[-1].final_output) if path else out

    def accept(self, key: bytes):
        """The key's output; None if it isn't one."""
        path = self.path(key)
        return self.output(path) if len(path) == len(key) + 1 and path[-1].final else None


FST = "content binary, start_node long, empty_output long, entries long"


def build(entries: DataFrame, by: str) -> DataFrame:
    """One transducer of numbers for each value of a column: entries (by, term, output), terms unique within it.

    A group is one task's: choose ``by`` so that its groups are of bounded size."""
    kind = entries.schema[by].dataType.simpleString()

    def group(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip((x.encode() for x in t.column("term").to_pylist()), t.column("output").to_pylist(), strict=True))
        data, start, empty = compiled(rows)
        return pa.table({by: pa.array([key[0].as_py()], t.schema.field(by).type), "content": pa.array([data], pa.binary()), "start_node": pa.array([start], pa.int64()), "empty_output": pa.array([empty], pa.int64()), "entries": pa.array([len(rows)], pa.int64())})

    return entries.select(by, "term", "output").groupBy(by).applyInArrow(group, f"{by} {kind}, {FST}")


def lookup(queries: DataFrame, transducers: DataFrame, by: str) -> DataFrame:
    """by, query, accepted, output: each query against its group's transducer; queries of a group without one are not accepted."""
    kind = queries.schema[by].dataType.simpleString()

    def group(key: tuple, q: pa.Table, t: pa.Table) -> pa.Table:
        reader = Reader(t.column("content")[0].as_py(), t.column("start_node")[0].as_py(), t.column("empty_output")[0].as_py()) if t.num_rows else None
        found = [reader.accept(x.encode()) if reader else None for x in q.column("query").to_pylist()]
        return pa.table({by: q.column(by), "query": q.column("query"), "accepted": pa.array([x is not None for x in found], pa.bool_()), "output": pa.array(found, pa.int64())})

    return queries.select(by, "query").groupBy(by).cogroup(transducers.withColumnRenamed(by, "_by").groupBy("_by")).applyInArrow(group, f"{by} {kind}, query string, accepted boolean, output long")


def root_arcs(transducers: DataFrame, by: str) -> DataFrame:
    """by, label, output, final_output (null where no key ends): the arcs of each transducer's root."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for k, data, start in zip(*(b.column(n).to_pylist() for n in (by, "content", "start_node")), strict=True):
                rows += ((k, a.label, a.output, a.final_output if a.final else None) for a in Reader(data, start).arcs(start))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((b.schema.field(by).type, pa.int64(), pa.int64(), pa.int64()))], names=[by, "label", "output", "final_output"])

    return transducers.mapInArrow(batches, f"{by} {transducers.schema[by].dataType.simpleString()}, label long, output long, final_output long")


def dot_lines(transducers: DataFrame, by: str) -> DataFrame:
    """by, node, line: a line of a DOT graph for every arc of every node."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for k, data, start in zip(*(b.column(n).to_pylist() for n in (by, "content", "start_node")), strict=True):
                for node, a in Reader(data, start).every():
                    mark = f"/{a.final_output}" if a.final else ""
                    rows.append((k, node, f'"{node}" -> "{a.target}" [label="{a.label}/{a.output}{mark}"]'))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((b.schema.field(by).type, pa.int64(), pa.string()))], names=[by, "node", "line"])

    return transducers.mapInArrow(batches, f"{by} {transducers.schema[by].dataType.simpleString()}, node long, line string")


def sharded(df: DataFrame, column: str, shards: int) -> DataFrame:
    """df with a shard, told by a hash of the column."""
    return df.withColumn("shard", F.pmod(F.xxhash64(column), F.lit(shards)))
