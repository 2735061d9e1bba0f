"""N-gram Jaccard join as an exact metric-space join.

Sets of ``ngram``-word shingles link when 100 * common >= percent * union, a bound on the Jaccard distance,
which is a metric. Equal sets form a class and go on as one.

Regions. Over random text the distance to any pivot is almost always near 1, so that Voronoi cells of a few
global pivots would copy every set into every cell. So regions are opened around the sets that a set can
be near at all, which is exact: linked sets have percent of the larger one in common, so under any one order of
all shingles they share one of their first n - ceil(percent * n / 100) + 1. The order goes from rare to
frequent, by a table of counts over all documents, so that passages which many documents quote open no
regions. The sets that share such a key are its region, and the least of them its pivot.

Every set is compared with the pivots of its regions, where sizes and the key's places let a link exist and the
two sets have as many keys in common as a link needs: texts that share a shingle by chance become more with the input,
and their keys tell them apart before their sets are read. A region whose other sets are of one component then is
settled; in what is left (regions with the same sets count once) the pairs of different components are told apart by
sizes, places and keys again, and the pairs that remain, with all sets of a region of very many, make up connected
regions: keys that texts share by chance don't tie them together. A region that a task can hold, by the bytes of its sets, is joined there: pivots are
chosen farthest-first, and only pairs inside the windows that the triangle inequality leaves open,
|d(x, p) - d(y, p)| <= bound for all pivots p, and with a rare shingle in common, are compared. A larger one is cut
into Voronoi cells of new pivots; a set x of cell i is also put into cell j where d(x, pj) - d(x, pi) <= 2 * bound, so
that linked sets meet, and the cells are regions again, recursively. Where cells don't get smaller (all distances
near 1), the region's keys are joined one by one, in tiles of two chunks.

Defined results: a text without words, or null, has an empty set, is linked with nothing and is its own
component; fewer than ``ngram`` words are one shingle; equal texts link; a null id never is the smallest;
an empty table gives no rows. Shingles are compared by 64-bit hashes, pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, leave, scope, small, stored, text_of
from .frequency import bucket_of, frequencies
from .hashing import BASES, mix, run_hash, window_hashes, word_hashes

#: Bytes of the sets of a region that one task joins, and of a tile beyond it.
REGION_BYTES = 24 << 20
#: Cells that a large region is cut into at most.
MOST_CELLS = 32
#: Edges that a task of a components step holds.
TASK_EDGES = 1 << 20
#: Farthest-first pivots of a region.
PIVOTS = 12


def shingle_sets(texts: list[bytes], ngram: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    words, counts = word_hashes(texts, lower=True)
    windows, size = window_hashes(words, counts, ngram)
    at, upto = np.cumsum(size).tolist(), np.cumsum(counts).tolist()
    out = []
    for n, k, hi, top in zip(counts.tolist(), size.tolist(), at, upto, strict=True):
        if k:
            s = np.sort(windows[hi - k : hi])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(run_hash(words[top - n : top]) if n else words[:0])
    return out


class Bound:
    """Which sizes may link."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.ratio = percent / 100

    def links(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (a + b - common)

    def lead(self, n: int) -> int:
        """In any order of the shingles, linked sets share one of so many first ones."""
        return n + (-n * self.percent // 100) + 1

    def possible(self, a: str, b: str) -> Column:
        """Whether sets whose first common shingle is this one may link; a, b: columns of size << 32 | place in the order."""
        n, m, i, j = (F.expr(x) for x in (f"shiftright({a}, 32)", f"shiftright({b}, 32)", f"{a} & 4294967295", f"{b} & 4294967295"))
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & ((100 + self.percent) * F.least(n - i, m - j) >= self.percent * (n + m))

    def enough(self, a: str, b: str) -> Column:
        """Whether sets may link with all keys that they share; a, b: structs of n and own, their shared (place, key) in order.

        Up to their last common key, both lists have all that is common; behind it, and behind the end of the list that
        ends first, there are only the rest of a's and of b's shingles.
        """
        common = f"array_intersect({a}.own.key, {b}.own.key)"
        left = [f"{x}.n - 1 - element_at({x}.own.place, cast(array_position({x}.own.key, element_at({common}, -1)) as int))" for x in (a, b)]
        unread = [f"({self.percent} * {x}.n + 99) div 100 - 1" for x in (a, b)]
        most = f"size({common}) + least({', '.join(left)}, greatest({', '.join(unread)}))"
        return F.expr(f"{100 + self.percent} * ({most}) >= {self.percent} * ({a}.n + {b}.n)")


def keys_of(s: np.ndarray, bound: Bound, levels: np.ndarray) -> np.ndarray:
    """Region keys of a set of hashes: its rarest shingles, rarest first."""
    mixed = mix(s)
    return mixed[np.lexsort((mixed, levels[bucket_of(mixed)]))[: bound.lead(len(s))]]


def set_keys(docs: DataFrame, ngram: int, bound: Bound) -> DataFrame:
    """doc_id, th (hash of the text), n, s1 and s2 (128 bits of the set), keys."""
    # One byte a bucket: 16 MB whatever the input.
    levels = docs.sparkSession.sparkContext.broadcast(frequencies(docs, ngram))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                n, s1, s2, keys = [], [], [], []
                for s in shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), ngram):
                    n.append(len(s))
                    s1.append(int((mix(s).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64)))
                    s2.append(int(mix(s * np.uint64(BASES[1]) + np.uint64(9)).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(keys_of(s, bound, levels.value).view(np.int64) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "n", "s1", "s2", "keys"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(batches, "doc_id long, th long, n long, s1 long, s2 long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, ngram: int, repeated: bool) -> DataFrame:
    """id and shingle hashes of the wanted sets (id, doc, th): one text stands for each, also where several rows are ``repeated``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), ngram)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "hashes"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("th", F.xxhash64("text"))
    # A text's hash and its document together name the row.
    same = rows["doc_id"].eqNullSafe(wanted["doc"]) & (rows["th"] == wanted["th"])
    out = rows.join(small(wanted), same).select("id", "text").mapInArrow(batches, "id long, hashes binary")
    return out.dropDuplicates(["id"]) if repeated else out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) for the ids of the edges that are not the least of their component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        # Roots hang on to smaller ones, then all point to their root.
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root != root[root]).any():
            root = root[root]
    some = root != np.arange(len(ids))
    return ids[some], ids[root[some]]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The edges of each task, without a shuffle, as stars around the least id that they reach there."""

    def stars(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in it]
        if got:
            a, b = forest(*(np.concatenate(x) for x in zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return edges.select("a", "b").coalesce(tasks).mapInArrow(stars, "a long, b long")


def components(edges: DataFrame, name: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, root) for every id of the edges (a, b): root is the least id that it reaches.

    Tasks of some ``task_edges`` edges contract what they hold; where that is more than one, large-star and
    small-star steps follow, until nothing changes. Each step is written to the shared folder.
    """
    e, before = stored(edges.filter("a != b").select("a", "b"), f"{name}-edges"), None
    while True:
        tasks = max(1, -(-e.count() // task_edges))
        e, old = stored(_contracted(e, tasks), f"{name}-edges"), e
        discard(old)
        if tasks == 1:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e, old = stored(small.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges"), e
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.coalesce(F.max("a"), F.lit(0))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        r = self.up
        while (r != r[r]).any():
            r = r[r]
        self.up = r
        return r


def join_region(sets: list[np.ndarray], bound: Bound, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the least set that it reaches by links; known: for each, a lower one that it does. Exact."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    flat, start = np.concatenate(sets), np.cumsum(size) - size
    forest = _Forest(m)
    if known is not None:
        forest.up = known.copy()

    def common(s: np.ndarray, others: np.ndarray) -> np.ndarray:
        if len(others) < m // 2:
            n = size[others]
            at = np.arange(n.sum()) + np.repeat(start[others] - (np.cumsum(n) - n), n)
            values, first = flat[at], np.cumsum(n) - n
        else:
            values, first = flat, start
        hit = s[np.minimum(np.searchsorted(s, values), len(s) - 1)] == values
        got = np.add.reduceat(hit.astype(np.int64), first)
        return got if len(others) < m // 2 else got[others]

    everyone, far, distances, pivot = np.arange(m), np.full(m, 2.0), [], 0
    for _ in range(min(PIVOTS, m)):
        c = common(sets[pivot], everyone)
        d = 1 - c / (size + size[pivot] - c)
        for j in np.flatnonzero(bound.links(c, size, size[pivot])).tolist():
            forest.join(pivot, j)
        distances.append(d)
        far = np.minimum(far, d)
        if (forest.roots() == forest.up[0]).all():
            return forest.up
        pivot = int(far.argmax())
        if far[pivot] == 0:
            break
    near = np.stack(distances, 1)
    # Sets that link share one of their rarest shingles: the first (1 - ratio) * n + 1 in order of frequency.
    value, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(everyone, size)
    order = np.lexsort((inverse, count[inverse], owner))
    rank = np.arange(len(flat)) - np.repeat(start, size)
    lead = np.repeat(size + (-size * bound.percent // 100) + 1, size)
    keep = order[(rank < lead) & (count[inverse[order]] > 1)]
    word, who = inverse[keep], owner[keep]
    by = np.argsort(word, kind="stable")
    word, who = word[by], who[by]
    edges = np.flatnonzero(np.diff(word, prepend=-1))
    ends = np.append(edges[1:], len(word))[: len(edges)]
    groups = [who[a:b] for a, b in zip(edges, ends, strict=True) if b - a > 1]
    of: list[list[int]] = [[] for _ in range(m)]
    for g, members in enumerate(groups):
        for i in members.tolist():
            of[i].append(g)
    roots = forest.roots()
    weight = np.bincount(roots, minlength=m)
    # The sets of small components look for links; two sets of one component need none.
    for i in np.argsort(weight[roots], kind="stable").tolist():
        if not of[i]:
            continue
        roots = forest.roots()
        js = np.unique(np.concatenate([groups[g] for g in of[i]]))
        js = js[(roots[js] != roots[i]) & (np.abs(near[js] - near[i]).max(1) <= 1 - bound.ratio + 1e-9)]
        js = js[100 * np.minimum(size[js], size[i]) >= bound.percent * np.maximum(size[js], size[i])]
        if len(js):
            for j in js[bound.links(common(sets[i], js), size[js], size[i])].tolist():
                forest.join(i, j)
    return forest.roots()


def _region_edges(regions: DataFrame, bound: Bound) -> DataFrame:
    """regions: (region, id, root, hashes). Edges (a, b) that span the links of each region."""

    def region(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids)
        raw, ids = t.column("hashes"), ids[order]
        # Sets of one known component are one from the start.
        _, first, at = np.unique(t.column("root").to_numpy()[order], return_index=True, return_inverse=True)
        roots = join_region([np.frombuffer(raw[i].as_buffer(), np.uint64) for i in order.tolist()], bound, first[at])
        some = roots != np.arange(len(roots))
        return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(ids[roots[some]], pa.int64())})

    return regions.groupBy("region").applyInArrow(region, "a long, b long")


#: Non-pivots of a region whose pairs are told apart by their keys; more make one connected region.
MANY = 1024
#: Pairs whose keys are brought together at a time: some 2 GB.
PAIRS = 1 << 20


def _narrowed(pairs: DataFrame, shared: DataFrame, bound: Bound) -> DataFrame:
    """The pairs (a, b) of ids, stored, that may link by all their keys. shared: id, key, size (n << 32 | place)."""
    ids = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    own = F.sort_array(F.collect_list(F.struct(F.expr("cast(size & 4294967295 as int)").alias("place"), "key"))).alias("own")
    lists = stored(shared.join(small(ids), "id").groupBy("id").agg(F.max(F.expr("shiftright(size, 32)")).alias("n"), own), "key-lists")
    one, two = (lists.select(F.col("id").alias(x), F.struct("n", "own").alias(f"of_{x}")) for x in "ab")
    turns, parts = max(1, -(-pairs.count() // PAIRS)), []
    for k in range(turns):
        some = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == k)
        parts.append(stored(some.join(one, "a").join(two, "b").filter(bound.enough("of_a", "of_b")).select("a", "b"), "likely"))
    discard(ids, lists)
    if turns == 1:
        return parts[0]
    out = stored(reduce(DataFrame.unionByName, parts), "likely")
    discard(*parts)
    return out


#: Sets that meet one copy of their pivot.
SLICE = 2048


def _pair_edges(pairs: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """The pairs (a, b) of ids that link: a's set goes to b's cell, in slices that each have a copy of b's set."""

    def cell(t: pa.Table) -> pa.Table:
        ids, pivot = t.column("id").to_numpy(), t.column("b")[0].as_py()
        raw = t.column("hashes")
        own = np.frombuffer(raw[int(np.flatnonzero(ids == pivot)[0])].as_buffer(), np.uint64)
        found = []
        for i, r in zip(ids.tolist(), raw, strict=True):
            s = np.frombuffer(r.as_buffer(), np.uint64)
            c = np.count_nonzero(own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s)
            if i != pivot and bound.links(c, len(s), len(own)):
                found.append(i)
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([pivot] * len(found), pa.int64())})

    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    members = pairs.join(sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("slices")).cast("int").alias("slice"), F.col("a").alias("id"))
    pivots = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("b").alias("id"))
    places = stored(members.unionByName(pivots), "cells")
    return sets.join(small(places), "id").groupBy("b", "slice").applyInArrow(cell, "a long, b long")


def _cells(large: DataFrame, sets: DataFrame, bound: Bound, limit: int, turn: int) -> DataFrame:
    """Voronoi cells of new pivots in each region. large: region, id, total (bytes of the region).

    Rows (region, id, cell, a): the cells of a set, its own and those that the triangle inequality leaves open, and the
    pivots a that it links with. Sets are dealt in slices of some ``limit`` bytes; each meets all pivots of its region.
    """
    hashed = lambda k: F.xxhash64("id", F.lit(turn), F.lit(k))
    cells = F.least(F.lit(MOST_CELLS), F.ceil(2 * F.col("total") / limit)).cast("int")
    slices = F.ceil(F.col("total") / limit).cast("int")
    pivots = large.withColumn("cell", F.pmod(hashed(0), cells).cast("int")).groupBy("region", "cell").agg(F.min_by("id", hashed(1)).alias("id"), F.max("total").alias("total"))
    pivots = pivots.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).join(sets, "id").select("region", "slice", "cell", "id", "hashes")
    pivots = pivots.select(*[F.col(c).alias(f"p_{c}") for c in pivots.columns])
    members = large.withColumn("slice", F.pmod(hashed(2), slices).cast("int")).join(sets, "id").select("region", "slice", "id", "hashes")
    schema = pa.schema([("region", pa.int64()), ("id", pa.int64()), ("cell", pa.int32()), ("a", pa.int64())])

    def assigned(own: pa.Table, pivots: pa.Table) -> pa.Table:
        order = np.argsort(pivots.column("p_cell").to_numpy())
        sites = [np.frombuffer(pivots.column("p_hashes")[i].as_buffer(), np.uint64) for i in order.tolist()]
        site_ids, names, size = pivots.column("p_id").to_numpy()[order], pivots.column("p_cell").to_numpy()[order], np.array([len(p) for p in sites])
        out: list[tuple] = []
        for region, i, raw in zip(own.column("region").to_pylist(), own.column("id").to_pylist(), own.column("hashes"), strict=True):
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            c = np.array([np.count_nonzero(p[np.minimum(np.searchsorted(p, s), len(p) - 1)] == s) for p in sites])
            d = 1 - c / (size + len(s) - c)
            near = int(d.argmin())
            # A pair of two cells meets in the one of lower number.
            meets = d <= d[near] + 2 * (1 - bound.ratio) + 1e-9
            out += ((region, i, k, None) for k in names[: near + 1][meets[: near + 1]].tolist())
            out += ((region, i, None, a) for a in site_ids[bound.links(c, size, len(s))].tolist() if a != i)
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [[]] * 4, schema=schema)

    return members.groupBy("region", "slice").cogroup(pivots.groupBy("p_region", "p_slice")).applyInArrow(assigned, "region long, id long, cell int, a long")


def _tiled(regions: DataFrame, opened: DataFrame, sets: DataFrame, bound: Bound, limit: int) -> DataFrame:
    """Regions that cells don't make smaller: their open keys one by one, each cut into tiles of two chunks."""
    keys = opened.select("key", "id").join(regions.select("id", "root", "bytes"), "id")
    count = keys.groupBy("key").agg(F.ceil(2 * F.sum("bytes") / limit).cast("int").alias("chunks"))
    cut = keys.join(count, "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), "id", "root")
    return _region_edges(tiles.distinct().join(sets, "id"), bound)


def _both(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def region_links(regions: DataFrame, opened: DataFrame, sets: DataFrame, bound: Bound, limit: int = REGION_BYTES) -> DataFrame:
    """Edges that span the links inside the regions, recursively. regions: region, id, root, bytes; opened: key, id."""
    found, stuck, turn = None, None, 0
    while True:
        sizes = regions.groupBy("region").agg(F.sum("bytes").alias("total"))
        sized = stored(regions.join(sizes, "region"), f"regions-{turn}")
        inside, large = sized.filter(F.col("total") <= limit), sized.filter(F.col("total") > limit)
        found = _both(found, stored(_region_edges(sets.join(small(inside.select("region", "id", "root")), "id"), bound), f"region-links-{turn}"))
        if turn:
            # A cell that holds most of its parent would be cut in vain again.
            held = large.filter("total > 0.7 * parent").select("id", "root", "bytes").distinct()
            if not held.isEmpty():
                stuck = _both(stuck, stored(held, f"stuck-{turn}"))
            large = large.filter("total <= 0.7 * parent")
        if large.isEmpty():
            break
        cells = stored(_cells(large.select("region", "id", "total"), sets, bound, limit, turn), f"cells-{turn}")
        found = found.unionByName(cells.filter("a is not null").select("a", F.col("id").alias("b")))
        regions = cells.filter("cell is not null").select("region", "id", "cell").join(large, ["region", "id"])
        regions = regions.select(F.xxhash64("region", "cell").alias("region"), "id", "root", "bytes", F.col("total").alias("parent"))
        turn += 1
    return found if stuck is None else found.unionByName(_tiled(stuck.distinct(), opened, sets, bound, limit))


def linked(docs: DataFrame, ngram: int, percent: int, limit: int = REGION_BYTES) -> DataFrame:
    """One row per document, stored: row, doc_id, th (hash of the text), n (size of the set), root (a number of its component; null without words)."""
    with scope() as own:
        out = stored(_linked(docs, ngram, percent, limit), "linked")
    leave(own, out)
    return out


def _linked(docs: DataFrame, ngram: int, percent: int, limit: int) -> DataFrame:
    bound = Bound(percent)
    rows = stored(set_keys(docs, ngram, bound).withColumn("row", F.monotonically_increasing_id()), "sets")
    # A class goes by the first of its rows; few bytes of these numbers differ, so they shuffle small.
    classes = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("id"))
    of = stored(rows.select("row", "doc_id", "th", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left").select("row", "doc_id", "th", "n", "id"), "classes")
    # Whether a document's id and its text's hash don't name one row only.
    repeated = not of.filter("n > 0").groupBy("doc_id", "th").agg(F.count("*").alias("copies")).filter("copies > 1").isEmpty()
    copies = stored(of.filter("row != id").select("row"), "copies")
    members = rows.filter("n > 0").join(small(copies), "row", "left_anti").select(F.col("row").alias("id"), "n", F.posexplode("keys").alias("pos", "key"))
    members = members.select("key", "id", F.expr("shiftleft(n, 32) | pos").alias("size"))
    ends = stored(members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key", "low"), "shared-keys")
    shared = stored(members.join(ends, "key").select("key", "id", "size", "low"), "shared")
    discard(rows, copies, ends)

    def sets_for(ids: DataFrame) -> DataFrame:
        wanted = stored(ids.join(of.filter("row = id").select("id", F.col("doc_id").alias("doc"), "th"), "id"), "wanted")
        out = stored(sets_of(docs, wanted, ngram, repeated), "hashes")
        discard(wanted)
        return out

    # Every set meets the pivots of its regions.
    pivots = shared.filter("id = low").select("key", F.col("size").alias("other"))
    pairs = shared.filter("id != low").join(pivots, "key").filter(bound.possible("size", "other"))
    near = stored(pairs.select(F.col("id").alias("a"), F.col("low").alias("b")).distinct(), "pairs")
    pairs = _narrowed(near, shared, bound)
    discard(near)
    sets = sets_for(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    edges = stored(_pair_edges(pairs, sets, bound), "links")
    discard(pairs)
    # What the pivots have not settled: keys with sets of several components. Of keys with the same sets the first one counts.
    roots = components(edges, "linked")
    rest = shared.filter("id != low").select("key", "id", "size").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    regions = rest.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("id").alias("low"), F.min_by("size", "id").alias("at"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2"))
    regions = regions.filter("r1 < r2").groupBy("low", "n", "x1", "x2").agg(F.min_by("key", "at").alias("key"))
    unsettled = stored(rest.join(regions.select("key", "low", "n"), "key").select("key", "id", "root", "low", "n", "size"), "unsettled")
    apart = unsettled.filter(F.col("n") <= MANY).select("key", "id", "root", "size")
    one, two = (apart.select(*[F.col(c).alias(f"{c}_{x}") for c in apart.columns]) for x in "ab")
    # Two sets meet in the first key that they share.
    alike = (F.col("key_a") == F.col("key_b")) & (F.col("id_a") > F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & bound.possible("size_a", "size_b")
    near = stored(one.join(two, alike).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "pairs")
    pairs = _narrowed(near, shared, bound)
    discard(near, shared)
    ties = pairs.unionByName(unsettled.filter(F.col("n") > MANY).select(F.col("id").alias("a"), F.col("low").alias("b")))
    if not ties.isEmpty():
        region = components(ties, "region").withColumnRenamed("root", "region")
        met = stored(region.join(roots, "id", "left").select("region", "id", F.coalesce("root", "id").alias("root")), "open-sets")
        sets = sets.unionByName(sets_for(met.select("id").join(sets.select("id"), "id", "left_anti")))
        sizes = of.filter("row = id").select("id", (8 * F.col("n")).alias("bytes"))
        opened = unsettled.select("key", "id")
        edges = edges.unionByName(region_links(met.join(sizes, "id").select("region", "id", "root", "bytes"), opened, sets, bound, limit))
        roots = components(edges, "linked")
    return of.join(roots, "id", "left").select("row", "doc_id", "th", "n", F.coalesce("root", "id").alias("root"))


def join(docs: DataFrame, ngram: int = 3, percent: int = 90, limit: int = REGION_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    rows = linked(docs, ngram, percent, limit)
    least = rows.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest id; columns unchanged. Documents without words stay.

    Null ids come last, and of rows with one id in one component the one with the smallest text hash stays.
    """
    names = docs.columns
    # Names that no column of docs has.
    k1, k2 = (max([*names, ""], key=len) + end for end in ("_key", "_hash"))
    with scope() as own:
        rows = linked(docs, ngram, percent).filter("n > 0")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first")
        groups = rows.groupBy("root").agg(first, F.count("*").alias("members")).filter("members > 1")
        verdicts = stored(rows.join(groups, "root").select(F.col("doc_id").alias(k1), F.col("th").alias(k2), F.expr("doc_id <=> first.doc_id and th = first.th").alias("keep")), "verdicts")
        gone = stored(verdicts.filter("not keep").select(k1, k2).distinct(), "gone")
        # Rows with the id and the text of the one that stays.
        repeated = stored(verdicts.filter("keep").groupBy(k1, k2).agg(F.count("*").alias("copies")).filter("copies > 1").select(k1, k2), "repeated")
    leave(own, gone, repeated)
    doc_id, text_hash = docs["doc_id"].cast("long"), F.xxhash64(text_of(docs))
    same = lambda t: doc_id.eqNullSafe(t[k1]) & (text_hash == t[k2])
    # What goes is the smaller part: where it is small, no text is shuffled.
    gone_ = small(gone)
    kept = docs.join(gone_, same(gone_), "left_anti").select(*[docs[c] for c in names])
    if repeated.isEmpty():
        return kept
    once = docs.join(repeated, same(repeated)).dropDuplicates([k1, k2]).select(*[docs[c] for c in names])
    return docs.join(gone_, same(gone_), "left_anti").join(repeated, same(repeated), "left_anti").select(*[docs[c] for c in names]).unionByName(once)
