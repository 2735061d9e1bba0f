"""Removal of repeated word windows by a log-structured fingerprint index.

The index holds the windows of ``width`` words of all documents added so far, as 96-bit digests (two independent hashes
of the words), sorted, in buckets by their leading bits. Documents come in batches, in the order of their ids. A batch is
dealt by ranges of ids, and every range is cut into immutable runs of some ``RUN_BYTES`` of text: a run's
distinct digests are sorted once and sent to their buckets. There they are merged with the index: a window
is repeated if an equal one is in the index or in a run before. What goes back is one bit for each digest of a run, in
the run's order, so the range's documents, read again, know their windows without any address being sent. The same
merge writes the compacted index of the next batch.

Equality is that of both hashes: the second one, from its own tables, verifies what the first one finds.

Defined results: a null text has no words; a null id is left as it is and removes nothing; rows that share an id don't
remove each other's words, however many they are; a very long text is a run of its own; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, text_of
from .hashing import span_hashes, split_texts, window_hashes

WIDTH = 13
#: Bytes of text of a run at most (a text is never split), and of a range of ids about.
RUN_BYTES = 6 << 20
#: Batches that the documents are added in.
BATCHES = 3
#: Ranges of ids of a batch at most; larger ranges have more runs.
MOST_PARTS = 4096
_CODEC = pa.Codec("zstd", compression_level=1)

RUNS = "bucket int, run long, label long, n long, blob binary"
REPLIES = "part long, run long, bucket int, n long, bits binary, blob binary"
ROWS = "part long, doc_id long, th long, size long, blob binary"


def squeezed(raw: bytes) -> bytes:
    return _CODEC.compress(raw, asbytes=True) if raw else b""


def digests(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hashes, second hashes, number of windows of each text, number of words of each text)."""
    words: list[list[np.ndarray]] = [[], []]
    counts = []
    for raw, start, end, count in split_texts(texts):
        for family in (0, 1):
            words[family].append(span_hashes(raw, start, end, family))
        counts.append(count)
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.concatenate(counts)
    h, size = window_hashes(np.concatenate(words[0]), count, width, 0)
    check, _ = window_hashes(np.concatenate(words[1]), count, width, 1)
    return h, (check >> np.uint64(32)).astype(np.uint32), size, count


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers, all lowest bytes first, so that equal high bytes compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: memoryview, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n).reshape(size, n).T).view(kind)[:, 0]


def packed(h: np.ndarray, check: np.ndarray) -> bytes:
    """Sorted digests: first hashes as differences."""
    return _CODEC.compress(_planes(np.diff(h, prepend=np.uint64(0)).astype("<u8")), asbytes=True) + _planes(check.astype("<u4"))


def unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = memoryview(_CODEC.decompress(blob[: len(blob) - 4 * n], 8 * n, asbytes=True))
    return np.cumsum(_unplanes(raw, n, "<u8"), dtype=np.uint64), _unplanes(memoryview(blob)[len(blob) - 4 * n :], n, "<u4")


class Run:
    """Documents of a range in the order of their ids, with the sorted distinct digests of their windows."""

    def __init__(self, number: int, label: int, ids: list[int], texts: list[bytes], width: int) -> None:
        self.number, self.label, self.ids, self.texts = number, label, ids, texts
        h, check, self.size, self.words = digests(texts, width)
        order = np.lexsort((check, h))
        h, check = h[order], check[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        self.h, self.check = h[new], check[new]
        #: Of each window, in the order of the texts, its digest's place.
        self.at = np.empty(len(h), np.int64)
        self.at[order] = np.cumsum(new) - 1

    def repeated(self, known: np.ndarray) -> np.ndarray:
        """Of each window, whether it starts in a document with a smaller id: known tells of each digest if a run before has it."""
        owner = np.repeat(np.array(self.ids, np.int64), self.size)
        least = np.full(len(self.h), np.iinfo(np.int64).max)
        np.minimum.at(least, self.at, owner)
        return known[self.at] | (owner > least[self.at])


def runs_in(rows: Iterator[tuple[int, int, bytes]], width: int, limit: int) -> Iterator[tuple[int, Run]]:
    """(part, run) of rows (part, doc_id, text) in order. Rows of one id stay together, or have runs of one label for themselves."""
    part, sub, label, spanning = None, 0, 0, None
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def run(n: int, own: int) -> Run:
        nonlocal ids, texts, size, sub
        out = Run(part << 24 | sub, own, ids[:n], texts[:n], width)
        ids, texts, sub = ids[n:], texts[n:], sub + 1
        size = sum(map(len, texts))
        return out

    for p, i, t in rows:
        if ids and (p != part or i != ids[-1]) and spanning is not None:
            yield part, run(len(ids), spanning)
            spanning = None
        if ids and p != part:
            yield part, run(len(ids), part << 24 | sub)
        if p != part:
            part, sub, spanning = p, 0, None
        if ids and size + len(t) > limit:
            if i != ids[-1]:
                yield part, run(len(ids), part << 24 | sub)
            else:
                # The rows of the last id go on: what stands before them is a run, then they are.
                before = ids.index(i)
                if before:
                    yield part, run(before, part << 24 | sub)
                if size + len(t) > limit:
                    spanning = part << 24 | sub if spanning is None else spanning
                    yield part, run(len(ids), spanning)
        ids.append(i)
        texts.append(t)
        size += len(t)
    if ids:
        yield part, run(len(ids), part << 24 | sub if spanning is None else spanning)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for p, i, n, blob in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "size", "blob")), strict=True):
        yield p, i, _CODEC.decompress(blob, n, asbytes=True) if n else b""


def ranged(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """part (range of ids), doc_id, th (hash of the text), size and compressed text. docs: doc_id, text, not null."""
    edges = np.array(bounds, np.int64)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 1000):
                own = b.slice(lo, 1000)
                raw = own.column("text").cast(pa.binary()).to_pylist()
                part = np.searchsorted(edges, own.column("doc_id").to_numpy(), "left")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), own.column("doc_id"), own.column("th"), pa.array([len(x) for x in raw], pa.int64()), pa.array([squeezed(x) for x in raw], pa.binary())], names=["part", "doc_id", "th", "size", "blob"])

    return docs.withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text").mapInArrow(batches, ROWS)


def runs_of(rows: DataFrame, bits: int, width: int, limit: int) -> DataFrame:
    """The digests of every run by bucket. rows: as of :func:`ranged`."""

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run in runs_in((r for b in it for r in _texts(b)), width, limit):
            bucket = run.h >> np.uint64(64 - bits) if bits else np.zeros(len(run.h), np.uint64)
            edges = np.append(np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), len(bucket)).tolist()
            for k in range(0, len(edges) - 1, 256):
                spans = list(zip(edges[k : k + 256], edges[k + 1 : k + 257], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([run.number] * len(spans), pa.int64()), pa.array([run.label] * len(spans), pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array([packed(run.h[a:b], run.check[a:b]) for a, b in spans], pa.binary())], names=["bucket", "run", "label", "n", "blob"])

    return rows.repartition("part").sortWithinPartitions("part", "doc_id", "th").mapInArrow(tasks, RUNS)


def merged(runs: DataFrame, keep: bool) -> DataFrame:
    """Merges the index (label -1) and a batch's runs by bucket: the runs' bits, and the bucket of the new index."""

    def bucket(t: pa.Table) -> pa.Table:
        number, label, size = (t.column(c).to_numpy() for c in ("run", "label", "n"))
        each = [unpacked(b, n) for b, n in zip(t.column("blob").to_pylist(), size.tolist(), strict=True)]
        h, check = (np.concatenate(x) for x in zip(*each, strict=True))
        source = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((number[source], check, h))
        h, check, source = h[order], check[order], source[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        # The first of equal digests stands in the least run; those of its label are one document's.
        first = label[source[new]][np.cumsum(new) - 1]
        known = first != label[source]
        by = np.argsort(source, kind="stable")
        bits = np.split(known[by], np.cumsum(size)[:-1])
        some = np.flatnonzero(label != -1).tolist()
        at = t.column("bucket")[0].as_py()
        out = [(int(number[k]) >> 24, int(number[k]), at, int(size[k]), np.packbits(bits[k]).tobytes(), None) for k in some]
        if keep:
            out.append((None, None, at, int(new.sum()), None, packed(h[new], check[new])))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())], names=["part", "run", "bucket", "n", "bits", "blob"])

    return runs.groupBy("bucket").applyInArrow(bucket, REPLIES)


def _kept(text: bytes, gone: np.ndarray | None, width: int) -> tuple[int, int, bytes]:
    """Words, removed words, the rest joined by blanks. gone: of each window, whether it goes."""
    words = text.split()
    n = len(words)
    if gone is not None and gone.any():
        cover = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(gone)
        cover[at] += 1
        cover[at + width] -= 1
        words = [w for w, x in zip(words, np.cumsum(cover).tolist(), strict=False) if not x]
    return n, n - len(words), b" ".join(words)


def _out(ids: list, rows: list[tuple[int, int, bytes]], with_text: bool) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[2].decode() for r in rows], pa.string())] if with_text else columns, names=[*names, "kept"] if with_text else names)


def _schema(with_text: bool) -> str:
    return "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text


def applied(rows: DataFrame, replies: DataFrame, width: int, limit: int, with_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words). The ranges' runs are made again; each meets its bits."""

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[np.ndarray]] = {}

        def texts() -> Iterator[tuple[int, int, bytes]]:
            for b in it:
                told = b.column("bits").is_valid().to_pylist()
                for lo in range(0, b.num_rows, 500):
                    own = b.slice(lo, 500)
                    if all(told[lo : lo + 500]):
                        replied(own)
                    elif not any(told[lo : lo + 500]):
                        yield from _texts(own)
                    else:
                        for k in range(own.num_rows):
                            if told[lo + k]:
                                replied(own.slice(k, 1))
                            else:
                                yield from _texts(own.slice(k, 1))

        def replied(b: pa.RecordBatch) -> None:
            for run, n, bits in zip(*(b.column(c).to_pylist() for c in ("run", "n", "bits")), strict=True):
                known.setdefault(run, []).append(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool))

        for _, run in runs_in(texts(), width, limit):
            bits = known.pop(run.number, None)
            gone = run.repeated(np.concatenate(bits) if bits else np.zeros(len(run.h), bool))
            cut = np.cumsum(run.size)
            for lo in range(0, len(run.ids), 1000):
                some = range(lo, min(lo + 1000, len(run.ids)))
                yield _out([run.ids[k] for k in some], [_kept(run.texts[k], gone[cut[k] - run.size[k] : cut[k]], width) for k in some], with_text)

    none = lambda kind: F.lit(None).cast(kind)
    # A part's bits come before its documents, by run and bucket.
    a = replies.filter("bits is not null").select("part", F.lit(0).alias("kind"), none("long").alias("doc_id"), none("long").alias("th"), none("long").alias("size"), none("binary").alias("blob"), "run", "bucket", "n", "bits")
    b = rows.select("part", F.lit(1).alias("kind"), "doc_id", "th", "size", "blob", none("long").alias("run"), none("int").alias("bucket"), none("long").alias("n"), none("binary").alias("bits"))
    every = a.unionByName(b).repartition("part").sortWithinPartitions("part", "kind", "run", "bucket", "doc_id", "th")
    return every.mapInArrow(tasks, _schema(with_text))


def untouched(docs: DataFrame, with_text: bool) -> DataFrame:
    """Documents without an id: all their words stay."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 500):
                own = b.slice(lo, 500)
                yield _out([None] * own.num_rows, [_kept(t, None, 0) for t in own.column("text").cast(pa.binary()).to_pylist()], with_text)

    return docs.select("text").mapInArrow(batches, _schema(with_text))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))


def bits_for(size: int) -> int:
    """Leading bits of buckets of about a million windows, for so many bytes of text: 8 at least."""
    return max(8, (size // 6_000_000).bit_length())


class FingerprintIndex:
    """Digests of all documents added so far. Batches come in the order of their ids, and no id is in two of them."""

    def __init__(self, spark: SparkSession, bits: int = 8, width: int = WIDTH, run_bytes: int = RUN_BYTES) -> None:
        self.spark, self.bits, self.width, self.run_bytes = spark, bits, width, run_bytes
        self.runs: DataFrame | None = None
        self.last: int | None = None

    def add(self, docs: DataFrame, with_text: bool = False, keep: bool = True) -> DataFrame:
        """The batch's documents without windows of earlier ones, stored; then the index holds the batch as well (unless it need not be kept)."""
        plain = _plain(docs)
        rows = plain.filter("doc_id is not null")
        low, high, size = rows.agg(F.min("doc_id"), F.max("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        bare = untouched(plain.filter("doc_id is null"), with_text)
        if low is None:
            return stored(bare, "repeats")
        if self.last is not None and low <= self.last:
            raise ValueError(f"a batch from id {low} on comes after id {self.last}")
        parts = min(MOST_PARTS, size // self.run_bytes + 1)
        bounds = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], F.lit(20 * parts))).first()[0] if parts > 1 else []
        dealt = ranged(rows, sorted(set(bounds)))
        new = runs_of(dealt, self.bits, self.width, self.run_bytes)
        if self.runs is not None:
            held = self.runs.filter("blob is not null").select("bucket", F.lit(-1).cast("long").alias("run"), F.lit(-1).cast("long").alias("label"), "n", "blob")
            new = new.unionByName(held)
        told, old = stored(merged(new, keep), "fingerprints", "none"), self.runs
        out = stored(applied(dealt, told, self.width, self.run_bytes, with_text).unionByName(bare), "repeats")
        if old is not None:
            discard(old)
        self.runs, self.last = told, high
        return out

    def close(self) -> None:
        """Deletes the index."""
        if self.runs is not None:
            discard(self.runs)
        self.runs = None


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False, batches: int = BATCHES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of all documents, added to an empty index in so many batches by their ids."""
    plain = _plain(docs)
    size, ids = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5], F.lit(10_000))).first()
    edges = sorted(set(ids or [])) if batches > 1 else []
    index = FingerprintIndex(docs.sparkSession, bits_for(size), width, run_bytes)
    out = None
    for k, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        own = plain
        if low is not None:
            own = own.filter(F.col("doc_id") > low)
        if high is not None:
            own = own.filter(F.col("doc_id").isNull() | (F.col("doc_id") <= high) if not k else F.col("doc_id") <= high)
        part = index.add(own, with_text, keep=high is not None)
        out = part if out is None else out.unionByName(part)
    index.close()
    return out
