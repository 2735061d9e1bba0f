"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents. In each round a source's deficit grows by its share of one window; it
sends whole documents while the deficit covers them and carries the rest on. As a queue's deficit after r
rounds is r times its quantum less what it has sent, the round of a document has a closed form: the first
r with r * quantum >= the queue's tokens up to and with it. So the global order (round, source, place in the
queue) needs prefix sums only, which are taken in two levels: no task sees a whole source, or all rounds.
The stream is cut every ``window`` ids; only the last sequence is padded, and deficits carry across windows
and partitions alike.

Without weights the targets are the sources' own shares, so that all queues end together. With weights, a
source that has run out leaves the later rounds to the others; nothing is dropped.

Defined results: a null text is empty, so the document is the end id alone; a null source is a source of its
own name ""; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_of

WINDOW, END_ID = 2048, 1


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, n, ids (little-endian 16-bit if the vocabulary allows, with the end id)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import word_bpe

        bpe = word_bpe(tokenizer_path)
        kind = "<u2" if bpe.library.get_vocab_size() <= 1 << 16 else "<u4"
        for b in it:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = bpe.encode(part.column("text").cast(pa.binary()).to_pylist())
                raw = [np.append(x, end_id).astype(kind).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array(raw, pa.binary()), pa.array([int(kind[2])] * len(raw), pa.int32())], names=["doc_id", "source", "n", "ids", "width"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("source"), text_of(docs).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, source string, n long, ids binary, width int")


def placed(sizes: DataFrame, window: int, weights: dict[str, float] | None = None) -> DataFrame:
    """row_id and at: the place of each row's first id in the global stream. sizes: row_id, doc_id, source, n."""
    spark = sizes.sparkSession
    rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, -(-rows // 4096))
    a = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_id"), F.lit(buckets)))
    parts = a.groupBy("source", "bucket").agg(F.sum("n").alias("part"))
    parts = parts.withColumns({"before": F.sum("part").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), "of_source": F.sum("part").over(W.partitionBy("source"))})
    a = a.withColumn("within", F.sum("n").over(W.partitionBy("source", "bucket").orderBy("doc_id", "row_id").rowsBetween(W.unboundedPreceding, 0)))
    a = a.join(parts, ["source", "bucket"]).withColumn("upto", F.col("within") + F.coalesce("before", F.lit(0)))
    big = lambda c: c.cast("decimal(19,0)")
    if weights is None:
        share, whole = big(F.col("of_source")), total
    else:
        units = {k: max(1, round(1e6 * v)) for k, v in weights.items()}
        w = spark.createDataFrame([*units.items()], "source string, unit long") if units else spark.createDataFrame([], "source string, unit long")
        a = a.join(w, "source", "left").withColumn("unit", F.coalesce("unit", F.lit(1).cast("long")))
        share, whole = big(F.col("unit")), sum(units.values())
    # The first round whose deficits cover the document: ceil(upto * whole / (window * share)).
    a = a.withColumns({"_x": big(F.col("upto")) * F.lit(whole).cast("decimal(19,0)"), "_y": (share * F.lit(window)).cast("decimal(38,0)")})
    a = a.withColumn("round", F.expr("cast((cast(_x as decimal(38,0)) + _y - 1) div _y as bigint)")).select("row_id", "source", "n", "upto", "round")
    a = a.withColumn("inside", F.coalesce(F.sum("n").over(W.partitionBy("round").orderBy("source", "upto", "row_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    wide = max(1, int((total / window) ** 0.5))
    r = a.groupBy("round").agg(F.sum("n").alias("n")).withColumn("block", F.expr(f"round div {wide}"))
    blocks = r.groupBy("block").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    r = r.withColumn("low", F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("round").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    r = r.join(blocks, "block").select("round", (F.col("base") + F.col("low")).alias("start"))
    return a.join(r, "round").select("row_id", (F.col("start") + F.col("inside")).alias("at"))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids, sequence_padding apart."""
    t = stored(tokenised(docs, tokenizer_path).withColumn("row_id", F.monotonically_increasing_id()), "pack-ids")
    at = placed(t.select("row_id", "doc_id", "source", "n"), window, weights)

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, n, raw, width, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "width", "at")), strict=True):
                ids, done = np.frombuffer(raw, f"<u{width}").astype("<u4"), 0
                while done < n:
                    seq, off = divmod(at + done, window)
                    size = min(n - done, window - off)
                    own = ids[done : done + size].tobytes()
                    for k, v in zip(out, (doc, done, size, zlib.crc32(own), n, seq, off, own), strict=True):
                        out[k].append(v)
                    done += size
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.binary() if k == "ids" else pa.int64()) for k in out]))

    joined = t.join(at, "row_id").select("doc_id", "n", "ids", "width", "at")
    return joined.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
