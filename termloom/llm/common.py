"""Shared helpers: work tables in the cluster's shared folder, word splitting, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: blank and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir. Unset, it is a temporary folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _path(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under :func:`work_dir`, removed when the driver's JVM ends."""
    path = f"{work_dir(spark)}/termloom-{uuid.uuid4().hex}-{name}"
    files, target = _path(spark, path)
    files.deleteOnExit(target)
    return path


#: Has Spark delete a query's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path, before = work_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


#: Of each open scope, the tables stored in it so far.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Gathers the tables that are stored inside; the caller discards what is not needed any more."""
    _OPEN.append(own := [])
    try:
        yield own
    finally:
        _OPEN.remove(own)


def leave(own: list[DataFrame], *kept: DataFrame) -> None:
    """Discard a scope's tables but those kept, which go to the scope outside."""
    paths = {t._work_path for t in kept}
    discard(*(t for t in own if t._work_path not in paths))
    if _OPEN:
        _OPEN[-1].extend(kept)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads; those that are gone stay gone."""
    for t in tables:
        files, target = _path(t.sparkSession, t._work_path)
        files.delete(target, True)


#: Rows of a few numbers that are broadcast at most: some 16 MB.
MOST_BROADCAST = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A stored table of narrow rows, marked for a broadcast where it is counted to be small; else Spark chooses by its size."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def text_of(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order, by built-in functions that need no regular expression."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
