"""Running sums and neighbours over a whole table in key order, without a task that sees it all.

The table is dealt by ranges of the key; a window runs inside each range, and one row per range carries on what came
before it. Rows of equal keys are in one range; their order among each other is not told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.store import checkpoint


def _ranges(df: DataFrame, key: str) -> DataFrame:
    """df with the number of its range, stored so that ranges stay as they are."""
    return checkpoint(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, key: str, **sums: Column) -> DataFrame:
    """df with the sum of each expression over all rows before."""
    r = _ranges(df.withColumns(sums), key)
    parts = r.groupBy("_range").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    # As many rows as there are partitions.
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums})
    r = r.join(F.broadcast(parts), "_range")
    return r.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def numbered(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """df with the number of rows before each."""
    return running(df, key, **{name: F.lit(1).cast("long")})


def with_previous(df: DataFrame, key: str, name: str = "before", first: str = "") -> DataFrame:
    """df with the key of the row before; ``first`` where there is none."""
    r = _ranges(df, key)
    parts = r.groupBy("_range").agg(F.max(key).alias("_last"))
    parts = parts.select("_range", F.lag("_last", 1, first).over(W.orderBy("_range")).alias("_before"))
    r = r.withColumn(name, F.lag(key).over(W.partitionBy("_range").orderBy(key)))
    return r.join(F.broadcast(parts), "_range").withColumn(name, F.coalesce(name, "_before")).drop("_range", "_before")
