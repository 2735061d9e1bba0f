"""Text files of keyed lists: a line "$key", then the values of that key, one a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a key's line starts with.
MARK = "$"


def keyed(lines: DataFrame) -> DataFrame:
    """lines (file, number, line) -> file, number, key, value: every other line with the last key above it in its file, or null.

    Empty and null lines go. A file is one task's."""
    key = F.when(F.col("line").startswith(MARK), F.substr("line", F.lit(2)))
    w = W.partitionBy("file").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    out = lines.withColumns({"_own": key, "key": F.last(key, ignorenulls=True).over(w)})
    return out.filter(F.col("_own").isNull() & (F.col("line") != "")).select("file", "number", "key", F.col("line").alias("value"))


def pairs(lines: DataFrame, separator: str = " ") -> DataFrame:
    """lines (line) -> input, output: cut at the first separator; lines without one have a null output."""
    at = F.instr("line", separator)
    return lines.select(F.when(at > 0, F.expr(f"left(line, instr(line, '{separator}') - 1)")).otherwise(F.col("line")).alias("input"), F.when(at > 0, F.expr(f"substring(line, instr(line, '{separator}') + {len(separator)})")).alias("output"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number, line of the text files under a path; a file is read whole, as its lines are numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r?\n$", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("number", "line"))
