"""Validation of file headers and capabilities of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.bits import flag
from termloom.sources.layouts import MAGIC

INDEX_OPTIONS = ("none", "docs", "freqs", "positions", "offsets")
DOC_VALUES = ("none", "numeric", "binary", "sorted", "sorted_numeric", "sorted_set")
FLAGS = {"store_term_vector": 1, "omit_norms": 2, "store_payloads": 4, "is_soft_deletes_field": 8}


def _wrong(kind: str, expected: Column, found: Column) -> Column:
    return F.format_string(f"{kind}: expected %s, found %s", expected.cast("string"), found.cast("string"))


def _name_and_version(name: str, low: int, high: int, of) -> list[Column]:
    return [
        F.when(~of("name").eqNullSafe(F.lit(name)), _wrong("name", F.lit(name), of("name"))),
        F.when(~F.coalesce(of("version").between(low, high), F.lit(False)), _wrong("version", F.lit(f"{low}..{high}"), of("version"))),
    ]


def header_error(name: str, low: int, high: int, ident: str, suffix: str, of=F.col) -> Column:
    """The first of name, version, id and suffix that is wrong; null if all are right. A null is wrong. ``of`` gives a header's field."""
    return F.coalesce(
        *_name_and_version(name, low, high, of),
        F.when(~of("object_id").eqNullSafe(F.lit(ident)), _wrong("id", F.lit(ident), of("object_id"))),
        F.when(~of("suffix").eqNullSafe(F.lit(suffix)), _wrong("suffix", F.lit(suffix), of("suffix"))),
    )


def plain_header_error(name: str, low: int, high: int, of=F.col) -> Column:
    """The first of magic number, name and version that is wrong; null if all are right."""
    magic = F.when(~of("magic").eqNullSafe(F.lit(MAGIC)), _wrong("magic", F.lit(MAGIC), of("magic")))
    return F.coalesce(magic, *_name_and_version(name, low, high, of))


def checked_version(header: Column, name: str, low: int, high: int, ident: str, suffix: str) -> Column:
    """A header's version; raises what :func:`header_error` tells."""
    error = header_error(name, low, high, ident, suffix, lambda n: header[n])
    return F.when(error.isNull(), header["version"]).otherwise(F.raise_error(error).cast("long"))


def footer_ok(remaining: Column, magic: Column) -> Column:
    return (remaining == 16) & (magic == (~MAGIC & 0xFFFFFFFF))


def of_code(code: Column, names: tuple[str, ...]) -> Column:
    """The name of an enumeration's code; an unknown code raises."""
    out = F.raise_error(F.format_string("unknown code %d", code))
    for i, n in enumerate(names):
        out = F.when(code == i, n).otherwise(out)
    return out


def capabilities(code: Column) -> dict[str, Column]:
    """What an index option holds; has_prox is has_positions."""
    return {"has_freqs": code >= 2, "has_positions": code >= 3, "has_offsets": code >= 4, "has_prox": code >= 3}


def for_all(x: Column) -> Column:
    """True over no rows as well."""
    return F.coalesce(F.bool_and(x), F.lit(True))


def fields(files: DataFrame, by: str) -> DataFrame:
    """The fields of parsed field files (by, record), a row each, with names for their codes and a column for each flag."""
    f = files.select(by, F.explode("record.fields").alias("f")).select(by, "f.*")
    f = f.withColumns({n: flag(F.col("flags"), m) for n, m in FLAGS.items()} | capabilities(F.col("index_options")))
    return f.withColumns({"index_options": of_code(F.col("index_options"), INDEX_OPTIONS), "doc_values": of_code(F.col("doc_values"), DOC_VALUES)})


def rollup(f: DataFrame, by: str) -> DataFrame:
    """What holds for all fields of a file, and how many there are."""
    return f.groupBy(by).agg(F.count("*").alias("fields"), for_all(F.col("has_prox")).alias("has_prox"), for_all(F.col("store_payloads")).alias("has_payloads"), for_all(F.col("has_offsets")).alias("has_offsets"))


def by_number(rows: DataFrame, f: DataFrame, wanted: str) -> DataFrame:
    """rows with the name of the field of that number; raises where there is none."""
    out = rows.join(f.select(F.col("number").alias("_number"), "name"), F.col(wanted) == F.col("_number"), "left")
    missing = F.raise_error(F.format_string("no field %s", F.col(wanted).cast("string")))
    return out.withColumn("name", F.when(F.col("_number").isNotNull(), F.col("name")).otherwise(missing)).drop("_number")


def by_name(rows: DataFrame, f: DataFrame, wanted: str) -> DataFrame:
    """rows with the number of the field of that name (the least, if several have it); null where there is none."""
    names = f.groupBy(F.col("name").alias("_name")).agg(F.min("number").alias("number"))
    return rows.join(names, F.col(wanted) == F.col("_name"), "left").drop("_name")
