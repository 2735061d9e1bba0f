"""Keyed lookups: exact terms, floor blocks, longest prefixes.

Defined results: a null key is found nowhere and stays as a row; repeated keys are answered each (by ``floor_lookup``
once); an empty dictionary finds nothing; targets of fields without bounds go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seek_exact(targets: DataFrame, meta: DataFrame, dictionary: DataFrame) -> DataFrame:
    """targets (field, target) with found and the term's statistics; the range test stays in the join so that misses are kept."""
    bounds = meta.select("field", "min_term", "max_term")
    t = targets.join(bounds, "field")
    hit = dictionary.select(F.col("field").alias("f"), "term", "doc_freq", "total_term_freq", "singleton_doc")
    inside = t["target"].between(t["min_term"], t["max_term"])
    out = t.join(hit, (t["field"] == hit["f"]) & (t["target"] == hit["term"]) & inside, "left")
    return out.select("field", "target", F.coalesce(inside, F.lit(False)).alias("in_range"), F.col("term").isNotNull().alias("found"), "doc_freq", "total_term_freq", "singleton_doc")


def floor_blocks(dictionary: DataFrame, label_length: int = 2) -> DataFrame:
    """prefix, label, entries: each prefix block split by its next character."""
    d = dictionary.filter(F.length("term") > label_length)
    return d.groupBy(F.left("term", F.lit(label_length)).alias("prefix"), F.substring("term", label_length + 1, 1).alias("label")).agg(F.count("*").alias("entries"))


def floor_lookup(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block with the greatest label not above the target's; the first block if the target is below all.

    An equi-join on the prefix carries the range condition, and one partial aggregate picks the label.
    """
    first = blocks.groupBy("prefix").agg(F.min("label").alias("first_label"))
    t = targets.join(first, "prefix", "left")
    wanted = F.greatest("target_label", "first_label")
    b = blocks.select(F.col("prefix").alias("p"), "label", "entries")
    return t.join(b, (t["prefix"] == b["p"]) & (b["label"] <= wanted), "left").groupBy("prefix", "target_label").agg(F.max(F.struct("label", "entries")).alias("m")).select("prefix", "target_label", F.col("m.label").alias("label"), F.col("m.entries").alias("entries"))


def prefixes(keys: DataFrame, key: str = "term") -> DataFrame:
    """key, prefix, depth for every non-empty prefix."""
    return keys.filter(F.length(key) > 0).withColumn("depth", F.explode(F.sequence(F.lit(1), F.length(key)))).withColumn("prefix", F.left(key, F.col("depth")))


def match_key(queries: DataFrame, dictionary: DataFrame, key: str = "query") -> DataFrame:
    """The longest stored key that starts each query, with its output."""
    p = prefixes(queries, key)
    hit = p.join(dictionary, p["prefix"] == dictionary["term"]).groupBy(key).agg(F.max(F.struct("depth", "term", "output")).alias("m"))
    return queries.join(hit, key, "left").select(key, F.col("m.term").alias("match"), F.col("m.output").alias("output"))
