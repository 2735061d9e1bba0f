"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

Leaves are paths (domain, language, source). A node can take as many tokens as its documents hold in
``max_epochs`` epochs. From the root down, a node's budget is split over its children by weight; a child
that can't take its share is filled, and what it lacks goes to its siblings in proportion to their weights.
Only when all children of a node are full does its lack go on to the node's own siblings: the node's
capacity is the sum of its children's, so this has happened before its budget reaches it. Shares are whole
numbers, in integer arithmetic; rounding leaves less than one token per child.

A leaf with t tokens and a budget of q * t + r takes all its documents q times, and in epoch q the token
prefix of length r of its documents in the order of a seeded hash of (epoch, id), or of (epoch, text) where
there is no id. Prefix sums go over hash
ranges first; only the range in which a prefix ends is ordered. So no task holds a leaf.

Defined results: null keys are leaves of their own name ""; a text without words has no tokens and is not
selected; equal rows are selected or not in an order that can't be told apart; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_of, words_of

LEVELS = ("domain", "lang", "source")
#: Documents of a hash range.
RANGE = 4096


class Mixture(NamedTuple):
    """weights: by level, whole numbers by name; others weigh 1. Budget: percent of the corpus."""

    weights: Mapping[str, Mapping[str, int]]
    budget_percent: int = 125
    max_epochs: int = 2
    seed: int = 17


#: Production parameters: three domains, English and German doubled, the largest source held down.
MIXTURE = Mixture({"domain": {"web": 5, "books": 3, "forum": 4}, "lang": {"en": 4, "de": 2, "fr": 1, "es": 1}, "source": {"src0": 8}})


def domain_of(source: Column) -> Column:
    """The domain of the tables' sources, by the number in their name."""
    n = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    n = F.when(n == "", 0).otherwise(n.cast("int"))
    return F.when(n % 3 == 0, "web").when(n % 3 == 1, "books").otherwise("forum")


def _weight(level: str, mixture: Mixture) -> Column:
    own = mixture.weights.get(level, {})
    out = F.lit(1)
    for name, units in own.items():
        out = F.when(F.col(level) == name, units).otherwise(out)
    return out.cast("long")


def split_budget(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Adds take to rows (parent..., weight, room, budget): budget shared by weight, none above its room, no room left unused."""
    big = lambda c: c.cast("decimal(38,0)")
    # Children in the order in which they fill up: by room / weight.
    w = W.partitionBy(*parent).orderBy(F.col("room") / F.col("weight"), *order)
    above = F.coalesce(F.sum("room").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing))
    df = nodes.withColumns({"_rest": F.greatest(F.col("budget") - above, F.lit(0)).cast("long"), "_units": left.cast("long"), "_n": F.row_number().over(w)})
    df = df.withColumn("_full", big(F.col("room")) * F.col("_units") <= big(F.col("weight")) * F.col("_rest"))
    # From the first child on that isn't full, all share what is left there.
    first = W.partitionBy(*parent)
    df = df.withColumn("_first", F.min(F.when(~F.col("_full"), F.col("_n"))).over(first))
    df = df.withColumns({"_r": F.max(F.when(F.col("_n") == F.col("_first"), F.col("_rest"))).over(first), "_u": F.max(F.when(F.col("_n") == F.col("_first"), F.col("_units"))).over(first)})
    share = F.expr("cast((cast(weight as decimal(19,0)) * cast(_r as decimal(19,0))) div cast(_u as decimal(19,0)) as bigint)")
    return df.withColumn("take", F.when(F.col("_first").isNull() | (F.col("_n") < F.col("_first")), F.col("room")).otherwise(F.least(share, F.col("room")))).drop("_rest", "_units", "_n", "_full", "_first", "_r", "_u")


def leaf_budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """leaves: (domain, lang, source, tokens, docs). Adds take, the leaf's budget in tokens."""
    leaves = leaves.withColumn("room", F.col("tokens") * mixture.max_epochs)
    at = None
    for k, level in enumerate(LEVELS):
        path = list(LEVELS[: k + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).withColumn("weight", _weight(level, mixture))
        if at is None:
            nodes = nodes.withColumn("budget", F.expr(f"sum(tokens) over () * {mixture.budget_percent} div 100"))
            nodes = split_budget(nodes.withColumn("_root", F.lit(0)), ["_root"], [level]).drop("_root")
        else:
            nodes = split_budget(nodes.join(at, path[:-1]), path[:-1], [level])
        at = nodes.select(*path, F.col("take").alias("budget"), "tokens", "docs") if level == LEVELS[-1] else nodes.select(*path, F.col("take").alias("budget"))
    return at.withColumnRenamed("budget", "take")


def select(docs: DataFrame, mixture: Mixture = MIXTURE, id_col: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per selected document and epoch: doc_id, domain, lang, source, epoch, n_tokens, take_tokens (fewer where a prefix ends).

    row: a column of docs with a number for each row, given back as _row.
    """
    source, lang = F.coalesce(docs["source"], F.lit("")), F.coalesce(docs["lang"], F.lit(""))
    doc_id = docs[id_col].cast("long")
    # Documents without an id are dealt by their texts.
    bare = F.when(doc_id.isNull(), F.xxhash64(text_of(docs)))
    sized = docs.select(doc_id.alias("doc_id"), bare.alias("_bare"), domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), F.size(words_of(text_of(docs))).cast("long").alias("n_tokens"), *([docs[row].alias("_row")] if row else []))
    return _select(stored(sized, "mix-sizes"), mixture)


def _select(sized: DataFrame, mixture: Mixture) -> DataFrame:
    keys, row = list(LEVELS), [c for c in sized.columns if c == "_row"]
    leaves = sized.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0")
    budgets = leaf_budgets(leaves, mixture)
    budgets = budgets.withColumns({"whole": F.expr("take div tokens"), "rest": F.expr("take % tokens"), "ranges": F.expr(f"cast(docs div {RANGE} + 1 as bigint)")})
    budgets = stored(budgets.select(*keys, "whole", "rest", "ranges"), "mix-budgets")
    df = sized.filter("n_tokens > 0").join(budgets, keys)
    # 31 bits of the hash place a document; the range is their leading part.
    df = df.withColumn("place", F.xxhash64(F.lit(mixture.seed), "whole", F.coalesce("doc_id", "_bare")))
    df = df.withColumn("range", F.expr("cast(shiftrightunsigned(place, 33) * ranges div 2147483648 as bigint)"))
    sums = df.groupBy(*keys, "rest", "range").agg(F.sum("n_tokens").alias("own"))
    low = F.coalesce(F.sum("own").over(W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row a leaf, of a size that Spark knows: the rows are not dealt by leaf to meet it.
    ends = stored(sums.withColumn("low", low).filter("low <= rest and rest < low + own").select(*keys, F.col("range").alias("end_range"), "low"), "mix-ends")
    df = df.join(ends, keys).withColumn("_part", F.when(F.col("range") < F.col("end_range"), F.col("n_tokens")).when(F.col("range") > F.col("end_range"), F.lit(0)))
    order = W.partitionBy(*keys).orderBy(F.shiftrightunsigned("place", 33), "place", "doc_id", "n_tokens", *row).rowsBetween(W.unboundedPreceding, -1)
    last = df.filter("_part is null").withColumn("_part", F.greatest(F.least("n_tokens", F.col("rest") - F.col("low") - F.coalesce(F.sum("n_tokens").over(order), F.lit(0))), F.lit(0)).cast("long"))
    df = df.filter("_part is not null").withColumn("_part", F.col("_part").cast("long")).unionByName(last)
    copies = F.col("whole") + F.when(F.col("_part") > 0, 1).otherwise(0)
    out = df.filter(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    return out.select("doc_id", *keys, "epoch", "n_tokens", F.when(F.col("epoch") < F.col("whole"), F.col("n_tokens")).otherwise(F.col("_part")).alias("take_tokens"), *row)


def mix(docs: DataFrame, mixture: Mixture = MIXTURE) -> DataFrame:
    """The selected documents with their columns, once per epoch; where a prefix ends, the text is cut after its last word.

    Rows are told apart by a number in a stored table, so rows that share an id or have none each come back as they were selected.
    """
    names = docs.columns
    # Names that no column of docs has.
    row, n, take, text = (max([*names, ""], key=len) + end for end in ("_row", "_n", "_take", "_text"))
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    chosen = select(docs, mixture, row=row).select(F.col("_row").alias(row), F.col("n_tokens").alias(n), F.col("take_tokens").alias(take))
    out = docs.join(chosen, row)
    bare = F.regexp_replace("text", r"^[\x20\x09-\x0D]+", "")
    rest = F.element_at(F.split(bare, r"[\x20\x09-\x0D]+", (F.col(take) + 1).cast("int")), -1)
    cut = F.when(F.col(take) >= F.col(n), F.col("text")).otherwise(F.regexp_replace(F.substr(bare, F.lit(1), F.length(bare) - F.length(rest)), r"[\x20\x09-\x0D]+$", ""))
    out = out.withColumn(text, cut)
    columns = [F.col(text).alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names]
    return out.select(*columns)
