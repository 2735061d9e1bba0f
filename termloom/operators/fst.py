"""Finite-state transducers in closed form: no sequential builder.

The potential of a prefix is what all outputs below it have in common: for numbers the minimum, for strings
the common prefix of the least and the greatest. An arc's output is its potential less its parent's, and a
key's final output is its own output less its potential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.bits import common_prefix_length
from termloom.operators.lookup import prefixes


class Numbers:
    """Outputs that add up."""

    empty = 0

    @staticmethod
    def common(low: Column, high: Column) -> Column:
        return low

    @staticmethod
    def less(value: Column, prefix: Column) -> Column:
        return value - prefix


class Strings:
    """Outputs that are joined."""

    empty = ""

    @staticmethod
    def common(low: Column, high: Column) -> Column:
        return F.left(low, common_prefix_length(low, high))

    @staticmethod
    def less(value: Column, prefix: Column) -> Column:
        return F.substr(value, F.length(prefix) + 1)


def potentials(entries: DataFrame, algebra=Numbers) -> DataFrame:
    """prefix, potential, whole (the prefix's own output; null where no key ends). entries: unique (term, output)."""
    own = F.when(F.col("depth") == F.length("term"), F.col("output"))
    p = prefixes(entries, "term").groupBy("prefix").agg(F.min("output").alias("low"), F.max("output").alias("high"), F.max(own).alias("whole"))
    return p.select("prefix", algebra.common(F.col("low"), F.col("high")).alias("potential"), "whole")


def arcs(entries: DataFrame, algebra=Numbers) -> DataFrame:
    """node, label, target, output, final_output (null where no key ends).

    An empty key is the final output of a virtual arc to the root, without node and label."""
    pot = potentials(entries, algebra)
    child = pot.select("prefix", F.left("prefix", F.length("prefix") - 1).alias("node"), F.right("prefix", F.lit(1)).alias("label"), "potential", "whole")
    parent = pot.select(F.col("prefix").alias("node"), F.col("potential").alias("above"))
    out = child.join(parent, "node", "left")
    out = out.select("node", "label", F.col("prefix").alias("target"), algebra.less(F.col("potential"), F.coalesce("above", F.lit(algebra.empty))).alias("output"), algebra.less(F.col("whole"), F.col("potential")).alias("final_output"))
    nothing = F.lit(None).cast("string")
    root = entries.filter("term = ''").select(nothing.alias("node"), nothing.alias("label"), F.col("term").alias("target"), F.lit(algebra.empty).cast(entries.schema["output"].dataType).alias("output"), F.col("output").alias("final_output"))
    return out.unionByName(root)


def accept(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query, accepted, output: exact lookup is an equi-join."""
    e = entries.select("term", "output")
    return queries.join(e, queries["query"] == e["term"], "left").select("query", F.col("term").isNotNull().alias("accepted"), "output")


def match_path(queries: DataFrame, entries: DataFrame, algebra=Numbers) -> DataFrame:
    """The longest path of each query, whether or not a key ends there: its length and the outputs on it with the last arc's final output.

    A path that goes nowhere has the empty key's output, if there is one."""
    pot = potentials(entries, algebra)
    # Arc outputs up to a node add up to its potential, and a final output completes them to the key's own.
    node = pot.select("prefix", F.coalesce("whole", "potential").alias("value"))
    hit = prefixes(queries, "query").join(node, "prefix").groupBy("query").agg(F.max(F.struct("depth", "value")).alias("m"))
    root = entries.filter("term = ''").agg(F.min("output").alias("root"))
    out = queries.join(hit, "query", "left").join(F.broadcast(root))
    return out.select("query", F.coalesce("m.depth", F.lit(0)).cast("long").alias("path_length"), F.coalesce("m.value", "root", F.lit(algebra.empty)).alias("output"))


def state_classes(entries: DataFrame) -> DataFrame:
    """keys, states, nodes: of the nodes with so many keys below, how many differ, and how many there are.

    Two nodes are one state of the minimal transducer if they have the same rests of keys below with the same outputs
    less their potentials, so no level waits for the one below it: each node's class is 128 bits of that set."""
    every = entries.select("term", "output", F.explode(F.sequence(F.lit(0), F.length("term"))).alias("depth"))
    every = every.select(F.left("term", F.col("depth")).alias("prefix"), F.substr("term", F.col("depth") + 1).alias("rest"), "output")
    low = every.groupBy("prefix").agg(F.min("output").alias("low"))
    rest = every.join(low, "prefix").withColumn("output", F.col("output") - F.col("low"))
    nodes = rest.groupBy("prefix").agg(F.count("*").alias("keys"), *[F.bit_xor(F.xxhash64(F.lit(k), "rest", "output")).alias(f"h{k}") for k in (1, 2)])
    states = nodes.groupBy("keys", "h1", "h2").agg(F.count("*").alias("nodes"))
    return states.groupBy("keys").agg(F.count("*").alias("states"), F.sum("nodes").alias("nodes"))


def trie_edges(dictionary: DataFrame) -> DataFrame:
    """node, label of every edge of the trie of terms."""
    p = prefixes(dictionary, "term").select("prefix").distinct()
    return p.select(F.left("prefix", F.length("prefix") - 1).alias("node"), F.right("prefix", F.lit(1)).alias("label"))


def dot_lines(a: DataFrame) -> DataFrame:
    """One line of a DOT graph per arc."""
    return a.select(F.format_string('"%s" -> "%s" [label="%s/%s"%s]', "node", "target", "label", F.col("output").cast("string"), F.when(F.col("final_output").isNotNull(), F.lit(" peripheries=2")).otherwise(F.lit(""))).alias("line"))
