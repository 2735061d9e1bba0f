"""Functions of array columns: pieces, transposition, arcs of a state, sets of outputs.

A state is a struct of arcs (label, target, output) and final_output, which is null where no key ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(n: Column, value: Column) -> Column:
    return F.array_repeat(value, n.cast("int"))


def upto(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n)


def running_sums(numbers: Column, base: Column) -> Column:
    """base and the first number, and the second one, and so on."""
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["all"], s["sum"] + x).alias("all"))
    return F.aggregate(numbers, F.struct(base.alias("sum"), F.expr("cast(array() as array<bigint>)").alias("all")), step, lambda s: s["all"])


def transposed(lists: Column) -> Column:
    """The first items, then the second ones, up to the shortest list's length."""
    return F.transform(upto(F.coalesce(F.array_min(F.transform(lists, F.size)), F.lit(0))), lambda i: F.transform(lists, lambda x: F.get(x, i)))


def take(items: Column, n: int) -> Column:
    """(first n, rest) as a struct; raises if there are fewer."""
    short = F.raise_error(F.format_string(f"{n} items wanted, %d found", F.size(items)))
    return F.when(F.size(items) >= n, F.struct(F.slice(items, 1, n).alias("first"), F.slice(items, n + 1, 1 << 30).alias("rest"))).otherwise(short)


def split_at(items: Column, n: int) -> Column:
    """(first n or fewer, rest) as a struct."""
    return F.struct(F.slice(items, 1, n).alias("first"), F.slice(items, n + 1, 1 << 30).alias("rest"))


def last(items: Column) -> Column:
    """Raises if there is none."""
    return F.when(F.size(items) > 0, F.try_element_at(items, F.lit(-1))).otherwise(F.raise_error(F.lit("empty list")))


def is_empty(items: Column) -> Column:
    return F.size(items) == 0


#: A state without arcs.
ARCS = "array<struct<label:bigint,target:bigint,output:bigint>>"


def state(arcs: Column | None = None, final_output: Column | None = None) -> Column:
    return F.struct((F.array() if arcs is None else arcs).cast(ARCS).alias("arcs"), (F.lit(None) if final_output is None else final_output).cast("long").alias("final_output"))


def empty_final_state() -> Column:
    return state(None, F.lit(0))


def is_final(s: Column) -> Column:
    return s["final_output"].isNotNull()


def with_arc(s: Column, label: Column, target: Column, output: Column) -> Column:
    """The state with this arc in front, instead of one with its label."""
    arc = F.struct(label.cast("long").alias("label"), target.cast("long").alias("target"), output.cast("long").alias("output"))
    return state(F.array_prepend(F.filter(s["arcs"], lambda a: a["label"] != label), arc), s["final_output"])


def with_outputs(s: Column, f) -> Column:
    """The state with f applied to every arc's output and to the final one."""
    arcs = F.transform(s["arcs"], lambda a: F.struct(a["label"].alias("label"), a["target"].alias("target"), f(a["output"]).alias("output")))
    return state(arcs, f(s["final_output"]))


def with_final_output(s: Column, output: Column) -> Column:
    return state(s["arcs"], output)


def arc_of(s: Column, label: Column) -> Column:
    """The arc with a label; null if there is none."""
    return F.get(F.filter(s["arcs"], lambda a: a["label"] == label), 0)


def target_of(s: Column, label: Column) -> Column:
    return arc_of(s, label)["target"]


def output_of(s: Column, label: Column, empty: Column) -> Column:
    """The arc's output; the empty one if there is no such arc."""
    return F.coalesce(arc_of(s, label)["output"], empty)


def outputs_of(s: Column) -> Column:
    return F.transform(s["arcs"], lambda a: a["output"])


def arc_order(arcs: Column) -> Column:
    """A value that orders lists of arcs: fewer arcs first, then arc by arc by label, target and output."""
    return F.struct(F.size(arcs).alias("n"), F.transform(arcs, lambda a: F.struct(a["label"], a["target"], a["output"])).alias("arcs"))


def state_order(s: Column) -> Column:
    """A value that orders states: finality, labels, outputs, final output, targets."""
    each = lambda name: F.transform(s["arcs"], lambda a: a[name])
    return F.struct(is_final(s).alias("final"), each("label").alias("labels"), each("output").alias("outputs"), s["final_output"].alias("final_output"), each("target").alias("targets"))


def add_output(outputs: Column, output: Column) -> Column:
    """An ordered set with one member more."""
    return F.array_sort(F.array_union(outputs, F.array(output)))


def map_outputs(outputs: Column, f) -> Column:
    return F.array_sort(F.array_distinct(F.transform(outputs, f)))


def without(items: Column, item: Column) -> Column:
    return F.array_except(items, F.array(item))
