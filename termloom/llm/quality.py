"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Defined results: a null text counts as empty; an empty text has zero counts and fails the base rule;
repeated rows are judged each on its own; an empty table gives an empty result; only the id and text
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on with as by at be this are from an or had not but have "
    "der die und das ist ein eine zu den mit von auf für im nicht sich des dem als "
    "le la les de et un une en que qui pour dans par sur du des au est "
    "el los las y del se con para una su por lo al"
)


class Rule(NamedTuple):
    """A document passes if low <= metric <= high; None leaves a side open. metric names a column or is SQL."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: Production thresholds. Ratios are of counts that :func:`measures` gives.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols / n_words", None, 0.25),
    Rule("stop_words", "n_stop_words / n_words", 0.01, None),
    Rule("dup_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("shouting", "n_upper / word_chars", None, 0.35),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: str = STOP_WORDS) -> DataFrame:
    """id, _text and the counts that rules may use. No shuffle, no user function."""
    df = docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("_text"))
    return measured(df, stop_words)


def measured(df: DataFrame, stop_words: str = STOP_WORDS) -> DataFrame:
    """Adds the counts to a frame that has a non-null string column ``_text``."""
    t = F.col("_text")
    df = df.withColumn("_words", words_of(t)).withColumn("n_words", F.size("_words").cast("long"))
    stop = sorted({v for w in stop_words.split() for v in (w, w.capitalize(), w.upper())})
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long"),
            "_lines": lines,
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    df = df.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 words
        df = df.withColumn("_h", F.zip_with("_h", F.slice("_h", step + 1, F.greatest(F.size("_h") - step, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    windows = F.greatest(F.col("n_words") - 7, F.lit(0)).cast("int")
    df = df.withColumn("_h", F.slice("_h", 1, windows))
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    # Only documents in which some window's hash occurs twice sort their windows, as hash bits above position bits.
    bits = F.length(F.bin("n_words"))
    df = df.withColumn("_s", F.when(repeated, F.sort_array(F.transform("_h", lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))))
    top = lambda x: F.call_function("shiftright", x, bits)
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    gram = lambda i: F.slice("_words", i.cast("int") + 1, 8)
    near = lambda x, j: F.coalesce(top(x) == top(F.get("_s", j)), F.lit(False))
    df = df.withColumn("_f", F.filter("_s", lambda x, j: near(x, j - 1) | near(x, j + 1)))
    following = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    clash = F.exists(F.zip_with("_f", following("_f"), lambda x, y: F.coalesce((top(x) == top(y)) & (gram(place(x)) != gram(place(y))), F.lit(False))), lambda x: x)
    # Should hash bits agree where words differ, the windows' words themselves are sorted.
    df = df.withColumn("_g", F.when(F.size("_f") > 0, F.when(clash, F.array_sort(F.transform("_h", lambda _, i: F.struct(gram(i).alias("g"), i.cast("long").alias("i")))))))
    same = lambda x, j: F.coalesce(x["g"] == F.get("_g", j)["g"], F.lit(False))
    exact = F.transform(F.filter("_g", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])
    df = df.withColumn("_i", F.sort_array(F.coalesce(exact, F.transform("_f", place))))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(F.zip_with("_i", following("_i"), lambda x, y: F.least(F.lit(8).cast("long"), F.coalesce(y - x, F.lit(8).cast("long")))), zero, lambda n, x: n + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, zero)).drop("_words", "_h", "_s", "_f", "_g", "_i")


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column per rule; an undefined ratio (no words, no lines) passes."""
    out = {}
    for r in rules:
        value = F.expr(" / ".join(f"nullif(cast({x.strip()} as double), 0)" if k else f"cast({x.strip()} as double)" for k, x in enumerate(r.metric.split("/"))))
        sides = [s for s in (value >= r.low if r.low is not None else None, value <= r.high if r.high is not None else None) if s is not None]
        out[f"ok_{r.name}"] = F.coalesce(sides[0] if len(sides) == 1 else sides[0] & sides[1], F.lit(True))
    return out


def verdicts(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, ok_<rule> and kept to a frame of counts."""
    oks = compiled(rules)
    keep = F.lit(True)
    for name in oks:
        keep = keep & F.col(name)
    df = df.withColumns({"base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")), **oks})
    return df.withColumn("kept", ~F.col("base_failed") & keep)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts, base_failed, each rule's outcome, kept."""
    return verdicts(measures(docs), rules).drop("_text")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their columns unchanged."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), text_of(docs).alias("_text"))
    # A filter on kept alone would be pushed below the projections and repeat their expressions at every level; what is
    # not deterministic stays where it is.
    judged = verdicts(measured(packed), rules).select("_row", "kept", F.monotonically_increasing_id().alias("_mark"))
    return judged.filter("kept and _mark >= 0").select("_row.*")
