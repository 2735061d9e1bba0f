"""Logical tables of an inverted index, derived from ordinary DataFrames.

Defined results: a null or empty text has no terms; a null id is one document; rows that share an id are one document;
null values of other fields are no terms; an empty table gives no rows; columns that are not named here are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.functions.bits import common_prefix_length
from termloom.plans.order import numbered, running, with_previous  # noqa: F401

#: Ids in a packed block of integers, and the length from which skip data pays.
BLOCK = 128


def tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, position, term: runs of letters and digits, lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return docs.select(F.col(doc).alias("doc"), F.posexplode(words).alias("position", "term"))


def postings(toks: DataFrame) -> DataFrame:
    """term, doc, freq: combined on the map side before the one shuffle."""
    return toks.groupBy("term", "doc").agg(F.count("*").alias("freq"))


def term_dictionary(post: DataFrame) -> DataFrame:
    """term, doc_freq, total_term_freq, singleton_doc (only where one document has the term)."""
    d = post.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("freq").alias("total_term_freq"), F.min("doc").alias("singleton_doc"))
    return d.withColumn("singleton_doc", F.when(F.col("doc_freq") == 1, F.col("singleton_doc")))


def field_postings(docs: DataFrame) -> DataFrame:
    """field, term, doc, freq of the text field and two exact-value fields."""
    text = postings(tokens(docs)).select(F.lit("text").alias("field"), "term", "doc", "freq")
    exact = [docs.filter(F.col(c).isNotNull()).select(F.lit(c).alias("field"), F.col(c).alias("term"), F.col("doc_id").alias("doc")).groupBy("field", "term", "doc").agg(F.count("*").alias("freq")) for c in ("lang", "source")]
    return text.unionByName(exact[0]).unionByName(exact[1])


def field_terms(fields: DataFrame) -> DataFrame:
    """field, term, doc_freq, total_term_freq, singleton_doc."""
    d = fields.groupBy("field", "term").agg(F.count("*").alias("doc_freq"), F.sum("freq").alias("total_term_freq"), F.min("doc").alias("singleton_doc"))
    return d.withColumn("singleton_doc", F.when(F.col("doc_freq") == 1, F.col("singleton_doc")))


def field_bounds(docs: DataFrame) -> DataFrame:
    """field, min_term, max_term: a row per task and field is all that is shuffled."""
    text = tokens(docs).select(F.lit("text").alias("field"), "term")
    for c in ("lang", "source"):
        text = text.unionByName(docs.select(F.lit(c).alias("field"), F.col(c).alias("term")))
    return text.filter("term is not null").groupBy("field").agg(F.min("term").alias("min_term"), F.max("term").alias("max_term"))


def field_docs(docs: DataFrame) -> DataFrame:
    """field, doc_count: documents with a term, from one row per document and field."""
    has = {"text": F.coalesce(F.regexp_like("text", F.lit(r"[\p{L}\p{N}]")), F.lit(False)), "lang": F.col("lang").isNotNull(), "source": F.col("source").isNotNull()}
    rows = docs.select("doc_id", F.explode(F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in has.items()]), lambda n: n.isNotNull())).alias("field"))
    return rows.distinct().groupBy("field").agg(F.count("*").alias("doc_count"))


def field_meta(docs: DataFrame) -> DataFrame:
    """One row per field: num_terms, sum_total_term_freq, sum_doc_freq, doc_count, min_term, max_term.

    docs: doc_id, text, lang, source. A null text has no terms; a null id is a document; an empty table gives no rows."""
    terms = field_terms(field_postings(docs))
    by_term = terms.groupBy("field").agg(F.count("*").alias("num_terms"), F.sum("total_term_freq").alias("sum_total_term_freq"), F.sum("doc_freq").alias("sum_doc_freq"), F.min("term").alias("min_term"), F.max("term").alias("max_term"))
    return by_term.join(field_docs(docs), "field")


def wanted_terms(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """field, term, doc_freq, total_term_freq, singleton_doc of the targets (field, target) only: other tokens go before the shuffle,
    where Spark broadcasts the targets, or by a semi-join."""
    wanted = targets.select("field", F.col("target").alias("term")).distinct()
    text = postings(tokens(docs).join(wanted.filter("field = 'text'").select("term"), "term", "left_semi")).select(F.lit("text").alias("field"), "term", "doc", "freq")
    for c in ("lang", "source"):
        own = docs.select(F.col(c).alias("term"), F.col("doc_id").alias("doc")).join(wanted.filter(F.col("field") == c).select("term"), "term", "left_semi")
        text = text.unionByName(own.groupBy("term", "doc").agg(F.count("*").alias("freq")).select(F.lit(c).alias("field"), "term", "doc", "freq"))
    return field_terms(text)


def prefix_blocks(dictionary: DataFrame, length: int = 2) -> DataFrame:
    """Blocks of terms that share their first characters: sizes, bounds, suffix lengths."""
    d = dictionary.withColumns({"prefix": F.left("term", F.lit(length)), "suffix_length": F.greatest(F.length("term") - length, F.lit(0)).cast("long")})
    agg = d.groupBy("prefix").agg(F.count("*").alias("entries"), F.min("term").alias("min_term"), F.max("term").alias("max_term"), F.min("suffix_length").alias("min_suffix"), F.max("suffix_length").alias("max_suffix"))
    return agg.withColumn("all_equal", F.col("min_suffix") == F.col("max_suffix"))


#: Documents of a bucket of a term's postings.
DOC_BUCKET = 1 << 16


def doc_deltas(post: DataFrame, bucket: int = DOC_BUCKET) -> DataFrame:
    """term, doc, delta to the previous document of the term (the first: the document itself), rank from 0.

    Postings of a term are taken by ranges of documents, so that the commonest term's are dealt over many tasks; one
    row per range carries on the last document and the number of documents before it."""
    p = post.select("term", "doc", F.floor(F.col("doc") / bucket).alias("part"))
    parts = p.groupBy("term", "part").agg(F.max("doc").alias("last"), F.count("*").alias("n"))
    w = W.partitionBy("term").orderBy("part")
    parts = parts.select("term", "part", F.lag("last", 1, 0).over(w).alias("carried"), F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = W.partitionBy("term", "part").orderBy("doc")
    p = p.withColumns({"before": F.lag("doc").over(w), "place": F.row_number().over(w)}).join(parts, ["term", "part"])
    return p.select("term", "doc", (F.col("doc") - F.coalesce("before", "carried")).alias("delta"), (F.col("base") + F.col("place") - 1).cast("long").alias("rank"))


def long_postings(dictionary: DataFrame) -> DataFrame:
    """Terms whose postings have blocks, and whether they have skip data."""
    long = dictionary.filter(F.col("total_term_freq") > BLOCK)
    return long.select("term", (F.col("doc_freq") > BLOCK).alias("has_skip"), (F.col("total_term_freq") > BLOCK).alias("has_blocks"))


def singleton_runs(dictionary: DataFrame) -> DataFrame:
    """block (first character), first_rank, run_length: runs of consecutive terms that occur once."""
    single = (F.col("doc_freq") == 1) & (F.col("total_term_freq") == 1)
    t = dictionary.select("term", F.left("term", F.lit(1)).alias("block"), single.alias("single"))
    t = running(t, "term", i=F.lit(1).cast("long"), j=F.col("single").cast("long"))
    first = t.groupBy("block").agg(F.min("i").alias("start"))
    runs = t.filter("single").groupBy("block", F.expr("i - j")).agg(F.min("i").alias("i"), F.count("*").alias("run_length"))
    return runs.join(first, "block").select("block", (F.col("i") - F.col("start") + 1).alias("first_rank"), "run_length")


def start_offsets(dictionary: DataFrame) -> DataFrame:
    """block (first character), term, start: postings of the block's terms before."""
    t = running(dictionary.select("term", F.left("term", F.lit(1)).alias("block"), "doc_freq"), "term", start=F.col("doc_freq"))
    first = t.groupBy("block").agg(F.min("start").alias("low"))
    return t.join(first, "block").select("block", "term", (F.col("start") - F.col("low")).alias("start"))


def shared_prefixes(dictionary: DataFrame) -> DataFrame:
    """term, shared (characters in common with the term before), rest."""
    t = with_previous(dictionary.select("term"), "term")
    t = t.withColumn("shared", common_prefix_length(F.col("term"), F.col("before")))
    return t.select("term", "shared", F.substr("term", (F.col("shared") + 1).cast("int")).alias("rest"))
