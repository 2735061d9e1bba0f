"""Registered queries of the core library, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import bits
from termloom.operators import codecs, fst, lookup, metadata
from termloom.plans import terms
from termloom.store import checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOK = r"""tok AS (SELECT doc_id AS doc, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
post AS (SELECT term, doc, count(*) AS freq FROM tok GROUP BY term, doc),
td AS MATERIALIZED (SELECT term, count(*) AS doc_freq, sum(freq)::BIGINT AS total_term_freq, CASE WHEN count(*) = 1 THEN min(doc) END AS singleton_doc FROM post GROUP BY term)"""
FIELDS = TOK + """, fp AS (SELECT 'text' AS field, term, doc, freq FROM post UNION ALL SELECT 'lang', lang, doc_id, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang, doc_id UNION ALL SELECT 'source', source, doc_id, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source, doc_id),
ft AS (SELECT field, term, count(*) AS df, sum(freq)::BIGINT AS ttf, CASE WHEN count(*) = 1 THEN min(doc) END AS singleton_doc FROM fp GROUP BY field, term),
fm AS (SELECT field, count(*) AS num_terms, sum(ttf)::BIGINT AS sum_total_term_freq, sum(df)::BIGINT AS sum_doc_freq, min(term) AS min_term, max(term) AS max_term, (SELECT count(DISTINCT doc) FROM fp WHERE fp.field = ft.field) AS doc_count FROM ft GROUP BY field)"""


def query(sql: str | None = None, lists: tuple[str, ...] = ()):
    """Registers a query; its list columns named here are given as text, items joined by commas, in both forms."""

    def add(f):
        def run(spark, d):
            df = f(spark, d)
            return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in lists}) if lists else df

        QUERIES[f.__name__] = wraps(f)(run)
        if sql:
            replaced = ", ".join(f"coalesce(array_to_string({c}, ','), '') AS {c}" for c in lists)
            SQL[f.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if lists else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _post(spark: SparkSession, d: str) -> DataFrame:
    return terms.postings(terms.tokens(table(spark, d, "documents")))


def _dict(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_dictionary(_post(spark, d))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Unique keys with a numeric output."""
    return _dict(spark, d).select("term", F.col("total_term_freq").alias("output"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Order keys as non-negative test numbers of several widths."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * F.col("o_orderkey") * 31 % 2147483648).alias("n"))


@query(f"WITH {TOK} SELECT * FROM td")
def term_dictionary(spark, d):
    return _dict(spark, d)


@query(f"WITH {FIELDS} SELECT * FROM fm")
def field_meta(spark, d):
    return terms.field_meta(table(spark, d, "documents"))


@query(f"WITH {FIELDS} SELECT field, doc_count >= 0 AND doc_count <= (SELECT count(*) FROM documents) AND sum_doc_freq >= doc_count AND sum_total_term_freq >= sum_doc_freq AS sound FROM fm")
def field_meta_sound(spark, d):
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("max_doc"))
    m = terms.field_meta(docs).join(F.broadcast(n))
    return m.select("field", ((F.col("doc_count") >= 0) & (F.col("doc_count") <= F.col("max_doc")) & (F.col("sum_doc_freq") >= F.col("doc_count")) & (F.col("sum_total_term_freq") >= F.col("sum_doc_freq"))).alias("sound"))


SEEK = f"""WITH {FIELDS}, t AS (SELECT 'text' AS field, lower(o_orderpriority) AS target FROM orders UNION SELECT 'text', lower(regexp_extract(p_name, '^[A-Za-z]+')) FROM part UNION SELECT 'lang', lower(left(n_name, 2)) FROM nation UNION SELECT 'source', 'src' || n_nationkey FROM nation UNION SELECT * FROM (VALUES ('text', 'the'), ('text', '!'), ('text', 'zzzz~'), ('text', 'que')))
SELECT t.field, t.target, t.target BETWEEN fm.min_term AND fm.max_term AS in_range, ft.term IS NOT NULL AS found, ft.df AS doc_freq, ft.ttf AS total_term_freq, ft.singleton_doc
FROM t JOIN fm USING (field) LEFT JOIN ft ON ft.field = t.field AND ft.term = t.target AND t.target BETWEEN fm.min_term AND fm.max_term"""


def seek_targets(spark, d):
    """Distinct targets of three fields, some of them outside their fields' bounds."""
    nation = table(spark, d, "nation")
    t = table(spark, d, "orders").select(F.lit("text").alias("field"), F.lower("o_orderpriority").alias("target"))
    t = t.union(table(spark, d, "part").select(F.lit("text"), F.lower(F.regexp_extract("p_name", "^[A-Za-z]+", 0))))
    t = t.union(nation.select(F.lit("lang"), F.lower(F.left("n_name", F.lit(2))))).union(nation.select(F.lit("source"), F.concat(F.lit("src"), "n_nationkey")))
    return t.union(spark.createDataFrame([("text", "the"), ("text", "!"), ("text", "zzzz~"), ("text", "que")], "field string, target string")).distinct()


@query(SEEK)
def seek_exact(spark, d):
    """The flagship: exact-term lookup with range pruning. Only the targets' postings are counted."""
    docs, t = table(spark, d, "documents"), checkpoint(seek_targets(spark, d), "targets")
    return lookup.seek_exact(t, terms.field_bounds(docs), terms.wanted_terms(docs, t))


@query("SELECT o_orderkey AS k, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def field_lookup(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("k"), "name")


@query(f"WITH {TOK} SELECT term, singleton_doc FROM td WHERE doc_freq = 1")
def singleton_docs(spark, d):
    return _dict(spark, d).filter("doc_freq = 1").select("term", "singleton_doc")


@query(f"""WITH {TOK}, o AS (SELECT left(term, 1) AS block, doc_freq = 1 AND total_term_freq = 1 AS single, row_number() OVER (PARTITION BY left(term, 1) ORDER BY term) AS i, row_number() OVER (PARTITION BY left(term, 1), doc_freq = 1 AND total_term_freq = 1 ORDER BY term) AS j FROM td)
SELECT block, min(i) AS first_rank, count(*) AS run_length FROM o WHERE single GROUP BY block, i - j""")
def singleton_runs(spark, d):
    """Runs of consecutive terms that occur once, inside blocks of one first character."""
    return terms.singleton_runs(_dict(spark, d))


@query(f"WITH {TOK} SELECT term, doc_freq > 128 AS has_skip, total_term_freq > 128 AS has_blocks FROM td WHERE total_term_freq > 128")
def long_postings(spark, d):
    return terms.long_postings(_dict(spark, d))


@query(f"WITH {TOK} SELECT * FROM post")
def postings(spark, d):
    return _post(spark, d)


@query(f"WITH {TOK} SELECT term, doc, doc - lag(doc, 1, 0) OVER (PARTITION BY term ORDER BY doc) AS delta, row_number() OVER (PARTITION BY term ORDER BY doc) - 1 AS rank FROM post")
def postings_delta(spark, d):
    return terms.doc_deltas(checkpoint(_post(spark, d), "postings"))


@query(f"WITH {TOK} SELECT left(term, 1) AS block, term, coalesce(sum(doc_freq) OVER (PARTITION BY left(term, 1) ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM td")
def postings_start_offsets(spark, d):
    return terms.start_offsets(_dict(spark, d))


_BLOCKS = f"{TOK}, de AS (SELECT term, doc - lag(doc, 1, 0) OVER (PARTITION BY term ORDER BY doc) AS delta, (row_number() OVER (PARTITION BY term ORDER BY doc) - 1) // 128 AS block FROM post)"


@query(f"WITH {_BLOCKS} SELECT term, block, count(*) AS entries, max(delta) AS highest, CASE WHEN max(delta) = 0 THEN 0 ELSE length(ltrim(bin(max(delta)), '0')) END AS width, min(delta) = max(delta) AS all_equal FROM de GROUP BY term, block")
def block128_width(spark, d):
    g = terms.doc_deltas(checkpoint(_post(spark, d), "postings")).withColumn("block", F.expr("rank div 128"))
    return g.groupBy("term", "block").agg(F.count("*").alias("entries"), F.max("delta").alias("highest"), bits.msb(F.max("delta")).alias("width"), (F.min("delta") == F.max("delta")).alias("all_equal"))


@query(f"""WITH {_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY term, block ORDER BY delta DESC) AS k, count(*) OVER (PARTITION BY term, block) AS n FROM de),
w AS (SELECT term, block, greatest(1, max(CASE WHEN k = 8 THEN length(ltrim(bin(delta), '0')) ELSE 1 END), max(CASE WHEN k = 1 THEN length(ltrim(bin(delta), '0')) - 8 ELSE 1 END)) AS width FROM r WHERE k <= 8 AND n = 128 GROUP BY term, block)
SELECT w.term, w.block, w.width::BIGINT AS width, count(*) FILTER (WHERE delta >= (1::BIGINT << w.width::INT)) AS exceptions FROM w JOIN r USING (term, block) GROUP BY ALL""")
def pfor_exceptions(spark, d):
    """Width and number of exceptions of full blocks: the eighth largest sets the width, the largest may stand out by eight bits."""
    g = terms.doc_deltas(checkpoint(_post(spark, d), "postings")).groupBy("term", F.expr("rank div 128").alias("block")).agg(F.sort_array(F.collect_list("delta"), asc=False).alias("v")).filter(F.size("v") == terms.BLOCK)
    width = F.greatest(bits.long(1), bits.msb(F.col("v")[7]), bits.msb(F.col("v")[0]) - 8)
    g = g.withColumn("width", width)
    return g.select("term", "block", "width", F.size(F.filter("v", lambda x: F.call_function("shiftright", x, F.col("width").cast("int")) > 0)).cast("long").alias("exceptions"))


@query(f"WITH {TOK} SELECT left(term, 2) AS prefix, count(*) AS entries, min(term) AS min_term, max(term) AS max_term, min(greatest(length(term) - 2, 0)) AS min_suffix, max(greatest(length(term) - 2, 0)) AS max_suffix, min(greatest(length(term) - 2, 0)) = max(greatest(length(term) - 2, 0)) AS all_equal FROM td GROUP BY 1")
def prefix_blocks(spark, d):
    return terms.prefix_blocks(_dict(spark, d))


@query(f"""WITH {TOK}, b AS (SELECT left(term, 2) AS prefix, substr(term, 3, 1) AS label, count(*) AS entries FROM td WHERE length(term) > 2 GROUP BY 1, 2),
t AS (SELECT DISTINCT b1.prefix, x.target_label FROM (SELECT DISTINCT prefix FROM b) b1 CROSS JOIN (VALUES ('0'), ('c'), ('m'), ('z')) x(target_label)),
f AS (SELECT prefix, min(label) AS first_label FROM b GROUP BY prefix)
SELECT t.prefix, t.target_label, max(b.label) AS label, arg_max(b.entries, b.label) AS entries FROM t JOIN f USING (prefix) JOIN b ON b.prefix = t.prefix AND b.label <= greatest(t.target_label, f.first_label) GROUP BY 1, 2""")
def floor_block_lookup(spark, d):
    b = lookup.floor_blocks(_dict(spark, d))
    labels = F.explode(F.array(*map(F.lit, ("0", "c", "m", "z"))))
    return lookup.floor_lookup(b.select("prefix").distinct().withColumn("target_label", labels), b)


_LCP = "list_max(list_filter(range(least(length(term), length(before)) + 1), lambda i: left(term, i) = left(before, i)))"


@query(f"WITH {TOK}, o AS (SELECT term, lag(term, 1, '') OVER (PARTITION BY left(term, 1) ORDER BY term) AS before FROM td), p AS (SELECT term, {_LCP} AS shared FROM o) SELECT term, shared::BIGINT AS shared, substr(term, shared::INT + 1) AS rest FROM p")
def shared_prefix(spark, d):
    return terms.shared_prefixes(_dict(spark, d))


_PRE = f"{TOK}, pre AS (SELECT term, total_term_freq AS output, unnest(range(1, length(term) + 1)) AS depth FROM td), pot AS MATERIALIZED (SELECT left(term, depth::INT) AS prefix, min(output) AS potential, left(left(term, depth::INT), depth::INT - 1) AS above FROM pre GROUP BY ALL)"


@query(f"WITH {_PRE} SELECT DISTINCT left(prefix, length(prefix)::INT - 1) AS node, right(prefix, 1) AS label FROM pot")
def trie_edges(spark, d):
    return fst.trie_edges(_dict(spark, d))


_ARCS = f"""WITH {_PRE}, arc AS (SELECT p.above AS node, right(p.prefix, 1) AS label, p.prefix AS target, (p.potential - coalesce(q.potential, 0))::BIGINT AS output, (td.total_term_freq - p.potential)::BIGINT AS final_output
FROM pot p LEFT JOIN pot q ON q.prefix = p.above LEFT JOIN td ON td.term = p.prefix)"""


@query(f"{_ARCS} SELECT * FROM arc")
def fst_int_outputs(spark, d):
    return fst.arcs(checkpoint(_entries(spark, d), "entries"))


_SLCP = "list_max(list_filter(range(least(length(lo), length(hi)) + 1), lambda i: left(lo, i) = left(hi, i)))::INT"


@query(f"""WITH {TOK}, e AS (SELECT term, 's' || total_term_freq AS output FROM td), pre AS (SELECT term, output, unnest(range(1, length(term) + 1)) AS depth FROM e),
lh AS MATERIALIZED (SELECT left(term, depth::INT) AS prefix, min(output) AS lo, max(output) AS hi FROM pre GROUP BY 1), pot AS MATERIALIZED (SELECT prefix, left(prefix, length(prefix)::INT - 1) AS above, left(lo, {_SLCP}) AS potential FROM lh)
SELECT p.above AS node, right(p.prefix, 1) AS label, p.prefix AS target, substr(p.potential, length(coalesce(q.potential, ''))::INT + 1) AS output, substr(e.output, length(p.potential)::INT + 1) AS final_output
FROM pot p LEFT JOIN pot q ON q.prefix = p.above LEFT JOIN e ON e.term = p.prefix""")
def fst_string_outputs(spark, d):
    e = _dict(spark, d).select("term", F.concat(F.lit("s"), F.col("total_term_freq").cast("string")).alias("output"))
    return fst.arcs(checkpoint(e, "entries"), fst.Strings)


_Q = "q AS (SELECT DISTINCT lower(replace(p_name, ' ', '')) AS query FROM part UNION SELECT term || 'x' FROM td WHERE doc_freq = 2)"


def _queries(spark, d, dictionary):
    part = table(spark, d, "part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("query"))
    return part.union(dictionary.filter("doc_freq = 2").select(F.concat("term", F.lit("x")))).distinct()


def queries_and_entries(spark, d):
    """Queries, and keys with a numeric output, from one dictionary that is built once."""
    dictionary = checkpoint(_dict(spark, d), "dictionary")
    return _queries(spark, d, dictionary), dictionary.select("term", F.col("total_term_freq").alias("output"))


@query(f"WITH {TOK}, {_Q} SELECT query, term IS NOT NULL AS accepted, total_term_freq AS output FROM q LEFT JOIN td ON td.term = q.query")
def fst_accept(spark, d):
    return fst.accept(*queries_and_entries(spark, d))


@query(f"""WITH {_PRE}, {_Q}, x AS (SELECT query, unnest(range(1, length(query) + 1)) AS depth FROM q), h AS (SELECT x.query, x.depth, coalesce(td.total_term_freq, pot.potential) AS v FROM x JOIN pot ON pot.prefix = left(x.query, x.depth::INT) LEFT JOIN td ON td.term = pot.prefix)
SELECT q.query, coalesce(max(h.depth), 0)::BIGINT AS path_length, coalesce(arg_max(h.v, h.depth), 0)::BIGINT AS output FROM q LEFT JOIN h USING (query) GROUP BY q.query""")
def fst_match_path(spark, d):
    return fst.match_path(*queries_and_entries(spark, d))


@query(f"""WITH {TOK}, {_Q}, x AS (SELECT query, unnest(range(1, length(query) + 1)) AS depth FROM q), h AS (SELECT x.query, x.depth, td.term, td.total_term_freq AS v FROM x JOIN td ON td.term = left(x.query, x.depth::INT))
SELECT q.query, arg_max(h.term, h.depth) AS match, arg_max(h.v, h.depth)::BIGINT AS output FROM q LEFT JOIN h USING (query) GROUP BY q.query""")
def fst_match_key(spark, d):
    return lookup.match_key(*queries_and_entries(spark, d))


@query(f"""WITH {TOK}, pre AS (SELECT term, total_term_freq AS output, unnest(range(0, length(term) + 1)) AS depth FROM td),
pot AS (SELECT left(term, depth::INT) AS prefix, min(output) AS low FROM pre GROUP BY 1),
sig AS (SELECT left(pre.term, pre.depth::INT) AS prefix, count(*) AS keys, string_agg(substr(pre.term, pre.depth::INT + 1) || ':' || (pre.output - pot.low), ',' ORDER BY pre.term) AS signature FROM pre JOIN pot ON pot.prefix = left(pre.term, pre.depth::INT) GROUP BY 1)
SELECT keys, count(DISTINCT signature) AS states, count(*) AS nodes FROM sig GROUP BY keys""")
def fst_minimal_states(spark, d):
    """States of the minimal transducer of the whole dictionary, by how many keys lie below them."""
    return fst.state_classes(_entries(spark, d))


@query(f"""{_ARCS} SELECT '"' || node || '" -> "' || target || '" [label="' || label || '/' || output || '"' || CASE WHEN final_output IS NOT NULL THEN ' peripheries=2' ELSE '' END || ']' AS line FROM arc""")
def fst_dot(spark, d):
    return fst.dot_lines(fst.arcs(checkpoint(_entries(spark, d), "entries")))


_N = "n AS (SELECT o_orderkey AS k, (o_orderkey * o_orderkey * 31 % 2147483648)::BIGINT AS n FROM orders)"


@query(f"WITH {_N} SELECT k, n * 2 AS plus, n * 2 - 1 AS minus, n AS back FROM n WHERE n > 0")
def zigzag(spark, d):
    n = _keys(spark, d).filter("n > 0")
    return n.select("k", bits.zigzag(F.col("n")).alias("plus"), bits.zigzag(-F.col("n")).alias("minus"), bits.unzigzag(bits.zigzag(F.col("n"))).alias("back"))


@query(f"WITH {_N} SELECT k, CASE WHEN n = 0 THEN 0 ELSE length(ltrim(bin(n), '0')) END AS msb, bit_count(n)::BIGINT AS popcount, bit_count(n & 1023)::BIGINT AS rank10, (n >> 3) & 1 = 1 AS bit3, lpad(bin(n), 32, '0') AS binary32, CASE WHEN n = 0 THEN 1 ELSE (length(ltrim(bin(n), '0')) + 6) // 7 END AS vint_length FROM n")
def bit_functions(spark, d):
    n = F.col("n")
    return _keys(spark, d).select("k", bits.msb(n).alias("msb"), F.bit_count(n).cast("long").alias("popcount"), bits.rank(n, 10).alias("rank10"), bits.flag(n, 8).alias("bit3"), bits.binary(n, 32).alias("binary32"), bits.vint_length(n).alias("vint_length"))


@query("SELECT p_partkey AS k, regexp_replace(hex(p_brand::BLOB), '(..)', '\\1 ', 'g') AS pairs, '[ ' || list_aggregate(list_transform(range(1, length(p_brand) + 1), lambda i: ascii(substr(p_brand, i::INT, 1))::VARCHAR), 'string_agg', '; ') || ' ]' AS bytes, reverse(p_brand) AS backward FROM part")
def byte_functions(spark, d):
    b = F.encode("p_brand", "UTF-8")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), bits.hex_pairs(b).alias("pairs"), bits.byte_list(b).alias("bytes"), F.decode(bits.reversed_bytes(b), "UTF-8").alias("backward"))


@query(f"""WITH {_N}, s AS (SELECT k, unnest([n, -n]) AS n FROM n), u AS (SELECT k, n, CASE WHEN n < 0 THEN n + 4294967296 ELSE n END AS u FROM s), z AS (SELECT *, CASE WHEN u = 0 THEN 1 ELSE (length(ltrim(bin(u), '0')) + 6) // 7 END AS size FROM u)
SELECT k, n, list_aggregate(list_transform(range(size), lambda i: printf('%02X', ((u >> (7 * i)::INT) & 127) + CASE WHEN i < size - 1 THEN 128 ELSE 0 END)), 'string_agg', '') AS bytes, u AS back, size FROM z""")
def vint_round_trip(spark, d):
    v = _keys(spark, d).select("k", F.explode(F.array("n", -F.col("n"))).alias("n")).withColumn("v", bits.vint(F.col("n")))
    return v.select("k", "n", F.col("v").alias("bytes"), bits.unvint(F.col("v")).alias("back"), bits.vint_length(F.col("n")).alias("size"))


@query("SELECT l_orderkey AS k, l_linenumber AS line, (l_linenumber * 65536 + l_quantity::BIGINT * 256 + l_linenumber)::BIGINT AS word, [l_linenumber::BIGINT, l_quantity::BIGINT, l_linenumber::BIGINT] AS back FROM lineitem", lists=("back",))
def lane_packing(spark, d):
    items = F.array(*[F.col(c).cast("long") for c in ("l_linenumber", "l_quantity", "l_linenumber")])
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), items.alias("items")).withColumn("word", bits.packed_long(F.col("items"), 8))
    return p.select("k", "line", "word", bits.unpacked_long(F.col("word"), 8, 3).alias("back"))


_BYTES = """WITH b AS (SELECT row_number() OVER () AS r, {id}, coalesce({text}, '') AS t, regexp_extract_all(hex(encode(coalesce({text}, ''))), '..') AS x FROM {table}),
o AS (SELECT *, list_filter(range(len(x)), lambda i: NOT (x[i + 1] BETWEEN '1F' AND '3E' OR x[i + 1] BETWEEN '5F' AND '7E')) AS odd FROM b),
c AS (SELECT *, len(x) AS n, len(odd) + coalesce(list_sum(list_transform(range(len(odd)), lambda j: greatest(odd[j + 1] - CASE WHEN j = 0 THEN 0 ELSE odd[j] END - 1, 0) // 255)), 0) AS exceptions FROM o),
z AS (SELECT {id}, t, n, (n - n // 4 + CASE WHEN exceptions < 128 THEN 1 WHEN exceptions < 16384 THEN 2 ELSE 3 END + 2 * exceptions)::BIGINT AS packed FROM c)"""


@query(_BYTES.format(id="p_partkey", text="p_name", table="part") + " SELECT p_partkey AS k, packed AS bytes FROM z")
def ascii_exceptions(spark, d):
    """Exceptions of the codec, with those that only bridge a gap, and its size."""
    b = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.encode("p_name", "UTF-8").alias("b"))
    return codecs.round_trips(b, "b").select("k", F.col("lowercase_ascii_bytes").alias("bytes"))


@query(_BYTES.format(id="doc_id", text="text", table="documents") + " SELECT doc_id, n AS none_bytes, sha256(t) AS none_sha256, packed AS lowercase_ascii_bytes, sha256(t) AS lowercase_ascii_sha256, sha256(t) AS lz4_sha256 FROM z")
def byte_codec_round_trip(spark, d):
    """What each codec gives back of whole texts, and the sizes of its bytes."""
    b = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    return codecs.round_trips(b, "b").drop("lz4_bytes")


@query("""WITH v AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 128 AS block, o_orderkey, o_custkey % 512 + CASE WHEN o_orderkey % 61 = 0 THEN o_custkey % 7 * 4096 ELSE 0 END AS v FROM orders),
b AS (SELECT block, list(v ORDER BY o_orderkey) AS back, list_reverse_sort(list(v)) AS top FROM v GROUP BY block HAVING count(*) = 128),
w AS (SELECT *, greatest(1, length(ltrim(bin(top[8]), '0')), length(ltrim(bin(top[1]), '0')) - 8) AS width FROM b),
x AS (SELECT *, len(list_filter(back, lambda x: x >> width::INT > 0)) AS odd, top[1] < 256 AND len(list_distinct(list_transform(back, lambda x: x & ((1 << width::INT) - 1)))) = 1 AS equal FROM w)
SELECT block, (odd * 32 + CASE WHEN equal THEN 0 ELSE width END)::BIGINT AS token, (1 + CASE WHEN equal THEN 1 ELSE 16 * width END + 2 * odd)::BIGINT AS bytes, back FROM x""", lists=("back",))
def pfor_round_trip(spark, d):
    """Full blocks of 128 numbers, some far above the others, as patched frames and back."""
    v = F.col("o_custkey") % 512 + F.when(F.col("o_orderkey") % 61 == 0, F.col("o_custkey") % 7 * 4096).otherwise(0)
    o = terms.numbered(table(spark, d, "orders").select("o_orderkey", v.alias("v")), "o_orderkey")
    g = o.groupBy(F.expr("number div 128").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "v"))), lambda s: s["v"]).alias("v")).filter(F.size("v") == codecs.BLOCK)
    return codecs.packed_blocks(g, "v")


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 1 THEN 'name: expected Terms, found Other' WHEN s_suppkey % 7 NOT BETWEEN 2 AND 6 THEN 'version: expected 2..6, found ' || s_suppkey % 7 WHEN s_suppkey % 3 = 0 THEN 'id: expected AB, found CD' WHEN s_suppkey % 4 = 0 THEN 'suffix: expected s0, found s1' END AS error, s_suppkey % 2 = 0 AS footer FROM supplier""")
def header_check(spark, d):
    k = F.col("s_suppkey")
    h = table(spark, d, "supplier").select(k.alias("k"), F.when(k % 5 == 1, "Other").otherwise("Terms").alias("name"), (k % 7).alias("version"), F.when(k % 3 == 0, "CD").otherwise("AB").alias("object_id"), F.when(k % 4 == 0, "s1").otherwise("s0").alias("suffix"))
    return h.select("k", metadata.header_error("Terms", 2, 6, "AB", "s0").alias("error"), metadata.footer_ok(16 + F.col("k") % 2, F.lit(~metadata.MAGIC & 0xFFFFFFFF)).alias("footer"))


@query("""SELECT p_partkey AS k, ['none', 'docs', 'freqs', 'positions', 'offsets'][(p_partkey % 5)::INT + 1] AS index_options, p_partkey % 5 >= 2 AS has_freqs, p_partkey % 5 >= 3 AS has_positions, p_partkey % 5 >= 4 AS has_offsets, p_partkey % 5 >= 3 AS has_prox, p_size & 1 <> 0 AS store_term_vector, p_size & 2 <> 0 AS omit_norms, p_size & 4 <> 0 AS store_payloads, p_size & 8 <> 0 AS is_soft_deletes_field FROM part""")
def field_capabilities(spark, d):
    code = F.col("p_partkey") % 5
    flags = {k: bits.flag(F.col("p_size"), m).alias(k) for k, m in metadata.FLAGS.items()}
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), metadata.of_code(code, metadata.INDEX_OPTIONS).alias("index_options"), *[c.alias(n) for n, c in metadata.capabilities(code).items()], *flags.values())


@query("SELECT p_brand AS brand, bool_and(p_partkey % 5 >= 3) AS has_prox, bool_and(p_size > 0) AS has_payloads FROM part GROUP BY p_brand")
def field_rollup(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(metadata.for_all(F.col("p_partkey") % 5 >= 3).alias("has_prox"), metadata.for_all(F.col("p_size") > 0).alias("has_payloads"))


@query("SELECT c_mktsegment AS segment, min(c_name) AS key, arg_min(c_custkey, c_name) AS first FROM customer GROUP BY c_mktsegment")
def dedup_first(spark, d):
    """The first entry of each group in key order: an aggregate, so no group is sorted in one task."""
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.min(F.struct("c_name", "c_custkey")).alias("m")).select("segment", F.col("m.c_name").alias("key"), F.col("m.c_custkey").alias("first"))


@query("SELECT c_custkey AS k, (length(c_name) + 3) // 4 AS pieces, substr(c_name, 5, 4) AS second, left(c_name, 3) AS taken, substr(c_name, 4) AS dropped, right(c_name, 1) AS last, instr(c_name, '#') - 1 AS index_of FROM customer")
def list_functions(spark, d):
    a = F.filter(F.split("c_name", ""), lambda c: c != "")
    c = bits.chunks(F.col("a"), 4)
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), a.alias("a"))
    return t.select("k", F.size(c).cast("long").alias("pieces"), F.array_join(F.get(c, 1), "").alias("second"), F.array_join(F.slice("a", 1, 3), "").alias("taken"), F.array_join(F.slice("a", 4, 1 << 30), "").alias("dropped"), F.element_at("a", -1).alias("last"), (F.array_position("a", "#") - 1).alias("index_of"))


from termloom import byte_queries  # noqa: E402, F401  (adds its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
