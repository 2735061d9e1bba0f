"""Registered queries over bytes: index files, byte transducers, the block seek, bit tables, codecs, states."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import binary, bits, lists
from termloom.operators import block_seek as blocks
from termloom.operators import byte_fst, codecs, metadata
from termloom.plans import terms
from termloom.queries import _N, _Q, SEEK, TOK, _dict, _keys, checkpoint, queries_and_entries, query, seek_targets, table
from termloom.sources import layouts, lines


@query(SEEK)
def block_seek(spark, d):
    """The exact-term lookup through the bytes of a dictionary: prefix transducer, floor block, suffixes, term states."""
    docs = table(spark, d, "documents")
    dictionary = checkpoint(terms.field_terms(terms.field_postings(docs)), "dictionary")
    index = blocks.build(dictionary)
    index = blocks.Index(checkpoint(index.blocks, "blocks"), checkpoint(index.prefixes, "prefixes"))
    bounds = dictionary.groupBy("field").agg(F.min("term").alias("min_term"), F.max("term").alias("max_term"))
    return blocks.seek(seek_targets(spark, d), bounds, index)


@query(f"WITH {TOK}, {_Q} SELECT query, term IS NOT NULL AS accepted, total_term_freq AS output FROM q LEFT JOIN td ON td.term = q.query")
def fst_bytes_accept(spark, d):
    """Keys dealt by hash into shards of some 50,000, each a minimal transducer in bytes."""
    asked, entries = queries_and_entries(spark, d)
    shards = max(1, entries.count() // 50_000)
    built = byte_fst.build(byte_fst.sharded(entries, "term", shards), "shard")
    return byte_fst.lookup(byte_fst.sharded(asked, "query", shards), built, "shard").select("query", "accepted", "output")


@query("""WITH w AS (SELECT p_brand AS brand, p_name AS term, min(p_partkey) AS output FROM part GROUP BY ALL), g AS (SELECT brand, ascii(left(term, 1)) AS label, min(output) AS pot FROM w GROUP BY ALL)
SELECT g.brand, g.label::BIGINT AS label, g.pot::BIGINT AS output, (w.output - g.pot)::BIGINT AS final_output FROM g LEFT JOIN w ON w.brand = g.brand AND w.term = chr(g.label)""")
def fst_root_arcs(spark, d):
    """The arcs that leave the root of each brand's transducer of part names."""
    e = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("output"))
    return byte_fst.root_arcs(byte_fst.build(e, "brand"), "brand")


@query("""WITH w AS (SELECT p_brand AS brand, p_name AS term, min(p_partkey) AS output FROM part GROUP BY ALL), pre AS (SELECT *, unnest(range(0, length(term) + 1)) AS depth FROM w),
pot AS (SELECT brand, left(term, depth::INT) AS prefix, min(output) AS low FROM pre GROUP BY ALL),
sig AS (SELECT pre.brand, prefix, string_agg(substr(term, depth::INT + 1) || ':' || (output - low), ',' ORDER BY term) AS signature, count(DISTINCT substr(term, depth::INT + 1, 1)) AS labels FROM pre JOIN pot ON pot.brand = pre.brand AND prefix = left(term, depth::INT) WHERE depth < length(term) GROUP BY ALL)
SELECT brand, count(*) AS nodes, sum(labels)::BIGINT AS arcs FROM (SELECT DISTINCT brand, signature, labels FROM sig) GROUP BY brand""")
def fst_bytes_dot(spark, d):
    """Nodes and arcs in the graphs of each brand's transducer, told from their lines."""
    e = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("output"))
    lines = byte_fst.dot_lines(byte_fst.build(e, "brand"), "brand")
    return lines.groupBy("brand").agg(F.countDistinct("node").alias("nodes"), F.countDistinct("line").alias("arcs"))


def _header(name, version, ident="0123456789ABCDEF", suffix="s0"):
    return F.struct(F.lit(layouts.MAGIC).cast("long").alias("magic"), name.alias("name"), version.cast("long").alias("version"), F.encode(F.lit(ident), "UTF-8").alias("object_id"), F.lit(suffix).alias("suffix"))


def _version(major, minor, bugfix):
    return F.struct(*[x.cast("long").alias(n) for x, n in ((major, "major"), (minor, "minor"), (bugfix, "bugfix"))])


def _pairs(**kv):
    return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in kv.items()])


_FOOTER = "cast(null as struct<remaining:bigint,magic:bigint,checksum_ok:boolean>)"


@query("""SELECT s_suppkey AS k, s_name AS name, s_suppkey % 9 AS major, CASE WHEN s_suppkey % 2 = 0 THEN 7 ELSE s_suppkey % 9 END AS min_major, (s_nationkey * 1000)::BIGINT AS doc_count, s_suppkey % 3 = 0 AS is_compound, 'p' || s_nationkey AS place, [s_name || '.si', s_name || '.cfs'] AS files, true AS footer,
'3FD76C17' || printf('%02X', length(s_name)) || hex(s_name::BLOB) || printf('%08X', s_suppkey % 4) AS head,
(4 + 1 + length(s_name) + 4 + 16 + 3 + 12 + 1 + CASE WHEN s_suppkey % 2 = 0 THEN 12 ELSE 0 END + 4 + 1 + (1 + 6 + 1 + length('p' || s_nationkey)) + (1 + 2 + 2 * length(s_name) + 7) + 1 + 1 + 16)::BIGINT AS bytes FROM supplier""", lists=("files",))
def segment_files(spark, d):
    """A segment file for each supplier, written and read back: header, versions, maps, lists, footer."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    value = F.struct(
        _header(name, k % 4).alias("header"), _version(k % 9, F.lit(2), F.lit(1)).alias("version"), F.when(k % 2 == 0, _version(F.lit(7), F.lit(0), F.lit(0))).alias("min_version"),
        (F.col("s_nationkey") * 1000).cast("long").alias("doc_count"), (k % 3 == 0).alias("is_compound"), _pairs(place=F.concat(F.lit("p"), F.col("s_nationkey").cast("string"))).alias("diagnostics"),
        F.array(F.concat(name, F.lit(".si")), F.concat(name, F.lit(".cfs"))).alias("files"), F.expr("cast(array() as array<struct<key:string,value:string>>)").alias("attributes"), F.expr("cast(array() as array<string>)").alias("sort_fields"), F.expr(_FOOTER).alias("footer"),
    )
    files = layouts.written(table(spark, d, "supplier").select(k.alias("k"), value.alias("value")), layouts.SEGMENT_INFO, "value").select("k", "content")
    r = layouts.parsed(files, layouts.SEGMENT_INFO)
    place = F.map_from_entries("record.diagnostics")["place"]
    head = F.hex(F.substring("content", F.lit(1), (4 + 1 + F.length("record.header.name") + 4).cast("int")))
    return r.select("k", F.col("record.header.name").alias("name"), F.col("record.version.major").alias("major"), F.col("record.min_version.major").alias("min_major"), F.col("record.doc_count").alias("doc_count"), F.col("record.is_compound").alias("is_compound"), place.alias("place"), F.col("record.files").alias("files"), metadata.footer_ok(F.col("record.footer.remaining"), F.col("record.footer.magic")).alias("footer"), head.alias("head"), F.octet_length("content").cast("long").alias("bytes"))


def _field_files(spark, d):
    """Files of some 64 fields, told from parts."""
    k = F.col("p_partkey")
    field = F.struct(
        F.col("p_name").alias("name"), k.cast("long").alias("number"), (F.col("p_size") % 16).cast("long").alias("flags"), (k % 5).cast("long").alias("index_options"), (k % 6).cast("long").alias("doc_values"),
        (k - 100).cast("long").alias("doc_values_gen"), _pairs(brand=F.col("p_brand")).alias("attributes"), (k % 3).cast("long").alias("dimensions"), (k % 2).cast("long").alias("index_dimensions"), F.lit(8).cast("long").alias("dimension_bytes"),
    )
    files = table(spark, d, "part").groupBy(F.expr("p_partkey div 64").alias("file")).agg(F.array_sort(F.collect_list(field)).alias("fields"))
    value = F.struct(_header(F.lit("Fields"), F.col("file") % 4).alias("header"), F.col("fields").alias("fields"), F.expr(_FOOTER).alias("footer"))
    content = layouts.written(files.select("file", value.alias("value")), layouts.FIELD_INFOS, "value").select("file", "content")
    return layouts.parsed(content, layouts.FIELD_INFOS)


_FIELD_SQL = """SELECT (p_partkey // 64)::BIGINT AS file, p_partkey AS number, p_name AS name, ['none', 'docs', 'freqs', 'positions', 'offsets'][(p_partkey % 5)::INT + 1] AS index_options, ['none', 'numeric', 'binary', 'sorted', 'sorted_numeric', 'sorted_set'][(p_partkey % 6)::INT + 1] AS doc_values,
p_size & 1 <> 0 AS store_term_vector, p_size & 2 <> 0 AS omit_norms, p_size & 4 <> 0 AS store_payloads, p_size & 8 <> 0 AS is_soft_deletes_field, p_partkey - 100 AS doc_values_gen, p_brand AS brand, p_partkey % 3 AS dimensions,
CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN (p_partkey // 64) % 4 >= 2 THEN p_partkey % 2 ELSE p_partkey % 3 END AS index_dimensions, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 8 END::BIGINT AS dimension_bytes FROM part"""


@query(_FIELD_SQL)
def field_files(spark, d):
    """Fields of a segment, written and read back, with names for their codes."""
    return metadata.fields(_field_files(spark, d), "file").select("file", "number", "name", "index_options", "doc_values", *metadata.FLAGS, "doc_values_gen", F.map_from_entries("attributes")["brand"].alias("brand"), "dimensions", "index_dimensions", "dimension_bytes")


@query("SELECT (p_partkey // 64)::BIGINT AS file, count(*) AS fields, bool_and(p_partkey % 5 >= 3) AS has_prox, bool_and(p_size & 4 <> 0) AS has_payloads, bool_and(p_partkey % 5 >= 4) AS has_offsets FROM part GROUP BY 1")
def field_file_rollup(spark, d):
    return metadata.rollup(metadata.fields(_field_files(spark, d), "file"), "file")


@query(f"WITH f AS ({_FIELD_SQL}) SELECT o.o_orderkey AS k, a.name AS by_number, b.number AS by_name FROM orders o JOIN f a ON a.number = o.o_orderkey % 50 + 1 LEFT JOIN (SELECT name, min(number) AS number FROM f GROUP BY name) b ON b.name = a.name || CASE WHEN o.o_orderkey % 2 = 0 THEN '' ELSE '?' END")
def field_by_number_and_name(spark, d):
    """Lookups of a field by its number (which must exist) and by its name (null if there is none)."""
    f = checkpoint(metadata.fields(_field_files(spark, d), "file").select("number", "name"), "fields")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 50 + 1).alias("wanted"))
    o = metadata.by_number(o, f, "wanted").withColumnRenamed("name", "by_number")
    o = o.withColumn("asked", F.concat("by_number", F.when(F.col("k") % 2 == 0, F.lit("")).otherwise(F.lit("?"))))
    return metadata.by_name(o, f, "asked").select("k", "by_number", F.col("number").alias("by_name"))


_META_SQL = SEEK[: SEEK.index(", t AS (")]


@query(f"{_META_SQL} SELECT field, num_terms, sum_total_term_freq, CASE WHEN field = 'text' THEN sum_doc_freq ELSE sum_total_term_freq END AS sum_doc_freq, doc_count, min_term, max_term, 128::BIGINT AS block_size, 'FST' AS fst_name, hex(min_term::BLOB) AS empty_output FROM fm")
def terms_meta_file(spark, d):
    """The terms' statistics as one file of three fields, read back; a field without frequencies has one sum for both."""
    m = terms.field_meta(table(spark, d, "documents"))
    number = F.when(F.col("field") == "text", 0).when(F.col("field") == "lang", 1).otherwise(2).cast("long")
    plain = F.struct(F.lit(layouts.MAGIC).cast("long").alias("magic"), F.lit(layouts.FST_NAME).alias("name"), F.lit(7).cast("long").alias("version"))
    fst = F.struct(plain.alias("header"), F.encode("min_term", "UTF-8").alias("empty_output"), F.lit(0).cast("long").alias("input_type"), (F.col("num_terms") + 1).alias("start_node"), F.col("num_terms").alias("num_bytes"))
    row = F.struct(number.alias("number"), F.when(number == 0, 3).otherwise(layouts.DOCS_ONLY).cast("long").alias("index_options"), "num_terms", F.encode("field", "UTF-8").alias("root_code"), "sum_total_term_freq", "sum_doc_freq", "doc_count", "min_term", "max_term", F.lit(300).cast("long").alias("index_start"), fst.alias("fst"))
    name = F.lit(layouts.TERMS_NAME), F.lit(layouts.POSTINGS_NAME)
    whole = m.agg(F.array_sort(F.collect_list(row)).alias("fields")).select(F.struct(_header(name[0], F.lit(4)).alias("header"), _header(name[1], F.lit(1)).alias("postings_header"), F.lit(128).cast("long").alias("block_size"), "fields", F.lit(5).cast("long").alias("index_length"), F.lit(6).cast("long").alias("terms_length"), F.expr(_FOOTER).alias("footer")).alias("value"))
    content = layouts.written(whole, layouts.TERMS_META, "value").select("content")
    r = layouts.parsed(content, layouts.TERMS_META, options={0: 3, 1: layouts.DOCS_ONLY, 2: layouts.DOCS_ONLY}).select("record.block_size", F.explode("record.fields").alias("f"))
    return r.select(F.decode("f.root_code", "UTF-8").alias("field"), *[F.col(f"f.{c}").alias(c) for c in ("num_terms", "sum_total_term_freq", "sum_doc_freq", "doc_count", "min_term", "max_term")], "block_size", F.col("f.fst.header.name").alias("fst_name"), F.hex("f.fst.empty_output").alias("empty_output"))


@query(f"""SELECT n_nationkey::BIGINT AS number, n_name AS segment, r_regionkey::BIGINT AS generation, (SELECT count(*) FROM nation x WHERE x.n_regionkey = r_regionkey) AS segments, [r_name] AS updates, n_name || '_{layouts.FILE_SUFFIX}.tim' AS terms_file
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = (SELECT max(r_regionkey) FROM region)""", lists=("updates",))
def latest_commit(spark, d):
    """A commit of each region's nations as its segments; all segments of the newest one."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    gen = F.lit(-1).cast("long")
    update = F.array(F.struct(F.col("n_nationkey").cast("long").alias("number"), F.array("r_name").alias("files")))
    segment = F.struct(F.col("n_name").alias("name"), F.encode(F.lit("0123456789ABCDEF"), "UTF-8").alias("object_id"), F.lit("codec").alias("codec"), gen.alias("deletion_gen"), F.lit(0).cast("long").alias("deletions"), gen.alias("field_infos_gen"), gen.alias("doc_values_gen"), F.lit(0).cast("long").alias("soft_deletions"), F.when(F.col("n_nationkey") % 2 == 0, F.encode(F.lit("FEDCBA9876543210"), "UTF-8")).alias("commit_id"), F.array("n_name").alias("field_infos_files"), update.alias("doc_values_updates"))
    c = n.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    version = _version(F.lit(8), F.lit(4), F.lit(1))
    value = F.struct(_header(F.lit("segments"), F.lit(10)).alias("header"), version.alias("version"), F.lit(8).cast("long").alias("created_major"), F.col("r_regionkey").cast("long").alias("commit_version"), F.lit(40).cast("long").alias("name_counter"), F.size("segments").cast("long").alias("segment_count"), version.alias("min_version"), "segments", _pairs(by=F.lit("test")).alias("user_data"), F.expr(_FOOTER).alias("footer"))
    files = layouts.written(c.select(F.concat(F.lit("index/segments_"), F.lower(F.conv(F.col("r_regionkey").cast("string"), 10, 36))).alias("path"), value.alias("value")), layouts.COMMIT, "value").select("path", "content")
    files = checkpoint(files, "commits")
    r = layouts.parsed(files.join(layouts.latest_commit(files.select("path")), "path"), layouts.COMMIT)
    s = r.select("generation", F.col("record.segment_count").alias("segments"), F.explode("record.segments").alias("s"))
    return s.select(F.col("s.doc_values_updates")[0]["number"].alias("number"), F.col("s.name").alias("segment"), "generation", "segments", F.map_from_entries("s.doc_values_updates")[F.col("s.doc_values_updates")[0]["number"]].alias("updates"), layouts.segment_file_name(F.col("s.name"), F.lit("tim")).alias("terms_file"))


_X = f"{_N}, x AS (SELECT k, n, n::HUGEINT * 2654435761 AS x FROM n), le AS (SELECT *, list_sum(list_transform(range(8), lambda i: ((x >> (8 * (7 - i))::INT) & 255)::HUGEINT << (8 * i)::INT))::HUGEINT AS swapped FROM x)"


@query(f"WITH {_X} SELECT k, (x >> 32)::BIGINT AS uint, CASE WHEN (x >> 32) >= 2147483648 THEN (x >> 32) - 4294967296 ELSE x >> 32 END::BIGINT AS int, x::BIGINT AS long, CASE WHEN (swapped & 4294967295) >= 2147483648 THEN (swapped & 4294967295) - 4294967296 ELSE swapped & 4294967295 END::BIGINT AS int_little, CASE WHEN swapped >= 9223372036854775808 THEN swapped - 18446744073709551616 ELSE swapped END::BIGINT AS long_little, ((x >> 40) & 255)::BIGINT AS third, lpad(hex(((x >> 24) & 65535)::BIGINT), 4, '0') AS piece FROM le")
def binary_integers(spark, d):
    """Integers of both byte orders, single bytes and pieces of eight bytes."""
    t = _keys(spark, d).select("k", binary.write_int(F.col("n") * 2654435761, 8).alias("b"))
    b = F.col("b")
    return t.select("k", binary.read_int(b, 0, signed=False).alias("uint"), binary.read_int(b, 0).alias("int"), binary.read_int(b, 0, 8).alias("long"), binary.read_int(b, 0, little=True).alias("int_little"), binary.read_int(b, 0, 8, little=True).alias("long_little"), binary.get_byte(b, 2).alias("third"), F.hex(binary.slice_bytes(b, 3, 2)).alias("piece"))


@query(f"WITH {_X} SELECT k, bit_count(x::BIGINT)::BIGINT AS total, (bit_count((x >> 48)::BIGINT) + bit_count(((x >> 40) & 15)::BIGINT))::BIGINT AS rank20, (x >> (56 - 8 * (k % 64 // 8) + k % 8)::INT) & 1 = 1 AS is_set FROM x")
def bit_tables(spark, d):
    """Bits of a table of eight bytes: how many, how many before the 20th, and one of them."""
    b = binary.write_int(F.col("n") * 2654435761, 8)
    return _keys(spark, d).select("k", binary.count_bits(b).alias("total"), binary.rank(b, 20).alias("rank20"), binary.is_bit_set(b, F.col("k") % 64).alias("is_set"))


@query("""SELECT c_custkey AS k, printf('%02X', length(c_name)) || hex(c_name::BLOB) AS bytes, c_name AS back, length(c_name) + 1 AS size FROM customer""")
def string_bytes(spark, d):
    b = binary.write_string(F.col("c_name"))
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), b.alias("b"))
    return t.select("k", F.hex("b").alias("bytes"), binary.read_string(F.col("b")).alias("back"), F.octet_length("b").cast("long").alias("size"))


@query(f"WITH {_N} SELECT k, (((n % 4294967296)::HUGEINT * 2654435761 % 4294967296) >> 16)::BIGINT AS hash16, (((n % 4294967296)::HUGEINT * 2654435761 % 4294967296) >> 20)::BIGINT AS hash12 FROM n")
def match_hashes(spark, d):
    return _keys(spark, d).select("k", bits.match_hash(F.col("n"), 16).alias("hash16"), bits.match_hash(F.col("n"), 12).alias("hash12"))


@query("""WITH v AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) AS i, o_custkey % 256 AS v FROM orders), w AS (SELECT i // 128 AS block, i % 16 AS j, (i % 128) // 16 AS lane, v FROM v), s AS (SELECT block, j, sum(v::HUGEINT << (56 - 8 * lane)::INT)::HUGEINT AS w, count(*) AS c FROM w GROUP BY ALL)
SELECT block, j AS place, CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END::BIGINT AS word, (SELECT list(x.v ORDER BY x.i) FROM v x WHERE x.i // 128 = s.block AND x.i % 16 = s.j) AS back FROM s WHERE block < (SELECT count(*) // 128 FROM orders)""", lists=("back",))
def lane_blocks(spark, d):
    """Blocks of 128 numbers in words of eight lanes, and what each word's lanes give back."""
    o = terms.numbered(table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 256).alias("v")), "o_orderkey")
    g = o.groupBy(F.expr("number div 128").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "v"))), lambda s: s["v"]).alias("v")).filter(F.size("v") == codecs.BLOCK)
    w = g.select("block", F.posexplode(lists.transposed(bits.chunks(F.col("v"), 16))).alias("place", "lanes")).withColumn("word", bits.packed_long(F.col("lanes"), 8))
    return w.select("block", F.col("place").cast("long").alias("place"), "word", bits.unpacked_long(F.col("word"), 8, 8).alias("back"))


_STATES = """WITH l AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS label, min(l_partkey) AS target, max(l_suppkey) AS output FROM lineitem GROUP BY ALL),
s AS (SELECT k, list(label ORDER BY label) AS labels, list(target ORDER BY label) AS targets, list(output ORDER BY label) AS outputs FROM l GROUP BY 1)"""


def _states(spark, d):
    """Arcs by order: one for each of its line numbers, seven at most."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("label")).agg(F.min("l_partkey").alias("target"), F.max("l_suppkey").alias("output"))
    return lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("label", "target", "output"))).alias("arcs"))


@query(f"""{_STATES}
SELECT k, CASE WHEN list_contains(labels, 2) THEN targets[list_position(labels, 2)] END AS second, coalesce(CASE WHEN list_contains(labels, 3) THEN outputs[list_position(labels, 3)] END, 0) AS third_output, 99::BIGINT AS replaced, CASE WHEN list_contains(labels, 2) THEN len(labels) ELSE len(labels) + 1 END AS arcs, list_transform(outputs, lambda x: x + 1) AS raised, k % 3 = 0 AS final, list_sort(list_distinct(list_append(outputs, 0))) AS outputs, list_filter(labels, lambda x: x <> 2) AS others FROM s""", lists=("raised", "outputs", "others"))
def state_functions(spark, d):
    """States whose arcs are an order's lines: lookups, replacement, mapping, output sets."""
    g = _states(spark, d)
    g = g.withColumn("s", lists.state(F.col("arcs"), F.when(F.col("k") % 3 == 0, F.col("k"))))
    s, long = F.col("s"), bits.long
    new = lists.with_arc(s, long(2), long(99), long(0))
    raised = lists.with_outputs(s, lambda x: x + 1)
    return g.select("k", lists.target_of(s, long(2)).alias("second"), lists.output_of(s, long(3), long(0)).alias("third_output"), lists.target_of(new, long(2)).alias("replaced"), F.size(new["arcs"]).cast("long").alias("arcs"), lists.outputs_of(raised).alias("raised"), lists.is_final(s).alias("final"), lists.add_output(lists.outputs_of(s), long(0)).alias("outputs"), lists.without(F.transform(s["arcs"], lambda a: a["label"]), long(2)).alias("others"))


@query(f"""{_STATES}
SELECT o_custkey AS customer, arg_min(k, (len(labels), list_transform(list_zip(labels, targets, outputs), lambda x: [x[1], x[2], x[3]]), k)) AS least_arcs, arg_max(k, (k % 3 = 0, labels, outputs, CASE WHEN k % 3 = 0 THEN 7 ELSE -1 END, targets, k)) AS greatest_state FROM s JOIN orders ON o_orderkey = k GROUP BY 1""")
def state_orders(spark, d):
    """Of a customer's orders, the least by its list of arcs and the greatest by its state."""
    g = _states(spark, d)
    g = g.withColumn("s", lists.state(F.col("arcs"), F.when(F.col("k") % 3 == 0, F.lit(7)))).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("k") == F.col("o_orderkey"))
    least, greatest = (F.struct(f, F.col("k").alias("k")) for f in (lists.arc_order(F.col("arcs")), lists.state_order(F.col("s"))))
    return g.groupBy(F.col("o_custkey").alias("customer")).agg(F.min_by("k", least).alias("least_arcs"), F.max_by("k", greatest).alias("greatest_state"))


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN 'magic: expected 1071082519, found 7' WHEN s_suppkey % 5 = 1 THEN 'name: expected Terms, found Other' WHEN s_suppkey % 7 NOT BETWEEN 2 AND 6 THEN 'version: expected 2..6, found ' || s_suppkey % 7 END AS error,
s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0 AS footer, 5::BIGINT AS checked_version, (CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 8 ELSE 0 END)::BIGINT AS flags, ['none', 'lowercase_ascii', 'lz4'][(s_suppkey % 3)::INT + 1] AS codec FROM supplier""")
def plain_header_check(spark, d):
    """Headers by magic number, name and version; the raising form where all is right; flags; codec names."""
    k = F.col("s_suppkey")
    magic = F.when(k % 6 == 0, 7).otherwise(layouts.MAGIC).cast("long")
    h = table(spark, d, "supplier").select(k.alias("k"), magic.alias("magic"), F.when(k % 5 == 1, "Other").otherwise("Terms").alias("name"), (k % 7).alias("version"))
    k = F.col("k")
    footer = metadata.footer_ok(16 + k % 2, F.col("magic").bitwiseXOR(F.lit(0xFFFFFFFF).cast("long")))
    right = F.struct(F.lit("Terms").alias("name"), bits.long(5).alias("version"), F.lit("AB").alias("object_id"), F.lit("s0").alias("suffix"))
    flags = bits.set_flag_if(k % 2 == 0, 4) + bits.set_flag_if(k % 3 == 0, 8)
    return h.select("k", metadata.plain_header_error("Terms", 2, 6).alias("error"), footer.alias("footer"), metadata.checked_version(right, "Terms", 2, 6, "AB", "s0").alias("checked_version"), flags.alias("flags"), metadata.of_code(k % 3, tuple(c.name for c in codecs.CODECS.values())).alias("codec"))


@query(r"""WITH d AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) SELECT doc, position::BIGINT AS position, w[position + 1] AS term FROM (SELECT doc, w, unnest(range(len(w))) AS position FROM d)""")
def positions(spark, d):
    """Every token with its place in its document."""
    t = terms.tokens(table(spark, d, "documents"))
    return t.select("doc", F.col("position").cast("long").alias("position"), "term")


@query(f"WITH {TOK} SELECT term, list(doc ORDER BY doc) AS docs, max(doc) AS last FROM post WHERE term IN (SELECT term FROM td WHERE doc_freq BETWEEN 3 AND 200) GROUP BY term", lists=("docs",))
def delta_decode(spark, d):
    """Differences of a term's documents summed up again; lists of 3 to 200."""
    p = terms.doc_deltas(checkpoint(terms.postings(terms.tokens(table(spark, d, "documents"))), "postings"))
    wanted = _dict(spark, d).filter("doc_freq between 3 and 200").select("term")
    g = p.join(wanted, "term", "left_semi").groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "delta"))), lambda s: s["delta"]).alias("v"))
    docs = lists.running_sums(F.col("v"), bits.long(0))
    return g.select("term", docs.alias("docs"), lists.last(docs).alias("last"))


@query("""SELECT c_custkey AS k, list_transform(range(c_custkey % 4), lambda i: c_name) AS filled, range(c_custkey % 5)::BIGINT[] AS upto, left(c_name, 3) AS first, substr(c_name, 4) AS rest, [left(c_name, 1) || left(c_mktsegment, 1), substr(c_name, 2, 1) || substr(c_mktsegment, 2, 1)] AS transposed,
[c_name, c_mktsegment, c_name] AS joined, '{"k":' || c_custkey || ',"name":"' || c_name || '"}' AS shown, c_custkey % 2 = 0 AS equal FROM customer""", lists=("filled", "upto", "transposed", "joined"))
def list_pieces(spark, d):
    """Filled, counted, cut, transposed and joined lists; a record as text, and two records compared with nulls."""
    letters = lambda c, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(F.col(c), i, F.lit(1)))
    k, both = F.col("c_custkey"), F.array(letters("c_name", 3), letters("c_mktsegment", 2))
    piece = lists.take(F.filter(F.split("c_name", ""), lambda x: x != ""), 3)
    same = F.when(k % 2 == 0, F.struct(k.alias("k"), F.lit(None).cast("long").alias("x"))).otherwise(F.struct((k + 1).alias("k"), F.lit(None).cast("long").alias("x")))
    return table(spark, d, "customer").select(
        k.alias("k"), lists.fill(k % 4, F.col("c_name")).alias("filled"), F.transform(lists.upto((k % 5).cast("int")), lambda i: i.cast("long")).alias("upto"), F.array_join(piece["first"], "").alias("first"), F.array_join(piece["rest"], "").alias("rest"),
        F.transform(lists.transposed(both), lambda x: F.concat_ws("", x)).alias("transposed"), F.flatten(F.array(F.array("c_name"), F.array("c_mktsegment", "c_name"))).alias("joined"), F.to_json(F.struct(k.alias("k"), F.col("c_name").alias("name"))).alias("shown"), F.struct(k.alias("k"), F.lit(None).cast("long").alias("x")).eqNullSafe(same).alias("equal"),
    )


@query("SELECT r_name AS key, n_name AS value, r_regionkey AS file FROM nation JOIN region ON n_regionkey = r_regionkey")
def keyed_lines(spark, d):
    """Lines of a file for each region: its name as a key, then its nations."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("file"), F.lit(-1).cast("long").alias("number"), F.concat(F.lit(lines.MARK), "r_name").alias("line"))
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("file"), F.col("n_nationkey").cast("long").alias("number"), F.col("n_name").alias("line"))
    return lines.keyed(r.unionByName(n)).select("key", "value", "file")
