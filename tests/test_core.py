"""Core operators: golden values, properties, and every query against its SQL."""

import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom import queries as q
from termloom.functions import binary, bits, lists
from termloom.operators import block_seek, byte_fst, codecs, fst, lookup, metadata
from termloom.plans import order, terms
from termloom.sources import blocks, layouts, lines
from termloom.sources.cursor import Cursor, varying

SF = "/root/testdata/sf0.001"


def test_codecs_round_trip():
    r = random.Random(1)
    for n in [*range(40), 300, 1000, 5000]:
        for letters in (b"abc def?\x7f\xc3Z.", bytes(range(256)), b"ab", b"t" * 520 + b"T"):
            b = bytes(r.choice(letters) for _ in range(n))
            for c in codecs.CODECS.values():
                assert c.decompress(Cursor(c.compress(b)), n) == b
            if n:  # another implementation of the format reads it, and is read
                assert pa.Codec("lz4_raw").decompress(codecs.lz4_compress(b), n, asbytes=True) == b
                assert codecs.lz4_decompress(Cursor(pa.Codec("lz4_raw").compress(b, asbytes=True)), n) == b
    assert codecs.lz4_decompress(Cursor(b"\x1aa\x01\x00\x00"), 15) == b"a" * 15  # a match that overlaps what it writes
    long = bytes(84 if i % 521 == 0 else 116 for i in range(1, 2001))
    assert np.diff(codecs.ascii_exceptions(np.frombuffer(long, np.uint8)), prepend=0).tolist() == [255, 255, 10, 255, 255, 11, 255, 255, 11]
    with pytest.raises(ValueError):
        codecs.codec(3)


def test_frames_and_lanes():
    r = random.Random(2)
    for bits_ in range(1, 33):
        v = np.array([[r.getrandbits(bits_) for _ in range(128)] for _ in range(3)])
        words = codecs.pack_lanes(v, bits_)
        assert words.shape == (3, 2 * bits_) and (codecs.unpack_lanes(words, bits_) == v).all()
    for k in range(100):
        width = r.randrange(24)
        v = np.array([[r.getrandbits(width) if width else 7 for _ in range(128)] for _ in range(3)])
        for _ in range(r.randrange(9)):
            v[0, r.randrange(128)] = r.getrandbits(min(31, width + 8))
        assert (codecs.pfor_decode(codecs.pfor_encode(v)) == v).all()
    assert codecs.pfor_encode(np.full((1, 128), 5))[0] == b"\x00\x05"
    assert [hex(m) for m in codecs.lane_masks(8)[:3]] == ["0x0", "0x101010101010101", "0x303030303030303"]
    deltas, width = codecs.encode_deltas(np.array([5, 6, 9, 30]), 4)
    assert deltas.tolist() == [1, 1, 3, 21] and width == 5 and codecs.decode_deltas(deltas, 4).tolist() == [5, 6, 9, 30]


def test_cursor():
    data = b"".join(varying(n) for n in (10, 256, 1024, 7462834, 2147483647, -1))
    c = Cursor(data)
    assert [c.varying() for _ in range(5)] == [10, 256, 1024, 7462834, 2147483647] and c.left == 5 and c.varying() == 0xFFFFFFFF
    back = Cursor(b"\x01\x02\x03\x04", backward=True)
    assert (back.position, back.byte(), back.take(2), back.position, back.left) == (3, 4, b"\x03\x02", 0, 1)
    back.position = 2
    assert back.peek() == 3 and back.slice(1, 2).byte() == 3 and back.take(0) == b""
    assert Cursor(b"\xff\xff\xff\xfe\x01").fixed(4) == -2 and Cursor(b"\x01\x02\x03\x04").fixed(4, "little") == 0x04030201
    with pytest.raises(ValueError):
        c.take(1)


def test_layouts(spark, tmp_path):
    header = {"magic": layouts.MAGIC, "name": "Info", "version": 3, "object_id": b"0123456789ABCDEF", "suffix": ""}
    version = {"major": 8, "minor": 4, "bugfix": 1}
    info = dict(header=header, version=version, min_version=None, doc_count=5, is_compound=True, diagnostics=[{"key": "é", "value": ""}] * 2, files=[], attributes=[], sort_fields=["a" * 200], footer=None)
    data = layouts.to_bytes(layouts.SEGMENT_INFO, info)
    back = layouts.from_bytes(layouts.SEGMENT_INFO, data)
    assert back["min_version"] == version and back["diagnostics"] == info["diagnostics"] and back["footer"] == {"remaining": 16, "magic": ~layouts.MAGIC & 0xFFFFFFFF, "checksum_ok": True}
    assert not layouts.from_bytes(layouts.SEGMENT_INFO, data[:6] + b"X" + data[7:])["footer"]["checksum_ok"]
    with pytest.raises((ValueError, IndexError)):
        layouts.from_bytes(layouts.SEGMENT_INFO, data[:20])
    for name in ("segments_2", "segments_a", "other"):
        (tmp_path / name).write_bytes(data)
    assert spark.createDataFrame([(None,), (bytearray(data),)], "content binary").transform(lambda d: layouts.parsed(d, layouts.SEGMENT_INFO)).filter("record is null").count() == 1
    read = layouts.read_files(spark, str(tmp_path), layouts.SEGMENT_INFO)
    assert read.count() == 3 and read.select("record.doc_count").distinct().first()[0] == 5
    newest = layouts.latest_commit(read.select("path")).first()
    assert newest.path.endswith("segments_a") and newest.generation == 10


def test_byte_transducers():
    r = random.Random(2)
    for size in (2, 5, 9, 40, 200):
        alphabet = bytes(r.sample(range(256), size))
        keys = sorted({bytes(r.choice(alphabet) for _ in range(r.randrange(6))) for _ in range(200)})
        for algebra, value in ((byte_fst.NUMBERS, lambda: r.randrange(1000)), (byte_fst.STRINGS, lambda: bytes(r.choice(b"ab") for _ in range(r.randrange(4))))):
            entries = {k: value() for k in keys}
            data, start, empty = byte_fst.compiled(entries.items(), algebra)
            reader = byte_fst.Reader(data, start, empty, algebra)
            for k in [*keys, *(bytes(r.choice(alphabet) for _ in range(r.randrange(7))) for _ in range(100))]:
                assert reader.accept(k) == entries.get(k)
                assert len(reader.path(k)) - 1 == max(n for n in range(len(k) + 1) if n == 0 or any(x.startswith(k[:n]) for x in keys))
            assert [a.label for a in reader.arcs(start)] == sorted({k[0] for k in keys if k})
    many = sorted(bytes([i, j]) + b"zzz" for i in range(97, 120) for j in range(97, 120))
    assert len(byte_fst.compiled((k, 0) for k in many)[0]) < 150  # equal nodes are stored once
    assert byte_fst.compiled([])[1:] == (0, None) and byte_fst.Reader(b"\0", 0).accept(b"") is None
    with pytest.raises(ValueError):
        byte_fst.compiled([(b"b", 1), (b"a", 1)])


def test_blocks_and_pointers():
    r = random.Random(3)
    for options in (blocks.Options(), blocks.Options(False), blocks.Options(True, True), blocks.Options(True, True, True)):
        states, at, pos = [], 0, 0
        for _ in range(60):
            df = r.choice((1, 1, 1, 2, 130, 500))
            ttf = df + (r.choice((0, 0, 3, 200)) if options.freqs else 0)
            pos += 7 * options.positions
            states.append(blocks.State(df, ttf, at, r.randrange(1000) if df == 1 else None, pos, pos if options.offsets else 0, 3 if options.positions and ttf > 128 else None, 9 if df > 128 else None))
            at += 0 if df == 1 else df
        words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 7))).encode() for _ in range(200)})[:60]
        for codec in codecs.CODECS:
            data = b"xx" + blocks.block_bytes(words, states[: len(words)], options, codec)
            assert [blocks.seek_in_block(data, 2, w, options) for w in words] == states[: len(words)] and blocks.seek_in_block(data, 2, b"zz", options) is None
    same = blocks.block_bytes([b"aa", b"bb"], [blocks.State(1, 1, 0, 4), blocks.State(1, 1, 0, 9)])
    assert blocks.read_block(same, 0)[0] == [b"aa", b"bb"] and blocks.stats_of(blocks.read_block(same, 0)[1], 2, blocks.Options()) == [(1, 1)] * 2
    floors = [blocks.Floor(None, 100), blocks.Floor(100, 150), blocks.Floor(109, 170, False), blocks.Floor(116, 400)]
    raw = blocks.pointer_bytes(floors)
    assert blocks.pointer_floors(raw) == floors
    assert [blocks.find_block(raw, ord(c)) for c in "adlmsz"] == [100, 150, 150, None, None, 400] and blocks.find_block(blocks.pointer_bytes([blocks.Floor(None, 3, False)]), 5) is None


@pytest.mark.parametrize("most", [block_seek.MOST_INDEX_BYTES, -1])
def test_block_seek_with_odd_terms(spark, monkeypatch, most):
    """Short, empty and non-ASCII terms, targets outside the bounds, null and repeated targets, no dictionary at all; transducers sent along and joined."""
    monkeypatch.setattr(block_seek, "MOST_INDEX_BYTES", most)
    words = ["", "a", "ab", "abc", "abd", "é", "éa", "éab", "ß" * 300, "b" * 200]
    rows = [("f", w, 1 + k % 3, 2 + k, k if k % 3 == 0 else None) for k, w in enumerate(words)]
    d = spark.createDataFrame(rows, "field string, term string, doc_freq long, total_term_freq long, singleton_doc long")
    bounds = d.groupBy("field").agg(F.min("term").alias("min_term"), F.max("term").alias("max_term"))
    targets = spark.createDataFrame([("f", w) for w in [*words, "ax", "abx", "éx", "zz", "a", None]] + [("g", "a")], "field string, target string")
    got = block_seek.seek(targets, bounds, block_seek.build(d)).collect()
    assert len(got) == len(words) + 6
    known = {r[1]: (r[2], r[3], r[4]) for r in rows}
    for r in got:
        assert r.found == (r.target in known) and ((r.doc_freq, r.total_term_freq, r.singleton_doc) == known[r.target] if r.found else r.doc_freq is None)
    assert block_seek.seek(targets, bounds.limit(0), block_seek.build(d.limit(0))).count() == 0


def test_order(spark):
    r = random.Random(4)
    rows = [(f"k{r.randrange(10**6):06d}", r.randrange(5)) for _ in range(500)]
    d = spark.createDataFrame(rows, "key string, v long").dropDuplicates(["key"]).repartition(6)
    ordered = sorted((x.key, x.v) for x in d.collect())
    got = {x.key: x for x in order.running(d, "key", n=F.lit(1).cast("long"), total=F.col("v")).collect()}
    before = {x.key: x.before for x in order.with_previous(d, "key").collect()}
    total, last = 0, ""
    for n, (k, v) in enumerate(ordered):
        assert (got[k].n, got[k].total, before[k]) == (n, total, last)
        total, last = total + v, k
    assert order.numbered(d.limit(0), "key").count() == 0


def test_doc_deltas_over_ranges(spark):
    r = random.Random(5)
    rows = sorted({(t, r.randrange(300)) for t in "aab" for _ in range(60)})
    got = {(x.term, x.doc): (x.delta, x.rank) for x in terms.doc_deltas(spark.createDataFrame(rows, "term string, doc long"), 16).collect()}
    for t in "ab":
        docs = [d for x, d in rows if x == t]
        assert [got[t, d] for d in docs] == [(d - p, i) for i, (p, d) in enumerate(zip([0, *docs], docs, strict=False))]


def test_minimal_states(spark):
    """Against a minimiser that merges equal nodes from the leaves."""
    r = random.Random(6)
    keys = {"".join(r.choice("ab") for _ in range(r.randint(1, 5))): r.randint(0, 2) for _ in range(30)}
    low = {}
    for k, v in keys.items():
        for n in range(len(k) + 1):
            low[k[:n]] = min(v, low.get(k[:n], v))

    def signature(p):
        return (keys[p] - low[p] if p in keys else None, tuple((c, low[p + c] - low[p], signature(p + c)) for c in "ab" if p + c in low))

    count = {p: sum(k.startswith(p) for k in keys) for p in low}
    want = {n: (len({signature(p) for p in low if count[p] == n}), sum(count[p] == n for p in low)) for n in set(count.values())}
    got = {x["keys"]: (x.states, x.nodes) for x in fst.state_classes(spark.createDataFrame([*keys.items()], "term string, output long")).collect()}
    assert got == want


def test_lists(spark):
    d = spark.range(1).select(F.array(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(4), F.lit(5))).alias("x"), F.expr("cast(array() as array<int>)").alias("none"))
    r = d.select(lists.transposed(F.col("x")).alias("t"), lists.fill(F.lit(2), F.lit(7)).alias("f"), lists.upto(F.lit(3)).alias("u"), lists.upto(F.lit(0)).alias("z"), lists.split_at(F.col("none"), 2).alias("s"), lists.is_empty(F.col("none")).alias("e"), lists.is_final(lists.empty_final_state()).alias("final"), lists.take(F.col("x"), 1).alias("one"), lists.last(F.col("x")).alias("last")).first()
    assert (r.t, r.f, r.u, r.z, r.s["rest"], r.e, r.final, r.one["rest"], r["last"]) == ([[1, 4], [2, 5]], [7, 7], [0, 1, 2], [], [], True, True, [[4, 5]], [4, 5])
    for f in (lists.take(F.col("x"), 3), lists.last(F.col("none"))):
        with pytest.raises(Exception, match="wanted|empty list"):
            d.select(f).collect()


def test_headers_and_fields(spark):
    row = {"magic": layouts.MAGIC, "name": "T", "version": 3, "object_id": "AB", "suffix": "s"}
    cases = [{}, {"magic": 1}, {"name": None}, {"version": None}, {"version": 9}, {"object_id": "x"}, {"suffix": None}]
    d = spark.createDataFrame([tuple((row | c).values()) for c in cases], "magic long, name string, version long, object_id string, suffix string")
    got = d.select(metadata.plain_header_error("T", 2, 6).alias("p"), metadata.header_error("T", 2, 6, "AB", "s").alias("h")).collect()
    assert [(r.p or "").split(":")[0] for r in got] == ["", "magic", "name", "version", "version", "", ""] and [(r.h or "").split(":")[0] for r in got] == ["", "", "name", "version", "version", "id", "suffix"]
    with pytest.raises(Exception, match="expected 2..6, found 9"):
        d.filter("version = 9").select(metadata.checked_version(F.struct(*d.columns), "T", 2, 6, "AB", "s")).collect()
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "number long, name string")
    asked = spark.createDataFrame([("b",), ("x",), (None,)], "asked string")
    assert {r.asked: r.number for r in metadata.by_name(asked, f, "asked").collect()} == {"b": 2, "x": None, None: None}
    with pytest.raises(Exception, match="no field 9"):
        metadata.by_number(spark.createDataFrame([(9,)], "w long"), f, "w").collect()


def test_binary_functions(spark):
    d = spark.createDataFrame([(bytearray(b"\xff\xff\xff\xfe\x80\x01"),), (bytearray(b""),), (None,)], "b binary")
    b = F.col("b")
    got = d.select(binary.read_int(b, 0).alias("i"), binary.read_int(b, 0, little=True).alias("l"), binary.read_int(b, 0, signed=False).alias("u"), binary.read_vint(b, 4).alias("v"), binary.get_byte(b, 4).alias("x"), binary.count_bits(b).alias("c")).collect()
    assert tuple(got[0]) == (-2, -16777217, 4294967294, 128, 128, 33) and got[1].i is None and got[1].c == 0 and got[2].i is None


def test_keyed_lines(spark, tmp_path):
    (tmp_path / "a").write_text("lost\n$one\nx\ny\n\n$two\r\nz\n")
    (tmp_path / "b").write_text("")
    got = [(r.key, r.value) for r in lines.keyed(lines.read_lines(spark, str(tmp_path))).orderBy("number").collect()]
    assert got == [(None, "lost"), ("one", "x"), ("one", "y"), ("two", "z")]
    cut = lines.pairs(spark.createDataFrame([("a b c",), ("d",), (None,)], "line string")).collect()
    assert [tuple(r) for r in cut] == [("a", "b c"), ("d", None), (None, None)]


def test_empty_key(spark):
    e = spark.createDataFrame([("", 9), ("a", 5)], "term string, output long")
    assert {(r.node, r.label, r.target): (r.output, r.final_output) for r in fst.arcs(e).collect()} == {("", "a", "a"): (5, 0), (None, None, ""): (0, 9)}
    q_ = spark.createDataFrame([("x",), ("a",)], "query string")
    assert {r.query: (r.path_length, r.output) for r in fst.match_path(q_, e).collect()} == {"x": (0, 9), "a": (1, 5)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert terms.field_meta(docs).count() == terms.field_bounds(docs).count() == 0
    e = spark.createDataFrame([], "term string, output long")
    assert fst.arcs(e).count() == fst.state_classes(e).count() == 0
    nulls = spark.createDataFrame([(1, None, None, "s"), (None, "a b a", "x", None)], docs.schema)
    assert {r.field: (r.num_terms, r.sum_total_term_freq, r.doc_count) for r in terms.field_meta(nulls).collect()} == {"text": (2, 3, 1), "lang": (1, 1, 1), "source": (1, 1, 1)}


def test_bits(spark):
    d = spark.range(-300, 300).select("id", bits.unzigzag(bits.zigzag(F.col("id"))).alias("z"), bits.binary(F.col("id"), 32).alias("b"))
    assert all(r.id == r.z and r.b == format(r.id & 0xFFFFFFFF, "032b") for r in d.collect())
    assert spark.range(1).select(bits.hex_pairs(F.lit(b"\x01\xab")).alias("h")).first().h == "01 AB "


#: Pairs whose outputs are known.
ENTRIES = [("ca", 5), ("car", 7), ("cat", 12), ("cataract", 3), ("cataracts", 13), ("co", 23), ("cot", 2), ("dog", 10), ("dogs", 10), ("dot", 10)]


def test_longest_path_and_accept(spark):
    e = spark.createDataFrame(ENTRIES, "term string, output long")
    words = ["ca", "cataracts", "cataractsx", "x", "dogs", "c"]
    got = {r.query: r for r in fst.match_path(spark.createDataFrame([(w,) for w in words], "query string"), e).collect()}
    assert (got["ca"].output, got["cataracts"].output, got["cataractsx"].output, got["x"].output, got["dogs"].output) == (5, 13, 13, 0, 10)
    accepted = {r.query: r.output for r in fst.accept(spark.createDataFrame([(w,) for w in words], "query string"), e).collect()}
    assert accepted["c"] is None and accepted["ca"] == 5


def test_long_keys_match_whole(spark):
    """Keys and paths of 64, 65 and 300 characters, with shorter keys on the way."""
    keys = {"a": 1, "a" * 64: 2, "a" * 65: 3, "a" * 64 + "b" * 236: 4}
    e = spark.createDataFrame([*keys.items()], "term string, output long")
    words = ["a" * 64, "a" * 65, "a" * 66, "a" * 64 + "b" * 235, "a" * 64 + "b" * 236, "a" * 64 + "b" * 237, "x"]
    queries = spark.createDataFrame([(w,) for w in words], "query string")
    matched = {r.query: (r.match, r.output) for r in lookup.match_key(queries, e).collect()}
    paths = {r.query: (r.path_length, r.output) for r in fst.match_path(queries, e).collect()}
    for w in words:
        best = max((k for k in keys if w.startswith(k)), key=len, default=None)
        assert matched[w] == (best, keys.get(best))
        n = max((i for i in range(len(w) + 1) if any(k.startswith(w[:i]) for k in keys)), default=0)
        assert paths[w] == (n, keys.get(w[:n], min(v for k, v in keys.items() if k.startswith(w[:n]))) if n else 0)


def test_arcs_sum_to_outputs(spark):
    r = random.Random(2)
    keys = {"".join(r.choice("abc") for _ in range(r.randint(1, 6))): r.randint(0, 50) for _ in range(80)}
    a = fst.arcs(spark.createDataFrame([*keys.items()], "term string, output long")).collect()
    by = {x.target: x for x in a}
    for k, v in keys.items():
        assert sum(by[k[: i + 1]].output for i in range(len(k))) + by[k].final_output == v
    assert all(x.output >= 0 for x in a)


def test_lookups_of_nulls_and_nothing(spark):
    d = spark.createDataFrame([("f", "a", 1, 2, 7)], "field string, term string, doc_freq long, total_term_freq long, singleton_doc long")
    meta = spark.createDataFrame([("f", "a", "b")], "field string, min_term string, max_term string")
    t = spark.createDataFrame([("f", None), ("f", "a"), ("f", "a"), ("f", "z"), ("g", "a"), (None, "a")], "field string, target string")
    got = sorted(str((r.target, r.in_range, r.found, r.singleton_doc)) for r in lookup.seek_exact(t, meta, d).collect())
    assert got == ["('a', True, True, 7)", "('a', True, True, 7)", "('z', False, False, None)", "(None, False, False, None)"]
    assert [r.found for r in lookup.seek_exact(t.limit(2), meta, d.limit(0)).collect()] == [False, False]
    e = spark.createDataFrame([("a", 1)], "term string, output long")
    q_ = spark.createDataFrame([(None,), ("",), ("ab",), ("ab",)], "query string")
    for entries, hits in ((e, 2), (e.limit(0), 0)):
        assert [sum(r.match is not None for r in lookup.match_key(q_, entries).collect()), lookup.match_key(q_, entries).count()] == [hits, 4]
        assert sum(r.path_length for r in fst.match_path(q_, entries).collect()) == hits and fst.accept(q_, entries).filter("accepted").count() == 0


def test_floor_lookup(spark):
    b = spark.createDataFrame([("p", "d", 1), ("p", "m", 2), ("p", "t", 3)], "prefix string, label string, entries long")
    t = spark.createDataFrame([("p", "a"), ("p", "m"), ("p", "s"), ("p", "z")], "prefix string, target_label string")
    assert {r.target_label: r.label for r in lookup.floor_lookup(t, b).collect()} == {"a": "d", "m": "m", "s": "m", "z": "t"}


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_equals_sql(spark, views, name):
    df = q.queries()[name](spark, SF)
    rows = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    if name not in q.oracle_sql():
        assert rows
        return
    sql = views.sql(q.oracle_sql()[name])
    at = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in sql.fetchall())
