"""Training-data operators against brute force on a small table with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("termloom.llm.queries")
from termloom.llm import jaccard, media, mixing, packing, pii, quality, substring, urlfilter, warc, wordpiece  # noqa: E402
from termloom.llm.common import stored  # noqa: E402
from termloom.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, id long, path string"


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "Straße", "naïve", "foo,bar", "5", "it's"]
    base = [" ".join(r.choice(words) for _ in range(r.choice((3, 25, 60, 200)))) for _ in range(30)]
    near = [b.replace("w7", "w8", 1) + " tail" for b in base[:10]]
    odd = ["", None, " \n\t ", "a", "x@y.com and +1 555 123 4567 at 10.0.0.1 or 4111 1111 1111 1111 x@y.com", "the of " * 4000, "line\nline\nline\nother line", "é" * 3000]
    return base + near + odd + [base[3], base[3], None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("src0", "src1", None, "src5")[i % 4], len(t or ""), 0, 0, "") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts()):
        w, t = words(t), t or ""
        seen = {}
        for j in range(len(w) - 7):
            seen.setdefault(tuple(w[j : j + 8]), []).append(j)
        covered = {k for at in seen.values() if len(at) > 1 for j in at for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}


def test_pii(docs, empty):
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    i = next(i for i, t in enumerate(texts()) if t and "x@y" in t)
    assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == (2, 1, 1, 1)
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for k, r in got.items() if k != i and not r.n_email + r.n_ip + r.n_card + r.n_phone)
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[i].startswith("[EMAIL] and [PHONE] at [IP] or [CARD]") and masked[41] is None and pii.detect(empty).count() == 0


def test_pii_base_equals_plain_patterns():
    def naive(t):
        luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        digits = lambda s: re.sub("[^0-9]", "", s)
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15])

    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice("1234567890.@+-ab ()") for _ in range(60))
        assert naive(t) == pii.base_spans(t)


def added(t):
    ((own, every),) = pii.find_spans([t], pii.fitted())
    return [(t[a:b], pii.LABELS[k]) for a, k, b in every if (a, k, b) not in own]


def test_labels_spread_to_other_spellings_only():
    assert added("call +49 170 1234567 now. Later 491701234567 again.") == [("491701234567", "phone")]
    assert added("call +49 170 1234567 now. Later 49 170 1234567, or 49-170 1234567 again.") == [("49 170 1234567", "phone"), ("49-170 1234567", "phone")]
    assert added("call +49 170 1234567 now. In 49 170 other 1234567 or 49 170 1234568 cases.") == []
    assert added("order 20 30 40 items of 2024 for 350 each") == []


def test_field_on_unseen_sentences():
    """Recall of what the patterns can't find (secrets, phones without +) and false alarms on sentences of another seed."""
    hits = wanted = false = outside = 0
    for w, labels in pii.training_sentences(400, 99):
        t = " ".join(w)
        ((_, every),) = pii.find_spans([t], pii.fitted())
        at = 0
        for word, y in zip(w, labels, strict=True):
            found = any(a < at + len(word) and b > at for a, _, b in every)
            if y == 5:
                hits, wanted = hits + found, wanted + 1
            if not y:
                false, outside = false + found, outside + 1
            at += len(word) + 1
    assert wanted > 50 and hits >= 0.9 * wanted and false <= 0.01 * outside


def test_spans_are_merged_as_by_pairs():
    r = random.Random(4)
    for _ in range(300):
        some = lambda n: sorted((a, r.randrange(5), a + r.randrange(1, 6)) for a in (r.randrange(60) for _ in range(n)))
        own, more = some(r.randrange(6)), some(r.randrange(12))
        want = []
        for s in sorted(more, key=lambda s: (s[0], -s[2])):
            if not any(s[0] < o[2] and o[0] < s[2] for o in [*own, *want]):
                want.append(s)
        assert pii._apart(more, own) == want


def test_mask_keeps_clashing_columns(spark):
    d = spark.createDataFrame([("+49 170 1234567", 5, "x"), (None, None, None)], "text string, n_chars long, _masked string")
    assert [tuple(r) for r in pii.mask(d).collect()] == [("[PHONE]", 7, "x"), (None, None, None)] and pii.mask(d.limit(0)).count() == 0


def test_skip_ties_reach_every_repeat():
    """The respelled number and far repeats are labelled, whatever else is in the batch; other numbers are not."""
    near = "call +49 170 1234567 now. Later 491701234567 again."
    far = "call +49-170-1234567 now." + " then 491701234567 or not" * 60 + " and 998877665544 too"
    backward = "491701234567 " * 30 + "is +49-170-1234567"
    alone = "then 491701234567 or not " * 60
    batch = [near, far, "", backward, alone]
    got = pii.find_spans(batch, pii.fitted())
    for t, n, (own, every) in zip(batch, (1, 60, 0, 30, 0), got, strict=True):
        assert set(every) - set(own) == {(m.start(), 3, m.end()) for m in re.finditer("491701234567", t) if n} and len(every) - len(own) == n
        assert pii.find_spans([t], pii.fitted())[0] == (own, every)


def test_marginals_equal_brute_force():
    """On a hub with three words, one of them with a neighbour: a tree, so message passing is exact."""
    import itertools

    import numpy as np

    _, chain, skip = pii.fitted()
    unary = np.random.default_rng(1).normal(0, 2, (5, pii.N_LABELS))
    left, right, pair = np.array([0, 1, 2, 3]), np.array([4, 4, 4, 0]), np.stack([skip, skip, skip, chain])
    want = np.zeros((5, pii.N_LABELS))
    for y in itertools.product(range(pii.N_LABELS), repeat=5):
        want[range(5), y] += np.exp(sum(unary[range(5), y]) + sum(pair[e, y[a], y[b]] for e, (a, b) in enumerate(zip(left, right, strict=True))))
    assert np.abs(pii.marginals(unary, left, right, pair, np.zeros(4, int)) - want / want.sum(1, keepdims=True)).max() < 1e-4


def test_token_counts(spark, docs, empty):
    """Against pieces built one by one from a word's end, and the tokenizer's own counts of words that are one token."""
    ending, inner = map(set, wordpiece.vocabulary(tokenizer_path()))
    longest = max(map(len, ending | inner))

    def count(w):
        n, end, kind = 0, len(w), ending
        while end:
            end = next(j for j in range(max(0, end - longest), end) if w[j:end] in kind)
            n, kind = n + 1, inner
        return n

    more = ["THE QUICK BROWN FOX", "Information International", "\u039f\u0394\u039f\u03a3 \u0130x e\u0301", "antidisestablishmentarianism " * 3, "ab\u4e2d" * 9000]
    every = [*texts(), *more]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.count_tokens(docs.select("doc_id", "text").unionByName(spark.createDataFrame([*enumerate(more, len(texts()))], "doc_id long, text string")), tokenizer_path()).collect()}
    for i, t in enumerate(every):
        w = wordpiece.normal(t or "").encode().split()
        assert got[i] == (len(w), sum(map(count, w)))
    assert got[len(texts())] == (4, 4) and got[len(texts()) + 1] == (2, 2)
    assert wordpiece.count_tokens(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("weights", [None, {"src0": 0.7, "src1": 0.3}])
def test_packing(docs, empty, weights):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts()], add_special_tokens=False)]
    got = sorted(packing.pack(docs, tokenizer_path(), 256, weights).collect(), key=lambda r: (r.doc_id, r.start))
    stream = {}
    for r in got:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        for k in range(r.length):
            assert (r.sequence_id, r.offset + k) not in stream
            stream[r.sequence_id, r.offset + k] = 1
    total = sum(map(len, want))
    assert set(stream) == {divmod(k, 256) for k in range(total)}
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, None, None), (4, "http://b", ""), (5, "u\r\nv", "y\r\n\r\nz")]
    p = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, header string")
    got = {r.record_id: r for r in warc.read_archive(*warc.write_archive(p)).collect()}
    assert [(got[i].record_type, got[i].refers_to) for i in range(1, 6)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None)]
    headers, payloads = warc.write_archive(p)
    records = {r.record_id: bytes(r.record) for r in warc.record_bytes(warc.read_archive(headers, payloads)).collect()}
    assert records[5].endswith(b"\r\n\r\ny\r\n\r\nz\r\n\r\n") and b"Content-Length: 6" in records[5] and b"Content-Length: 0" in records[1]
    assert all(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in x and b"\r\nContent-Type: " in x for x in records.values())
    damaged = payloads.withColumn("payload", F.when(F.col("payload") == F.lit(b"x"), F.lit(b"y")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="does not match"):
        warc.record_bytes(warc.read_archive(headers, damaged)).collect()
    with pytest.raises(Exception, match="does not match"):  # one that is missing
        warc.read_archive(headers, payloads.limit(0)).collect()
    again = [(1, "u", "x"), (1, "v", "x"), (None, "w", "x"), (None, "w", "z")]
    dated = spark.createDataFrame([(*r, "2024-02-03 04:05:06") for r in again], "page_id long, url string, html string, at string").withColumn("at", F.to_timestamp("at"))
    got = warc.record_bytes(warc.read_archive(*warc.write_archive(dated, date_col="at"))).collect()
    assert sorted(str((r.record_id, r.record_type, r.refers_to)) for r in got) == ["(1, 'response', None)", "(1, 'response', None)", "(None, 'response', None)", "(None, 'revisit', 1)"] and all(b"WARC-Date: 2024-02-03T04:05:06Z" in bytes(r.record) for r in got)
    assert warc.read_archive(*warc.write_archive(p.limit(0))).count() == 0


def test_substring(docs, empty):
    first = {}
    for i, t in enumerate(texts()):
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    for i, t in enumerate(texts()):
        w = words(t)
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.remove_repeats(empty).count() == 0


def test_index_in_batches(spark, docs):
    index = substring.FingerprintIndex(spark, run_bytes=2000)
    parts = [index.add(docs.filter(f"doc_id between {a} and {b}")).collect() for a, b in ((0, 19), (20, 35), (36, 99))]
    want = sorted(map(str, substring.remove_repeats(docs, batches=1).collect()))
    assert sorted(map(str, sum(parts, []))) == want and sorted(map(str, substring.remove_repeats(docs, run_bytes=500).collect())) == want
    with pytest.raises(ValueError, match="comes after"):
        index.add(docs.filter("doc_id = 5"))


@pytest.mark.parametrize("run_bytes", [1 << 20, 900, 150])
def test_substring_ids(spark, run_bytes):
    """Null ids, ids with more rows than a run holds, and words made to collide; texts are whole in every case."""
    r = random.Random(8)
    passages = [" ".join(f"p{k}x{i}" for i in range(20)) for k in range(4)]
    morse = [bytes(97 + ((bin(i).count("1") + odd) & 1) for i in range(2048)).decode() for odd in (0, 1)]
    rows = [(r.choice((None, 3, 3, 3, 5, 7, 7, 9)), " ".join([f"u{r.randrange(9)}", r.choice(passages), f"v{r.randrange(9)}", r.choice(passages)])) for _ in range(60)]
    rows += [(1, " ".join([morse[0], *"abcdefghijklmno"])), (8, " ".join([morse[1], *"abcdefghijkl"])), (9, None), (None, "")]
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[j : j + 13])
            first[key] = min(i, first.get(key, i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {k for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, blob string, part int").repartition(4)
    got = substring.remove_repeats(d, with_text=True, run_bytes=run_bytes).collect()
    assert sorted(map(str, [(x.doc_id, x.n_words, x.n_removed, x.kept) for x in got])) == sorted(map(str, want))


def plain_samples(payload, form):
    """Decoders one sample at a time, from the formats' definitions."""
    if form == media.MULAW_FORMAT:
        out = []
        for c in payload:
            c = ~c & 0xFF
            v = ((2 * (c & 15) + 33) << (c >> 4 & 7)) - 33
            out.append(-4 * v if c & 128 else 4 * v)
        return out
    if form == media.ALAW_FORMAT:
        out = []
        for c in payload:
            c ^= 0x55
            e, m = c >> 4 & 7, c & 15
            v = 2 * m + 1 if not e else (2 * m + 33) << (e - 1)
            out.append(8 * v if c & 128 else -8 * v)
        return out
    steps, moves, out = media._step_table().tolist(), [-1, -1, -1, -1, 2, 4, 6, 8], []
    for lo in range(0, len(payload), media.BLOCK):
        block = payload[lo : lo + media.BLOCK]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = steps[index]
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + moves[code & 7]))
                out.append(value)
    return out


def plain_resampled(x, up, down):
    taps = media.kernel(up, down)
    half = len(taps) // 2
    out = []
    for n in range(-(-len(x) * up // down)):
        at = n * down
        total = sum(taps[half + at - i * up] * x[i] for i in range(max(0, -(-(at - half) // up)), min(len(x), (at + half) // up + 1)))
        out.append(max(-32768, min(32767, round(total))))
    return out


@pytest.mark.parametrize("form", [media.MULAW_FORMAT, media.ALAW_FORMAT, media.ADPCM_FORMAT])
@pytest.mark.parametrize(("up", "down"), [(1, 4), (2, 1), (3, 2)])
def test_media_files_against_plain_decoders(form, up, down):
    r = random.Random(form)
    payloads = [media.padded(bytes(r.randrange(256) for _ in range(n))) for n in (0, 700, 600)]
    for payload, file in zip(payloads, media.pcm_files(payloads, form, up, down), strict=True):
        assert media.unwav(media.wav(payload, form)) == (form, media.RATE, payload)
        kind, rate, played = media.unwav(file)
        want = plain_samples(payload, form)
        assert media.signals([payload], form)[0].tolist() == want and (kind, rate) == (media.PCM_FORMAT, media.RATE * up // down)
        got = [int.from_bytes(played[k : k + 2], "little", signed=True) for k in range(0, len(played), 2)]
        assert len(got) == -(-len(want) * up // down) and max(abs(a - b) for a, b in zip(got, plain_resampled(want, up, down), strict=True)) <= 1


def test_resampling_keeps_low_tones_and_drops_high_ones():
    import numpy as np

    t = np.arange(8000) / 8000
    for hertz, level in ((200, 1.0), (3000, 0.0)):
        x = np.rint(10000 * np.sin(2 * np.pi * hertz * t)).astype(np.int16)
        y, n = media.resampled(x, np.array([len(x)]))
        assert n.tolist() == [2000] and abs(np.abs(y[100:-100]).max() / 10000 - level) < 0.05


def test_media(spark, docs, empty):
    stored_ = media.encode_texts(docs)
    pcm = {r.doc_id: bytes(r.pcm) for r in stored_.collect()}
    got = {r.doc_id: r for r in media.decode_media(stored_).collect()}
    for i, t in enumerate(texts()):
        raw = (t or "").encode()
        pad = media.padded(raw)
        r = got[i]
        assert len(pad) % 576 == 0 and pad[: len(raw)] == raw and (r.n_bytes, r.payload_bytes) == (len(raw), len(pad))
        assert r.payload_sha256 == hashlib.sha256(pad).hexdigest() and r.tail_crc32 == zlib.crc32(pad[-32:]) and r.media_sha256 == hashlib.sha256(media.wav(pad)).hexdigest()
        played = media.unwav(pcm[i])[2]
        law = plain_samples(pad, media.MULAW_FORMAT)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(law, law[1:], strict=False))
        loud = [abs(int.from_bytes(played[k : k + 2], "little", signed=True)) for k in range(0, len(played), 2)]
        means = [sum(map(abs, x)) // len(x) for x in (law, plain_samples(pad, media.ALAW_FORMAT), plain_samples(pad, media.ADPCM_FORMAT))]
        assert r.pcm_bytes == len(pcm[i]) and r.feature == f"mulaw={means[0]};alaw={means[1]};adpcm={means[2]};crossings={crossings};resampled={sum(loud) // len(loud)};pcm={zlib.crc32(played):08x}"
    same = media.decode_media(media.encode_texts(spark.createDataFrame([(None, "x"), (None, "x"), (2, None)], "doc_id long, text string"))).collect()
    assert len(same) == 3 and len({r.feature for r in same}) == 2
    assert media.decode_media(media.encode_texts(empty)).count() == 0


@pytest.mark.parametrize(("ngram", "percent", "limit"), [(3, 90, 1 << 20), (5, 80, 3000)])
def test_jaccard(docs, empty, ngram, percent, limit):
    sets = []
    for t in texts():
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)} if len(w) >= ngram else {tuple(w)} - {()})
    up = list(range(len(sets)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, ngram, percent, limit).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("task_edges", [1 << 20, 20])
def test_components(spark, task_edges):
    r = random.Random(3)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)] * 2
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(4), "test", task_edges).collect()
    assert {r.id: r.root for r in got} == {i: root[i] for e in edges if e[0] != e[1] for i in e}
    assert jaccard.components(spark.createDataFrame([], "a long, b long"), "test", task_edges).count() == 0


def test_frequencies(spark, docs, empty):
    from termloom.llm import frequency
    from termloom.llm.hashing import mix

    table = frequency.frequencies(docs.repartition(130), 3)
    common = jaccard.shingle_sets([b"the of the of"], 3)[0]
    assert (table[frequency.bucket_of(mix(common))] > 8 * 10).all() and not frequency.frequencies(empty, 3).any()


def test_jaccard_stage(docs, empty):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in jaccard.join(docs, 5, 80).collect()})
    assert jaccard.join(empty).count() == 0


def test_jaccard_stage_ids(spark):
    """Repeated rows, repeated ids, null ids and clashing names."""
    long, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "wvz")
    rows = [(1, long, "a"), (2, long + " tail", "b"), (3, long, "c"), (4, None, "d"), (5, "", "e"), (6, other, "f"), (6, other, "f"), (7, third, "g"), (7, third + " x", "g"), (8, other, "h"), (None, long, "i"), (None, third.upper() + " q r s t u v w x y z a b c d e f g h", "j"), (None, None, "k")]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string, _id string"))
    assert kept.columns == ["doc_id", "text", "_id"] and sorted(r[2] for r in kept.collect()) == ["a", "d", "e", "f", "g", "j", "k"]


def test_urls(spark):
    urls = [None, "x", "http://a.COM/en/1", "http://com/en/", "https://t.example.com/en/7?x#y", "http://nexample.com/en/7", "http://example.net/de/81", "http://net/de", "ftp://example.org:80/es/", "http://", "http://a.org/es/q#/x"]
    p = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(3, urls[3], "r")], "page_id long, url string, rule string")
    rules = spark.createDataFrame([tuple(r) for r in urlfilter.RULES], "verdict string, host string, path string")
    got = urlfilter.filter_urls(p)
    want = {2: "com/en/", 3: "com/en/", 4: "example.com/en/7", 5: "com/en/", 6: "example.net/de/8", 10: "org/es/"}
    assert {r.page_id: r.rule for r in got.collect() if r.rule} == want
    large = urlfilter.filter_urls(p, rules, max_rule_bytes=0)
    assert sorted(map(str, got.collect())) == sorted(map(str, large.collect())) and urlfilter.filter_urls(p.limit(0)).count() == 0
    odd = rules.unionByName(spark.createDataFrame([(None, "com", "/en/"), ("block", None, "/"), ("allow", "COM", "/en/")], rules.schema))
    clashing = p.withColumnsRenamed({"rule": "_rest"}).withColumn("host", F.lit("h"))
    for most in (0, 1 << 20):
        judged = urlfilter.filter_urls(clashing, odd, max_rule_bytes=most)
        assert {r.page_id: r.rule for r in judged.collect() if r.rule} == want and {r.verdict for r in judged.filter("rule = 'com/en/'").collect()} == {"allow"}


def test_mixing(docs, empty):
    got = mixing.select(docs).collect()
    sizes = {i: len(words(t)) for i, t in enumerate(texts())}
    total = sum(sizes.values())
    taken = sum(r.take_tokens for r in got)
    assert total * 1.25 - 30 <= taken <= total * 1.25
    leaves = {}
    for r in got:
        assert 0 < r.take_tokens <= r.n_tokens == sizes[r.doc_id] and r.epoch < 2
        leaves.setdefault((r.lang, r.source), []).append(r)
    for rows in leaves.values():  # at most one document of a leaf is cut, in its last epoch
        assert sum(r.take_tokens < r.n_tokens for r in rows) <= 1
    assert mixing.select(empty).count() == 0
    out = mixing.mix(docs)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == taken


def test_mixing_against_plain_selection(spark):
    """Which documents form the seeded prefix of each leaf's epochs."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), ("en", "de")[i % 2], f"src{i % 3}") for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for percent in (45, 170):
        m = mixing.Mixture({}, percent, 2)
        got = sorted((r.lang, r.source, r.epoch, r.doc_id, r.take_tokens) for r in mixing.select(d, m).collect())
        sizes = {i: 1 + i * 7 % 23 for i, *_ in rows}
        leaves = {}
        for i, _, lang, source in rows:
            leaves.setdefault((lang, source), []).append(i)
        sums = [(r.domain, r.lang, r.source, sum(sizes[i] for i in leaves[r.lang, r.source]), len(leaves[r.lang, r.source])) for r in d.select(mixing.domain_of(F.col("source")).alias("domain"), "lang", "source").distinct().collect()]
        takes = {(r.lang, r.source): r.take for r in mixing.leaf_budgets(spark.createDataFrame(sums, "domain string, lang string, source string, tokens long, docs long"), m).collect()}
        want = []
        for (lang, source), ids in leaves.items():
            whole, rest = divmod(takes[lang, source], sum(sizes[i] for i in ids))
            want += [(lang, source, e, i, sizes[i]) for e in range(whole) for i in ids]
            place = {r.doc_id: (r.p % 2**64 >> 33, r.p) for r in d.select("doc_id", F.xxhash64(F.lit(m.seed), F.lit(whole).cast("long"), "doc_id").alias("p")).collect()}
            for i in sorted(ids, key=lambda i: (*place[i], i)):
                if rest > 0:
                    want.append((lang, source, whole, i, min(rest, sizes[i])))
                rest -= sizes[i]
        assert got == sorted(want)


def test_stages_of_empty_tables(empty):
    for f in (quality.keep_good, mixing.mix, jaccard.keep_first, pii.mask):
        assert f(empty).count() == 0 and f(empty).columns == empty.columns


def test_packing_keeps_target_proportions(spark):
    """Every window holds each source's target share of tokens within its longest document, until a source runs out."""
    r = random.Random(7)
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    rows = [(i, " ".join(["word"] * r.randrange(1, 30)), r.choice("abc")) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), tokenizer_path(), 512, weights).collect()
    source, spent, total = {i: s for i, _, s in rows}, dict.fromkeys("abc", 0), dict.fromkeys("abc", 0)
    for x in got:
        total[source[x.doc_id]] += x.length
    # The windows before the first source ends.
    ends = int(min(total[s] / weights[s] for s in "abc")) // 512 - 1
    longest = 30
    assert ends > 5
    for w in range(ends):
        for x in (x for x in got if x.sequence_id == w):
            spent[source[x.doc_id]] += x.length
        for s in "abc":
            assert abs(spent[s] - weights[s] * 512 * (w + 1)) <= 2 * longest + 2


def test_mixing_null_and_repeated_ids(spark):
    """Each selected row comes back once per epoch, whatever its id; clashing names are kept."""
    rows = [(i if i < 40 else 7 if i < 60 else None, " ".join(f"t{i}x{k}" for k in range(5 + i % 9)), "en", "src0", 0, f"r{i}", 3) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, tag string, k long").repartition(3)
    total = sum(len(words(r[1])) for r in rows)
    twice = mixing.mix(d, mixing.Mixture({}, 200, 2))
    got = [(r.doc_id, r.text, r.tag, r.k) for r in twice.collect()]
    assert twice.columns == d.columns and sorted(map(str, got)) == sorted(str((r[0], r[1], r[5], r[6])) for r in rows * 2)
    for percent in (125, 60):
        m = mixing.Mixture({}, percent, 2)
        taken = [r.take_tokens for r in mixing.select(d, m).collect()]
        out = mixing.mix(d, m).collect()
        assert sum(taken) == total * percent // 100 and sorted(len(words(r.text)) for r in out) == sorted(taken)
        whole = {r[5]: r[1] for r in rows}
        short = [r for r in out if r.text != whole[r.tag]]
        assert len(short) <= 1 and all(whole[r.tag].startswith(r.text + " ") for r in short)
        assert len({r.tag for r in out}) == (100 if percent > 100 else len(out))
    clashing = d.withColumnsRenamed({"n": "n_tokens", "tag": "_row", "k": "take_tokens"})
    assert mixing.mix(clashing).columns == clashing.columns and sorted({r[0] for r in mixing.mix(clashing).select("_row").collect()}) == sorted(whole)


def test_budget_goes_to_siblings_before_ancestors(spark):
    m = mixing.Mixture({"source": {"a": 1, "b": 1}}, 100, 1)
    rows = [("d", "en", "a", 10, 1), ("d", "en", "b", 100, 1), ("e", "en", "c", 90, 1)]
    got = {r.source: r.take for r in mixing.leaf_budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, docs long"), m._replace(budget_percent=80)).collect()}
    assert got == {"a": 10, "b": 70, "c": 80}  # 80 each for d and e; what a lacks of 40 goes to b


def test_pipeline_stages(spark, docs):
    c = pytest.importorskip("corpus_pipeline")
    out = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in c.STAGES[:-1]:
        out = stored(stage(spark, out, ""), "stage")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert c.STAGES[-1][1](spark, out, "").agg(F.sum("length")).first()[0] > 0
