"""The Jaccard join's regions, cells and tiles against brute force, and its hashes against words made to collide."""

import random

import numpy as np
import pytest

pytest.importorskip("termloom.llm.queries")
from termloom.llm import hashing, jaccard  # noqa: E402


def brute(sets, percent):
    """The least number that each set reaches by links."""
    root = list(range(len(sets)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def families(r, groups, copies, size, change):
    """Sets in groups of near copies, all with some common shingles."""
    common, out = [r.getrandbits(63) for _ in range(size // 3)], []
    for _ in range(groups):
        base = common + [r.getrandbits(63) for _ in range(size)]
        for _ in range(copies):
            out.append({x if r.random() > change else r.getrandbits(63) for x in base})
    r.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 20_000, 4_000, 700])
def test_cells_and_tiles(spark, limit):
    """One connected region of near-copy groups that share a passage: joined at once, by cells, and by tiles."""
    sets = families(random.Random(limit), 6, 12, 50, 0.04)
    bound = jaccard.Bound(80)
    frame = spark.createDataFrame([(i, bytearray(np.array(sorted(s), "<u8").tobytes())) for i, s in enumerate(sets)], "id long, hashes binary").repartition(3)
    regions = spark.createDataFrame([(0, i, i, 8 * len(s)) for i, s in enumerate(sets)], "region long, id long, root long, bytes long")
    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    opened = spark.createDataFrame([(k, i) for k, own in held.items() if len(own) > 1 for i in own], "key long, id long")
    links = [(r.a, r.b) for r in jaccard.region_links(regions, opened, frame, bound, limit).collect()]
    root = list(range(len(sets)))
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert root == brute(sets, 80)


@pytest.mark.parametrize("limit", [1 << 22, 6_000])
def test_large_groups_and_long_texts(spark, limit):
    """A large group of near copies, texts that quote one passage, one very long text, null and repeated ids."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    hot = [f"h{i}" for i in range(40)]
    texts = []
    for k in range(120):
        w = list(hot)
        for _ in range(r.choice((0, 1, 1, 2, 4))):
            w[r.randrange(40)] = f"x{r.randrange(6)}"
        texts.append(" ".join(w))
    texts += [" ".join(passage + [f"u{r.randrange(10**9)}" for _ in range(r.randrange(2, 40))]) for _ in range(80)]
    long = " ".join(f"l{r.randrange(10**9)}" for _ in range(60_000))
    texts += [long, long + " tail", "y" * 50_000, None, ""]
    ids = [i if i % 17 else None for i in range(len(texts))]
    docs = spark.createDataFrame([*zip(ids, texts, strict=True), (3, texts[3])], "doc_id long, text string").repartition(5)
    got = sorted(map(str, jaccard.join(docs, 3, 90, limit).collect()))
    sets, order = [], sorted(range(len(texts)), key=lambda i: (ids[i] is None, i))
    for i in order:
        w = (texts[i] or "").split()
        sets.append({tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()})
    rows = [(ids[i], len(sets[k]), ids[order[root]] if sets[k] else ids[i]) for k, (i, root) in enumerate(zip(order, brute(sets, 90), strict=True))]
    rows.append(next(x for x in rows if x[0] == 3))
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in rows)


def morse(n, odd):
    return bytes(97 + ((bin(i).count("1") + odd) & 1) for i in range(n))


def test_words_made_to_collide(spark):
    """Thue-Morse words collide in every polynomial modulo 2^64; not here."""
    a, b = morse(2048, 0), morse(2048, 1)
    for family in (0, 1):
        h = hashing.word_hashes([a + b" " + b], family=family)[0]
        assert h[0] != h[1]
    texts = [" ".join([w.decode(), *(f"w{i % 2}" for i in range(2))] * 5) for w in (a, b)]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 2}


def test_hashes_do_not_depend_on_place():
    parts = [b"x", b"", b"longer " * 3, b"y" * 300, b"x " + b"y" * 300]
    words, counts = hashing.word_hashes(parts)
    alone = [hashing.word_hashes([p])[0].tolist() for p in parts]
    assert words.tolist() == sum(alone, []) and counts.tolist() == [1, 0, 3, 1, 2]
    assert hashing.word_hashes([b"y" * 301])[0][0] != words[4]


def test_chance_reads_no_sets(spark, monkeypatch):
    """Texts that share a rare shingle and nothing else are told apart by their keys; links among them are still found."""
    r, read, sets_of = random.Random(5), [], jaccard.sets_of
    monkeypatch.setattr(jaccard, "sets_of", lambda docs, wanted, *a: (read.extend(x.id for x in wanted.select("id").collect()), sets_of(docs, wanted, *a))[1])
    texts = [[f"c{k // 4}_{j}" for j in range(3)] + [f"u{r.randrange(10**12)}" for _ in range(100)] for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert {x.doc_id: x.component_id for x in jaccard.join(docs).collect()} == {k: k for k in range(40)}
    assert not read
    near = [" ".join([*w[:60], "other", *w[61:]]) for w in texts[::5]]
    both = docs.union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(near)], docs.schema)).coalesce(1)
    got = {x.doc_id: x.component_id for x in jaccard.join(both).collect()}
    assert got == {k: k for k in range(40)} | {100 + k: 5 * k for k in range(8)}
    assert len(set(read)) == 16


@pytest.mark.parametrize("many", [1024, 4])
def test_chance_ties_no_regions(spark, monkeypatch, many):
    """Phrases that many texts share by chance, and that no count tells to be frequent, tie no texts together; links among them are found."""
    r, read, sets_of = random.Random(7), [], jaccard.sets_of
    monkeypatch.setattr(jaccard, "frequencies", lambda docs, ngram: np.zeros(1 << 24, np.uint8))
    monkeypatch.setattr(jaccard, "MANY", many, raising=False)
    monkeypatch.setattr(jaccard, "PAIRS", 200, raising=False)
    monkeypatch.setattr(jaccard, "sets_of", lambda docs, wanted, *a: (read.extend(x.id for x in wanted.select("id").collect()), sets_of(docs, wanted, *a))[1])
    texts = [" ".join(f"p{p}a p{p}b p{p}c u{r.randrange(10**12)}" for p in r.sample(range(100), 25)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert {x.doc_id: x.component_id for x in jaccard.join(docs).collect()} == {k: k for k in range(60)}
    # A pair may share enough leading keys by chance.
    assert many == 4 or len(set(read)) <= 6
    for k in range(0, 60, 4):
        for _ in range(k % 3 + 1):
            w = texts[k].split()
            w[r.randrange(100)] = "other"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in jaccard.join(docs).collect()}
    words = [t.split() for t in texts]
    assert [got[k] for k in range(len(texts))] == brute([{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words], 90)
