"""Personal data: pattern detectors, and a skip-chain conditional random field that adds what they miss.

The field's nodes are the words with a digit or an "@"; all other words can only be outside. Neighbouring
nodes share a chain potential. Words of one document with the same key of 5 characters or more (their letters
and digits, for long numbers the digits) share skip potentials with one hub, so the number of edges is linear
and every repeat is as near as the next. A word that the patterns have found is held to its label; a key of
such a word, or of a whole found span, has its hub held as well, so other words of the key don't outvote it:
the label reaches every repeat alike, and the same number in another spelling of one word. Hubs without a held
word weigh the scores of all their words. Damped loopy message passing over all documents of a batch, each
until it has converged, gives each word's marginals.

A number in several words ("49 170 1234567") is a node of its own where its digits are a key that the document has
elsewhere as well. Beside the four kinds of the patterns the field labels secrets: long random strings, as tokens and keys.

Weights are fitted by logistic regression on sentences drawn by a seeded generator of ``TRAINING_SENTENCES``
sentences; no corpus is read. The skip potential is fitted after them, in the same way, to repeats of the
sentences' words without their cues. These keep their labels always, so the penalty and the number of steps
bound it. The chain potential is fitted by pseudo-likelihood to lists, where two words of three have their
neighbour's kind. Only the weight of held words is set by hand.

Defined results: a null or empty text has no spans; repeated rows are searched each; all searches are
linear in the text; an empty table gives no rows; extra columns are kept by ``mask`` and not read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import warnings
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field: those of the patterns, and one that only the field knows.
LABELS = (*KINDS, "secret")
TRAINING_SENTENCES, SEED = 3000, 7
#: Least marginal of a span that the field adds.
LEAST_MARGINAL = 0.9

_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: the run's first digit would have matched as well.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_MARK = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RANDOM = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{20,}+")
_HEX = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{24,}+|(?=.*[0-9])(?=.*[A-F])[0-9A-F]{24,}+")
#: Words of a number at most.
MOST_PARTS = 6
_PART = re.compile(r"[^0-9A-Za-z@]*+[0-9][0-9().+/-]*+[^0-9A-Za-z@]*+")
_TRIM = re.compile(r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Every match holds one "@" that its local part can't: so go from one to the next."""
    free, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > free and not _LOCAL_END.match(t, start - 1):
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = t.find("@", free)


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in t:
        out += ((a, 0, b) for a, b in _emails(t))
    if _MARK.search(t):
        out += ((m.start(), 1, m.end()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()))
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Words that hint at a kind, looked for in the two words before.
CUES = (("mail", "email", "e-mail", "contact", "write"), ("ip", "server", "host", "address", "from"), ("card", "visa", "credit", "pay", "account"), ("phone", "tel", "call", "fax", "mobile"), ("token", "key", "secret", "password", "apikey"))
_BARE = re.compile(r"[^a-z-]+")


def features(word: str, before: tuple[str, ...]) -> list[int]:
    """Numbers of the binary features that hold."""
    w = _TRIM.sub("", word)
    digits = _NOT_DIGIT.sub("", w)
    n, letters = len(digits), sum(c.isalpha() for c in w)
    out = [0, 1 + min(7, (0 if not n else 1 if n < 4 else 2 if n < 7 else 3 if n < 10 else 4 if n < 14 else 5 if n < 20 else 6))]
    parts = w.split(".")
    at = w.find("@")
    flags = (
        0 < at < len(w) - 1, at > 0 and "." in w[at:], w.startswith("+"), not letters and n > 0, letters > 0 and n > 0, "-" in w, "(" in word, len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts),
        13 < n < 20 and luhn(digits), "=" in w, "/" in w, ":" in w, _RANDOM.fullmatch(w) is not None, _HEX.fullmatch(w) is not None,
    )
    out += [9 + i for i, x in enumerate(flags) if x]
    cues = {_BARE.sub("", b.lower()) for b in before}
    return out + [9 + len(flags) + k for k in range(5) if cues & set(CUES[k])]


N_FEATURES, N_LABELS = 9 + 14 + 5, 6


def skip_key(word: str) -> str:
    """Equal for repeats of a word and for spellings of one number."""
    w = _TRIM.sub("", word).casefold()
    digits = _NOT_DIGIT.sub("", w)
    return digits if len(digits) >= 9 and not any(c.isalpha() for c in w) else w


def training_sentences(n: int, seed: int, lists: bool = False) -> Iterator[tuple[list[str], list[int]]]:
    """Invented sentences (or lists of two neighbours) with labels 0 (outside) or 1 + kind."""
    r = random.Random(seed)
    syllables = ("an", "ter", "lo", "mi", "re", "sta", "ven", "or", "du", "kel")
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    number = lambda n: "".join(r.choices("0123456789", k=n))

    def card() -> str:
        d = number(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    plain = (
        lambda: number(r.randint(1, 6)), lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: f"${number(3)}.{number(2)}", lambda: f"v{number(1)}.{number(1)}.{number(2)}",
        lambda: f"{word()}={r.getrandbits(72):018x}", lambda: f"@{word()}", lambda: number(r.randint(7, 22)), lambda: f"http://{word()}.com/{number(4)}", lambda: f"{number(3)}/{number(4)}", lambda: f"{word()}{number(2)}",
    )
    found = (
        lambda: f"{word()}.{word()}@{word()}.com", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card,
        lambda: r.choice(("+{}{}{}", "{}-{}-{}", "+{}-{}-{}", "({}){}-{}")).format(number(3), number(3), number(r.randint(4, 6))),
        lambda: "".join(r.choices("0123456789abcdef", k=r.randint(32, 64))) if r.random() < 0.5 else "".join(r.choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=r.randint(24, 48))),
    )
    if lists:
        for _ in range(n):
            kind = r.randint(1, 5)
            labels = [kind, kind if r.random() < 2 / 3 else r.choice([k for k in range(6) if k != kind])]
            yield [found[k - 1]() if k else r.choice(plain)() for k in labels], labels
        return
    for _ in range(n):
        words, labels = [], []
        for _ in range(r.randint(2, 6)):
            words += [word() for _ in range(r.randint(1, 4))]
            kind = r.choice((0, 0, 0, 1, 2, 3, 4, 5))
            if kind and r.random() < 0.6:
                words.append(r.choice(CUES[kind - 1]))
            labels += [0] * (len(words) - len(labels))
            words.append(found[kind - 1]() if kind else r.choice(plain)())
            labels.append(kind)
        yield words, labels


@cache
def fitted(sentences: int = TRAINING_SENTENCES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary weights (features, labels), chain and skip potentials (labels, labels)."""
    rows, labels, again = [], [], []
    for words, own in training_sentences(sentences, seed):
        for i, (w, y) in enumerate(zip(words, own, strict=True)):
            if _MARK.search(w):
                rows.append(features(w, tuple(words[max(0, i - 2) : i])))
                labels.append(y)
                again.append(features(skip_key(w), ()))
    # Equal rows of features are one, with the shares of its labels.
    kinds = sorted({tuple(f) for f in rows})
    number = {f: k for k, f in enumerate(kinds)}
    x, y = np.zeros((len(kinds), N_FEATURES)), np.zeros((len(kinds), N_LABELS))
    for k, f in enumerate(kinds):
        x[k, list(f)] = 1
    for f, label in zip(rows, labels, strict=True):
        y[number[tuple(f)], label] += 1 / len(rows)
    share = y.sum(1, keepdims=True)
    w = np.zeros((N_FEATURES, N_LABELS))
    for _ in range(400):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        w -= 2.0 * (x.T @ (share * p / p.sum(1, keepdims=True) - y) + 1e-5 * w)
    y = np.eye(N_LABELS)[labels]
    pairs = [(features(v, ()), features(u, (v,)), k, m) for (v, u), (k, m) in training_sentences(sentences, seed + 1, True) if _MARK.search(v) and _MARK.search(u) and k]
    second, chained = np.stack([w[f].sum(0) for _, f, _, _ in pairs]), 0.0
    first, truth = np.eye(N_LABELS)[[k for _, _, k, _ in pairs]], np.eye(N_LABELS)[[m for _, _, _, m in pairs]]
    for _ in range(400):
        z = second + chained * first
        p = np.exp(z - z.max(1, keepdims=True))
        chained += 2.0 * ((first * (truth - p / p.sum(1, keepdims=True))).sum(1).mean() - 1e-5 * chained)
    chain = np.where(np.eye(N_LABELS, dtype=bool), chained, 0.0)
    chain[0, 0] = 0.0
    scores, skip = np.stack([w[f].sum(0) for f in again]), 0.0
    for _ in range(400):
        z = scores + skip * y
        p = np.exp(z - z.max(1, keepdims=True))
        skip += 2.0 * ((1 - (p * y).sum(1) / p.sum(1)).mean() - 1e-5 * skip)
    return w, chain, np.where(np.eye(N_LABELS, dtype=bool), skip, 0.0)


#: Largest change of a message, in logarithms, at which a document has converged.
TOLERANCE = 1e-6
#: Rounds after which steps are halved, and after which a document that still changes is told of in a warning.
SLOWER, LAST = 200, 5000


def marginals(unary: np.ndarray, left: np.ndarray, right: np.ndarray, pair: np.ndarray, group: np.ndarray, damping: float = 0.5) -> np.ndarray:
    """Loopy sum-product in logarithms until it has converged. pair: (edges, labels, labels), symmetric in use; group: each edge's document.

    A document's messages rest once they have all converged, so its marginals don't depend on the others.
    """
    n, e = len(unary), len(left)
    src, dst = np.concatenate([left, right]), np.concatenate([right, left])
    pots = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    m = np.zeros((2 * e, unary.shape[1]))

    def beliefs() -> np.ndarray:
        return unary + np.stack([np.bincount(dst, m[:, k], n) for k in range(unary.shape[1])], 1)

    group, step, rounds = np.concatenate([group, group]), 1 - damping, 0
    on = np.arange(2 * e)
    while len(on):
        x = (beliefs()[src[on]] - m[back[on]])[:, :, None] + pots[on]
        top = x.max(1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
        change = new - new.max(1, keepdims=True) - m[on]
        m[on] += step * change
        worst = np.zeros(group.max() + 1)
        np.maximum.at(worst, group[on], np.abs(change).max(1))
        on = on[worst[group[on]] > TOLERANCE]
        rounds += 1
        if rounds % SLOWER == 0:
            step /= 2
        if rounds == LAST and len(on):
            warnings.warn(f"{len(np.unique(group[on]))} documents have not converged", stacklevel=2)
            break
    b = beliefs()
    b = np.exp(b - b.max(1, keepdims=True))
    return b / b.sum(1, keepdims=True)


def find_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, as (start, kind, end)."""
    weights, chain, skip = model
    base, nodes, feats, left, right, kinds, told = [], [], [], [], [], [], []
    hubs: list[list[int]] = []
    for d, t in enumerate(texts):
        own = base_spans(t)
        base.append(own)
        if not _MARK.search(t):
            continue
        before, last, at = ("", ""), -2, 0
        ties: dict[str, list[int]] = {}
        # Labels that the patterns tell of a key, by the key of the span or of a word in it.
        known: dict[str, np.ndarray] = {}
        parts: list[tuple[int, int, int, str, tuple]] = []  # words that may be parts of a number: place, start, end, digits, words before
        for a, kind, b in own:
            key = skip_key(t[a:b])
            if len(key) >= 5:
                known.setdefault(key, np.zeros(N_LABELS))[kind + 1] += 1
        for i, m in enumerate(_WORD.finditer(t)):
            w = m[0]
            if _MARK.search(w):
                k = len(nodes)
                trim = _TRIM.sub("", w)
                a = m.start() + max(0, w.find(trim))
                b = a + len(trim)
                while at < len(own) and own[at][2] <= m.start():
                    at += 1
                held, j = 0, at
                while j < len(own) and own[j][0] < m.end() and not held:
                    held, j = own[j][1] + 1 if own[j][2] > m.start() else 0, j + 1
                nodes.append((d, a, b, held))
                feats.append(features(w, before))
                if last == i - 1:
                    left.append(k - 1), right.append(k), kinds.append(0)
                key = skip_key(w)
                if len(key) >= 5:
                    ties.setdefault(key, []).append(k)
                    if held:
                        known.setdefault(key, np.zeros(N_LABELS))[held] += 1
                if not held and _PART.fullmatch(w):
                    parts.append((i, a, b, _NOT_DIGIT.sub("", w), before))
                last = i
            before = (before[1], w)
        for k, (i, a, _, digits, cues) in enumerate(parts):
            for n, (j, _, b, more, _) in enumerate(parts[k + 1 : k + MOST_PARTS], 1):
                if j != i + n or len(digits) + len(more) > 19:
                    break
                digits += more
                if len(digits) >= 9 and (digits in known or digits in ties):
                    ties.setdefault(digits, []).append(len(nodes))
                    nodes.append((d, a, b, 0))
                    feats.append(features(digits, cues))
        for key, tied in ties.items():
            if key in known:
                message = np.log(known[key] / known[key].sum() @ np.exp(skip))
                told += ((k, message) for k in tied if not nodes[k][3])
            elif len(tied) > 1:
                hubs.append(tied)
    added: list[list] = [[] for _ in texts]
    if nodes:
        unary = np.stack([weights[f].sum(0) for f in feats])
        held = np.array([x[3] for x in nodes])
        unary[np.flatnonzero(held), held[held > 0]] += 20.0
        for k, message in told:
            unary[k] += message
        for h, tied in enumerate(hubs, len(nodes)):
            for k in tied:
                left.append(k), right.append(h), kinds.append(1)
        unary = np.concatenate([unary, np.zeros((len(hubs), N_LABELS))])
        pair = np.where(np.array(kinds, int)[:, None, None] == 0, chain, skip)
        group = np.array([nodes[k][0] for k in left], int)
        p = marginals(unary, np.array(left, int), np.array(right, int), pair, group)[: len(nodes)]
        for i in np.flatnonzero((p[:, 1:].max(1) >= LEAST_MARGINAL) & (held == 0)).tolist():
            d, a, b, _ = nodes[i]
            if b > a:
                added[d].append((a, int(p[i, 1:].argmax()), b))
    return [(own, sorted(own + _apart(more, own))) for own, more in zip(base, added, strict=True)]


def _apart(more: list, own: list) -> list:
    """Added spans that meet no base span, and of those that meet each other the longer ones; both lists are walked once."""
    # Of the base spans that start before a place, the furthest end.
    starts = [s[0] for s in own]
    ends = list(itertools.accumulate((s[2] for s in own), max))
    out: list = []
    for s in sorted(more, key=lambda s: (s[0], -s[2])):
        n = bisect.bisect_left(starts, s[2])
        if (not n or ends[n - 1] <= s[0]) and (not out or out[-1][2] <= s[0]):
            out.append(s)
    return out


def shown(spans: list) -> str:
    return ",".join(f"{LABELS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans (all), n_spans (their number)."""
    model = fitted()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found = find_spans(part.column("text").to_pylist(), model)
                counts = [pa.array([sum(s[1] == k for s in own) for own, _ in found], pa.int64()) for k in range(4)]
                sha = pa.array([hashlib.sha256(shown(own).encode()).hexdigest() for own, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, sha, pa.array([shown(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(batches, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str, spans: list) -> str:
    """The text with every span, or run of overlapping spans, replaced by its first kind."""
    out, at, open_end, kind = [], 0, -1, 0
    for a, k, b in spans:
        if a < open_end:
            open_end = max(open_end, b)
            continue
        if open_end >= 0:
            out.append(f"[{LABELS[kind].upper()}]")
            at = open_end
        out.append(text[at:a])
        open_end, kind = b, k
    if open_end >= 0:
        out.append(f"[{LABELS[kind].upper()}]")
        at = open_end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in their texts; a null text stays null, n_chars follows the text."""
    model = fitted()
    names, schema = docs.columns, docs.schema
    new = max([*names, ""], key=len) + "_masked"  # a name that no column has

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = part.column(names.index("text")).to_pylist()
                found = find_spans([t or "" for t in texts], model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if t is None else masked(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string())], names=[*part.schema.names, new])

    out = docs.mapInArrow(batches, T.StructType([*schema.fields, T.StructField(new, T.StringType())]))
    out = out.withColumn("text", F.col(new)).drop(new)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out.select(*names)
