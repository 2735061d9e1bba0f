"""64-bit hashes of words and of runs of words, for whole batches of UTF-8 texts with numpy.

A word's hash is a sum of one pseudo-random number for every eight bytes, told by these and their place in the
word, so that no algebraic identity (as of polynomials modulo 2^64) makes two words equal. A window of a few words
is a polynomial over mixed word hashes. Each family is independent of the others, and a bijective mixer follows each
level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text hashed at once.
CHUNK = 2 << 20
#: Bytes from which a word is hashed by itself.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _number(lane: np.ndarray, place: np.ndarray | int, family: int) -> np.ndarray:
    """The number of eight bytes at a place (counted from 1 in steps of eight)."""
    shift = np.uint64(place * 0xA0761D6478BD642F % (1 << 64)) if isinstance(place, int) else place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(mix(lane + np.uint64(BASES[family])) + shift)


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of UTF-8 bytes that end with a separator."""
    gap = np.flatnonzero(SPACE[raw])
    start = np.concatenate([[0], gap[:-1] + 1])
    some = gap > start
    return start[some], gap[some]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of the words raw[start:end]."""
    lanes = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).data, strides=(1,))
    size = end - start
    total = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in np.flatnonzero(size > LONG).tolist():
        at = np.arange(start[i], end[i], 8)
        total[i] += _number(lanes[at] & _MASKS[np.minimum(end[i] - at, 8)], np.arange(1, len(at) + 1), family).sum(dtype=np.uint64)
    who = np.flatnonzero(size <= LONG) if (size > LONG).any() else slice(None)
    at, left, place = start[who], size[who], 1
    while len(at):
        total[who] += _number(lanes[at] & _MASKS[np.minimum(left, 8)], place, family)
        more = np.flatnonzero(left > 8)
        who = more if isinstance(who, slice) else who[more]
        at, left, place = at[more] + 8, left[more] - 8, place + 1
    return mix(total)


def word_hashes(texts: list[bytes], lower: bool = False, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    hashes, counts = [], []
    for raw, start, end, count in split_texts(texts, lower):
        hashes.append(span_hashes(raw, start, end, family))
        counts.append(count)
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def split_texts(texts: list[bytes], lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts and ends of the words, words of each text) for runs of some CHUNK bytes."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHUNK):
            size += len(texts[hi]) + 1
            hi += 1
        raw = np.frombuffer(b" ".join(texts[lo:hi]) + b" ", np.uint8)
        start, end = words_of(raw)
        edges = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        yield LOWER[raw] if lower else raw, start, end, np.diff(np.searchsorted(start, edges), prepend=0)
        lo = hi


def run_hash(words: np.ndarray, family: int = 0) -> np.ndarray:
    """The hash of all the words as one run, as an array of one number."""
    return window_hashes(words, np.array([len(words)]), len(words), family)[0]


def window_hashes(words: np.ndarray, counts: np.ndarray, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all windows of k words inside one text, number of windows of each text)."""
    size = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    if not total:
        return np.zeros(0, np.uint64), size
    start = np.arange(total) + np.repeat(first - (upto - size), size)
    span = len(words) - k + 1
    h = words[:span].copy()
    for j in range(1, k):
        h *= np.uint64(BASES[1 - family])
        h += words[j : j + span]
    return mix(h + np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)))[start], size
