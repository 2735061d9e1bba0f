"""Token ids of whole texts for the lower-casing word BPE tokenizer, exactly as its library gives them.

No match of that tokenizer's patterns crosses white space, so each distinct word is encoded once per Python
worker and remembered by 128 bits of hash, some 50 bytes a word, in tables of bounded size. New words are lower-cased, cut
into runs of letters, digits or signs and merged for a whole batch at a time with numpy, by the tokenizer's own list of
merges; words with characters that need its normaliser (or special tokens) go through the library itself.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import regex

from .hashing import span_hashes, split_texts

#: Code points below which lower-casing is all that the normaliser does; but for an apostrophe, as contractions split on it, and those named.
PLAIN_BELOW = 0x180
NOT_PLAIN = "'" + "".join(map(chr, range(0x7F, 0xA1))) + "\u0130"
#: Words remembered per worker; then the tables start anew.
MOST_WORDS = 1_000_000
LETTER, DIGIT, SIGN, OTHER = 1, 2, 3, 0


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point below PLAIN_BELOW (and one for all others): its kind, its lower-case form."""
    kinds, lower = np.zeros(PLAIN_BELOW + 1, np.int8), np.arange(PLAIN_BELOW + 1, dtype=np.uint32)
    for i in range(0x21, PLAIN_BELOW):
        c = chr(i)
        if c not in NOT_PLAIN:
            kinds[i] = LETTER if regex.fullmatch(r"\p{L}", c) else DIGIT if regex.fullmatch(r"\p{N}", c) else SIGN
            lower[i] = ord(c.lower())
    return kinds, lower


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """Open-addressed table from a pair of symbols to (rank, merged symbol), probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 8))))
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.zeros((1 << self.bits) + 64, np.int64)
        key = left.astype(np.int64) << 20 | right
        value = np.arange(len(left), dtype=np.int64) << 20 | merged
        todo, self.probes = np.arange(len(key)), 0
        while len(todo):
            at = self.slot(key[todo]) + self.probes
            free = self.keys[at] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = key[todo[put]], value[todo[put]]
            todo, self.probes = todo[~put], self.probes + 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """rank << 20 | merged, or none."""
        key = left.astype(np.int64) << 20 | right
        at, out = self.slot(key), np.full(key.shape, none, np.int64)
        for _ in range(self.probes):
            hit = self.keys[at] == key
            out[hit] = self.values[at[hit]]
            at = at + 1
        return out


class WordBpe:
    NONE = 1 << 60

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        of = lambda f: np.array([vocab[f(a, b)] for a, b in pairs], np.int64)
        self.table = PairTable(of(lambda a, _: a), of(lambda _, b: b), of(lambda a, b: a + b))
        letters = byte_letters()
        self.byte = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        self.clear()

    def clear(self) -> None:
        self.words, self.pieces = KeyTable(), KeyTable()
        self.piece_ids, self.word_ids = _Lists(), _Lists()

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another and their counts: rounds merge the leftmost pair of lowest rank in every piece at once."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, counts, ids
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(length > 64).tolist():
            ids = self.merged_long(pieces[i])
            done.append((np.array([i]), np.array([len(ids)]), ids))
        wide = (length + 3) // 4 * 4
        for width in np.unique(wide[length <= 64]).tolist():
            every = np.flatnonzero(wide == width)
            for lo in range(0, len(every), 20_000):
                rows = every[lo : lo + 20_000]
                size = length[rows]
                raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(-1, width)
                n, col = np.arange(len(rows)), np.arange(width)
                sym = self.byte[raw]
                sym[n, size - 1] = self.last[raw[n, size - 1]]
                rank = np.full((len(rows), width), self.NONE, np.int64)
                rank[:, :-1] = self.table.find(sym[:, :-1], sym[:, 1:], self.NONE)
                rank[col[None, :] >= size[:, None] - 1] = self.NONE
                while len(rows):
                    at = rank.argmin(1)
                    best = rank[np.arange(len(rows)), at]
                    ended = best == self.NONE
                    if ended.any():
                        done.append((rows[ended], size[ended], sym[ended][col[None, :] < size[ended][:, None]]))
                        going = ~ended
                        rows, sym, rank, size, at, best = rows[going], sym[going], rank[going], size[going], at[going], best[going]
                        if not len(rows):
                            break
                    n = np.arange(len(rows))
                    take = np.minimum(col[None, :] + (col[None, :] > at[:, None]), width - 1)
                    sym, rank = np.take_along_axis(sym, take, 1), np.take_along_axis(rank, take, 1)
                    sym[n, at] = best & 0xFFFFF
                    size = size - 1
                    rank[n, size - 1] = self.NONE
                    for k, ok in ((at, at < size - 1), (at - 1, at > 0)):
                        m = n[ok]
                        rank[m, k[ok]] = self.table.find(sym[m, k[ok]], sym[m, k[ok] + 1], self.NONE)
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        rows, count, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        start = np.cumsum(count) - count
        order = np.argsort(rows)
        return flat[spread(start[order], count[order])], count[order]

    def merged_long(self, piece: bytes) -> np.ndarray:
        """One long piece, in n log n: a heap of pairs over a linked list."""
        import heapq

        raw = np.frombuffer(piece, np.uint8)
        sym = self.byte[raw].tolist()
        sym[-1] = int(self.last[raw[-1]])
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = self.table.find(np.array(sym[:-1]), np.array(sym[1:]), self.NONE).tolist()
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.table.find(np.array([a]), np.array([b]), self.NONE)[0])
            return known[a, b]

        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(found) if r != self.NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = r & 0xFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    q = rank(sym[x], sym[after[x]])
                    if q != self.NONE:
                        heapq.heappush(heap, (q, x, sym[x], sym[after[x]]))
        return np.array([s for s in sym if s >= 0], np.int32)

    def learn(self, new: list[bytes]) -> None:
        """Append the ids of new words, which have the next numbers."""
        kinds, lower = _letters()
        every = np.frombuffer(b" ".join(new).decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        point = np.minimum(every, PLAIN_BELOW)
        ends = np.append(np.flatnonzero(every == 32), len(every))
        starts = np.append(0, ends[:-1] + 1)
        kind = kinds[point]
        # Words that need the library: a character that is not plain, or the beginning of a special token.
        odd = (kind == OTHER) & (every != 32)
        odd[:-1] |= (every[:-1] == 60) & (every[1:] == 124)
        bad = np.add.reduceat(odd.astype(np.int64), starts) > 0
        plain = np.ones(len(every), bool)
        for a, b in zip(starts[bad].tolist(), ends[bad].tolist(), strict=True):
            plain[a:b] = False
        plain &= every != 32
        # A piece starts where a word does, at every digit, and where the kind changes.
        begins = plain.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | ~plain[:-1]
        at = np.flatnonzero(begins)
        word = np.searchsorted(starts, at, "right") - 1
        # The pieces' lower-case UTF-8, each with a blank behind it.
        keep = np.flatnonzero(plain)
        text = np.full(len(keep) + len(at), 32, "<u4")
        text[np.arange(len(keep)) + np.cumsum(begins[keep]) - 1] = lower[point[keep]]
        raw = np.frombuffer(text.tobytes().decode("utf-32-le").encode(), np.uint8)
        stop = np.flatnonzero(raw == 32)
        begin = np.append(0, stop[:-1] + 1) if len(stop) else stop
        number, first = self.pieces.numbers(span_hashes(raw, begin, stop, 0), span_hashes(raw, begin, stop, 1))
        data = raw.tobytes()
        self.piece_ids.add(*self.merged([data[begin[i] : stop[i]] for i in first.tolist()]))
        per_piece = self.piece_ids.count[number]
        flat = self.piece_ids.flat[spread(self.piece_ids.start[number], per_piece)]
        size = np.bincount(word, per_piece, len(new)).astype(np.int64)
        if bad.any():
            held, other = np.split(flat, np.cumsum(size)[:-1]), np.flatnonzero(bad).tolist()
            for k in range(0, len(other), 1000):
                some = other[k : k + 1000]
                for i, e in zip(some, self.library.encode_batch_fast([new[i].decode("utf-8", "replace") for i in some], add_special_tokens=False), strict=True):
                    held[i] = np.array(e.ids, np.int32)
                    size[i] = len(held[i])
            flat = np.concatenate(held)
        self.word_ids.add(flat, size)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        out: list[np.ndarray] = []
        for raw, start, end, counts in split_texts(texts):
            if len(self.words) > MOST_WORDS:
                self.clear()
            number, first = self.words.numbers(span_hashes(raw, start, end, 0), span_hashes(raw, start, end, 1))
            if len(first):
                data = raw.tobytes()
                self.learn([data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            count = self.word_ids.count[number]
            flat = self.word_ids.flat[spread(self.word_ids.start[number], count)]
            cut = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(counts)])]
            out += [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return out


class KeyTable:
    """Numbers for keys of 128 bits in the order of their first appearance: open addressing over whole arrays."""

    def __init__(self) -> None:
        self.bits, self.used = 12, 0
        self.slots = np.full((1 << self.bits) + 64, -1, np.int32)
        self.keys, self.checks = np.zeros(1 << 11, np.uint64), np.zeros(1 << 11, np.uint64)

    def __len__(self) -> int:
        return self.used

    def _find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, -1 for unknown ones, and the free slot that ended the search."""
        out, at = np.full(len(key), -1), (key >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            held = self.slots[at[open_]]
            hit = (held >= 0) & (self.keys[held] == key[open_]) & (self.checks[held] == check[open_])
            out[open_[hit]] = held[hit]
            open_ = open_[(held >= 0) & ~hit]
            at[open_] = (at[open_] + 1) % len(self.slots)
        return out, at

    def numbers(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key; for the new ones, which are numbered on, the places of their first appearance."""
        out, _ = self._find(key, check)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out, missing
        _, first, group = np.unique(key[missing], return_index=True, return_inverse=True)
        # Keys that differ in the second half alone get numbers of their own each time.
        same = check[missing] == check[missing[first]][group]
        order = np.argsort(first)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = missing[~same]
        places = np.concatenate([missing[first[order]], own])
        out[missing[same]] = self.used + rank[group[same]]
        out[own] = self.used + len(order) + np.arange(len(own))
        self._add(key[places], check[places], len(order))
        return out, places

    def _add(self, key: np.ndarray, check: np.ndarray, stored: int) -> None:
        while self.used + len(key) > len(self.keys):
            self.keys, self.checks = (np.concatenate([x, np.zeros(len(x), np.uint64)]) for x in (self.keys, self.checks))
        fresh = np.arange(self.used, self.used + stored)
        self.keys[self.used : self.used + len(key)], self.checks[self.used : self.used + len(key)] = key, check
        self.used += len(key)
        if 2 * self.used > 1 << self.bits:
            while 2 * self.used > 1 << self.bits:
                self.bits += 1
            self.slots = np.full((1 << self.bits) + 64, -1, np.int32)
            fresh = np.arange(self.used)
        while len(fresh):
            _, at = self._find(self.keys[fresh], self.checks[fresh])
            free, first = np.unique(at, return_index=True)
            self.slots[free] = fresh[first]
            fresh = np.delete(fresh, first)
            if len(fresh):  # a number that an equal key has taken is not stored again
                known, _ = self._find(self.keys[fresh], self.checks[fresh])
                fresh = fresh[known < 0]


class _Lists:
    """Lists of ids, one after another."""

    def __init__(self) -> None:
        self.room, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def flat(self) -> np.ndarray:
        return self.room[: self.used]

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        while self.used + len(flat) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros(len(self.room), np.int32)])
        self.room[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += len(flat)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run of count, one run after another."""
    upto = np.cumsum(count)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(start - (upto - count), count)


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
