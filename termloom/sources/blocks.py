"""Blocks of a term dictionary as bytes, and the pointers by which an index finds them.

A block holds the terms that share a prefix: their suffixes, how long each is, the statistics (runs of terms that
occur once are one token) and the pointers into the postings, each a column of bytes. A pointer names a block, or the
first of several "floor" blocks with the labels at which the others start.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from termloom.operators import codecs

from .cursor import Cursor, blob, varying

#: Ids from which a term's postings have blocks and skip data.
BLOCK = 128


class Options(NamedTuple):
    """What a field's index holds."""

    freqs: bool = True
    positions: bool = False
    offsets: bool = False
    payloads: bool = False


class State(NamedTuple):
    """A term's statistics and where its postings lie; singleton: the only document of a term in one document."""

    doc_freq: int
    total_term_freq: int
    doc_start: int
    singleton: int | None = None
    pos_start: int = 0
    pay_start: int = 0
    last_pos_block: int | None = None
    skip: int | None = None


def stats_bytes(states: Sequence[State], options: Options) -> bytes:
    """Runs of terms that occur once are one odd token."""
    out, run = bytearray(), 0
    for s in [*states, None]:
        if s and s.doc_freq == s.total_term_freq == 1:
            run += 1
            continue
        if run:
            out += varying((run - 1) << 1 | 1)
            run = 0
        if s:
            out += varying(s.doc_freq << 1)
            if options.freqs:
                out += varying(s.total_term_freq - s.doc_freq)
    return bytes(out)


def stats_of(data: bytes, count: int, options: Options) -> list[tuple[int, int]]:
    """(doc_freq, total_term_freq) of the first so many terms."""
    c, out = Cursor(data), []
    while len(out) < count:
        token = c.varying()
        if token & 1:
            out += [(1, 1)] * (1 + (token >> 1))
        else:
            out.append((token >> 1, (token >> 1) + (c.varying() if options.freqs else 0)))
    return out[:count]


def postings_bytes(states: Sequence[State], options: Options) -> bytes:
    """Pointers as differences to the term before; after a singleton in the same place, the next one's document as a difference."""
    out, doc, pos, pay, last = bytearray(), 0, 0, 0, None
    for s in states:
        if s.singleton is not None and last is not None and s.doc_start == doc and s.singleton >= last:
            out += varying((s.singleton - last) << 1 | 1, 64)
        else:
            out += varying((s.doc_start - doc) << 1, 64)
            if s.doc_freq == 1:
                out += varying(s.singleton)
        if options.positions:
            out += varying(s.pos_start - pos, 64)
            if options.offsets or options.payloads:
                out += varying(s.pay_start - pay, 64)
            if s.total_term_freq > BLOCK:
                out += varying(s.last_pos_block, 64)
        if s.doc_freq > BLOCK:
            out += varying(s.skip, 64)
        doc, pos, pay, last = s.doc_start, s.pos_start, s.pay_start, s.singleton
    return bytes(out)


def states_of(stats: list[tuple[int, int]], data: bytes, options: Options) -> list[State]:
    """The states of so many terms: running sums of the pointers."""
    c, out, doc, pos, pay, last = Cursor(data), [], 0, 0, 0, None
    for df, ttf in stats:
        code = c.varying()
        if code & 1:
            last += code >> 1
        else:
            doc += code >> 1
            last = c.varying() if df == 1 else None
        pos_block = None
        if options.positions:
            pos += c.varying()
            if options.offsets or options.payloads:
                pay += c.varying()
            if ttf > BLOCK:
                pos_block = c.varying()
        out.append(State(df, ttf, doc, last, pos, pay, pos_block, c.varying() if df > BLOCK else None))
    return out


def block_bytes(suffixes: Sequence[bytes], states: Sequence[State], options: Options = Options(), codec: int = 0) -> bytes:
    """A leaf block: entries, suffixes in the codec, their lengths (one byte if they are all equal), statistics, pointers."""
    whole = b"".join(suffixes)
    packed = codecs.CODECS[codec].compress(whole)
    lengths = b"".join(varying(len(s)) for s in suffixes)
    equal = len(set(lengths)) == 1
    out = varying(len(suffixes) << 1 | 1) + varying(len(whole) << 3 | 4 | codec, 64) + packed
    out += varying(len(lengths) << 1 | equal) + (lengths[:1] if equal else lengths)
    return out + blob(stats_bytes(states, options)) + blob(postings_bytes(states, options))


def split_suffixes(data: bytes, lengths: bytes, count: int) -> list[bytes]:
    """The pieces that so many lengths cut the bytes into."""
    c, n = Cursor(data), Cursor(lengths)
    return [c.take(n.varying()) for _ in range(count)]


def read_block(data: bytes, at: int, options: Options = Options()) -> tuple[list[bytes], bytes, bytes]:
    """Suffixes, statistics and pointers of the block that starts there."""
    c = Cursor(data, start=at)
    count = c.varying() >> 1
    code = c.varying()
    if not code & 4:
        raise NotImplementedError("only leaf blocks hold terms alone")
    whole = codecs.codec(code & 3).decompress(c, code >> 3)
    n = c.varying()
    lengths = bytes([c.byte()]) * (n >> 1) if n & 1 else c.take(n >> 1)
    return split_suffixes(whole, lengths, count), c.blob(), c.blob()


def seek_in_block(data: bytes, at: int, suffix: bytes, options: Options = Options()) -> State | None:
    """The state of the term with that suffix; only the terms up to it are decoded."""
    suffixes, stats, postings = read_block(data, at, options)
    try:
        k = suffixes.index(suffix)
    except ValueError:
        return None
    return states_of(stats_of(stats, k + 1, options), postings, options)[-1]


class Floor(NamedTuple):
    """A block of a pointer: the least label of its terms (None for the first), where it starts, whether it holds terms."""

    label: int | None
    start: int
    has_terms: bool = True


def pointer_bytes(floors: Sequence[Floor]) -> bytes:
    first, rest = floors[0], floors[1:]
    out = varying(first.start << 2 | first.has_terms << 1 | bool(rest), 64)
    if rest:
        out += varying(len(rest))
        out += b"".join(bytes([f.label]) + varying((f.start - first.start) << 1 | f.has_terms, 64) for f in rest)
    return out


def pointer_floors(data: bytes) -> list[Floor]:
    c = Cursor(data)
    code = c.varying()
    out = [Floor(None, code >> 2, bool(code & 2))]
    if code & 1:
        for _ in range(c.varying()):
            label, own = c.byte(), c.varying()
            out.append(Floor(label, out[0].start + (own >> 1), bool(own & 1)))
    return out


def find_block(data: bytes, label: int | None) -> int | None:
    """Where the block starts that may hold terms with this next byte: the last floor not above it; None if it holds no terms."""
    floors = pointer_floors(data)
    best = floors[0]
    if label is not None:
        best = max((f for f in floors[1:] if f.label <= label), key=lambda f: f.label, default=best)
    return best.start if best.has_terms else None
