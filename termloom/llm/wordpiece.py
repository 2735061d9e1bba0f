"""Greedy word-piece token counts by a linear longest-match automaton, without building pieces.

The vocabulary marks the pieces that end a word, so its word pieces are read from a word's end: the last piece is the
longest word-ending token that the word ends with, each one before it the longest inner token that the rest
ends with (the mirror image of pieces with a mark on those that continue a word). Every single byte is a token of both
kinds, so each word has pieces. Texts are brought to the tokenizer's form first: NFC, then lower case by characters.

The trie of the reversed tokens gets, for each node, a failure link and the number of pieces that are popped on
the way: a byte without an edge pops them and goes on from the link, so a text costs a bounded number of steps a byte on
the whole. numpy takes a step for all words of a batch at once. A word ends with the pieces still on its node. Edges are
a hash table of some 4 MB.

Defined results: a null or empty text has 0 words and tokens; repeated rows are counted each; a very long
text or word costs as much a byte as others; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of
from .hashing import split_texts
from .tokens import PairTable, byte_letters

#: A byte that UTF-8 never has stands for a word's end.
END = 255


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(word-ending tokens, inner tokens) of a byte-level vocabulary, without special tokens."""
    with open(path, encoding="utf-8") as f:
        loaded = json.load(f)
    end, special = loaded["model"].get("end_of_word_suffix") or "", {t["content"] for t in loaded["added_tokens"]}
    of = {c: b for b, c in byte_letters().items()}
    ending, inner = set(), set()
    for t in loaded["model"]["vocab"]:
        if t not in special:
            ends = bool(end) and t != end and t.endswith(end)
            (ending if ends else inner).add(bytes(of[c] for c in (t.removesuffix(end) if ends else t)))
    return sorted(ending), sorted(inner)


def normal(text: str) -> str:
    """The tokenizer's form of a text."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Automaton:
    def __init__(self, ending: list[bytes], inner: list[bytes]) -> None:
        every = {bytes([END]) + t[::-1] for t in ending} | {t[::-1] for t in inner}
        every |= {x for b in range(256) for x in (bytes([b]), bytes([END, b]))} - {bytes([END])}
        child: dict[int, int] = {}
        token, edges = [False], []
        for t in sorted(every):
            at = 0
            for b in t:
                if at << 8 | b not in child:
                    child[at << 8 | b] = len(token)
                    edges.append((at, b, len(token)))
                    token.append(False)
                at = child[at << 8 | b]
            token[at] = True
        n = len(token)
        fail, freed, ended = [0] * n, [0] * n, [0] * n
        self.start = child[END]
        # Parents come before their children; nodes with shorter words than theirs are what links lead to.
        depth = [0] * n
        for p, _, v in edges:
            depth[v] = depth[p] + 1
        for p, b, v in sorted(edges, key=lambda e: depth[e[2]]):
            if token[v]:
                freed[v] = 1
            elif p:
                z, pops = fail[p], freed[p]
                while z << 8 | b not in child:
                    z, pops = fail[z], pops + freed[z]
                fail[v], freed[v] = child[z << 8 | b], pops
            ended[v] = freed[v] + (ended[fail[v]] if fail[v] else 0)
        self.fail, self.freed, self.ended = np.array(fail, np.int32), np.array(freed, np.int32), np.array(ended, np.int64)
        e = np.array(edges)
        self.table = PairTable(e[:, 0], e[:, 1], e[:, 2])

    def step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next nodes, pieces popped) for one byte of many words."""
        popped, open_ = np.zeros(len(node), np.int64), np.arange(len(node))
        node = node.copy()
        while True:
            got = self.table.find(node[open_], byte[open_], -1)
            found = got >= 0
            node[open_[found]] = got[found] & 0xFFFFF
            open_ = open_[~found]
            if not len(open_):
                return node, popped
            popped[open_] += self.freed[node[open_]]
            node[open_] = self.fail[node[open_]]

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text (in the tokenizer's form)."""
        words, tokens = [], []
        for raw, start, end, own in split_texts(texts):
            total = np.concatenate([[0], np.cumsum(self.tokens(raw, start, end))])
            cut = np.concatenate([[0], np.cumsum(own)])
            words.append(own)
            tokens.append(total[cut[1:]] - total[cut[:-1]])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *words]), np.concatenate([none, *tokens])

    def tokens(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word raw[start:end]."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        size, last = size[order], end[order] - 1
        node, out = np.full(len(order), self.start, np.int32), np.zeros(len(order), np.int64)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        k = 0
        for n in active.tolist():
            if n <= 4:  # a few very long words: go on with plain integers
                break
            node[:n], popped = self.step(node[:n], raw[last[:n] - k])
            out[:n] += popped
            k += 1
        for i in range(int(active[k]) if k < longest else 0):
            node[i], popped = self._rest(int(node[i]), raw[last[i] - size[i] + 1 : last[i] - k + 1][::-1].tolist())
            out[i] += popped
        out += self.ended[node]
        back = np.empty(len(order), np.int64)
        back[order] = out
        return back

    def _rest(self, v: int, data: list[int]) -> tuple[int, int]:
        known, popped = self._children(), 0
        for b in data:
            while (u := known.get(v << 8 | b)) is None:
                popped, v = popped + int(self.freed[v]), int(self.fail[v])
            v = u
        return v, popped

    def _children(self) -> dict[int, int]:
        """The edges as a dictionary, made for the first very long word."""
        if not hasattr(self, "children"):
            some = self.table.keys >= 0
            keys = self.table.keys[some]
            self.children = dict(zip(((keys >> 20) << 8 | keys & 0xFFFFF).tolist(), (self.table.values[some] & 0xFFFFF).tolist(), strict=True))
        return self.children


@cache
def automaton(path: str) -> Automaton:
    return Automaton(*vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens. One pass, no shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary_path)
        for b in it:
            for lo in range(0, b.num_rows, 1000):
                own = b.slice(lo, 1000)
                words, tokens = machine.count([normal(t).encode() for t in own.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(batches, "doc_id long, n_words long, n_tokens long")
