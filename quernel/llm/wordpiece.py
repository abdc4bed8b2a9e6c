"""Token counts by a linear longest-match automaton (operator 5).

Greedy word pieces take the longest vocabulary entry from the left, again and again. The automaton reads a word
once: it is a trie of the vocabulary whose nodes have a failure link (the node for what is left of the read text
after the pieces that are certain by then) and the number of pieces that following the link pops. So the length in
pieces comes out in linear time without a piece being built. Distinct new words of a batch walk the automaton side
by side, a byte at a time; words seen before come from a bounded cache of the task.

A word is ``[^\\x20\\x09-\\x0D]+`` of the text, read with the vocabulary's word mark before it. A word that some
byte keeps from being cut into entries is one unknown piece.

Edge cases: null and empty texts have no words and no pieces; repeated rows give repeated counts; very long words
take as many steps as bytes; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import WordCache, chunks, give_back, space_words, text_buffer
from .bpe import byte_symbols


class LongestMatch:
    """Counts greedy pieces of words that start with ``mark``."""

    def __init__(self, entries: list[bytes], mark: bytes = b" ") -> None:
        self.mark = mark
        children: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        for entry in entries:
            node = 0
            for b in entry:
                if (to := children[node].get(b)) is None:
                    to = children[node][b] = len(children)
                    children.append({})
                    final.append(False)
                node = to
            final[node] = bool(entry)
        n = len(children)
        fail, pops = [-1] * n, [0] * n
        queue = [0]
        for u in queue:
            for b, v in children[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], pops[v] = 0, 1
                elif u:
                    z, count = fail[u], pops[u]
                    while z >= 0 and b not in children[z]:
                        z, count = fail[z], count + pops[z]
                    if z >= 0:
                        fail[v], pops[v] = children[z][b], count
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        keys = np.array([u << 8 | b for u, own in enumerate(children) for b in own], np.uint64)
        nodes = np.array([v for own in children for v in own.values()], np.int32)
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.nodes = np.full(1 << self.bits, -1, np.int32)
        for key, at, node in zip(keys, self._slot(keys), nodes, strict=True):
            while self.nodes[at] >= 0:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.nodes[at] = key, node
        self.cache = WordCache(np.int32)

    def release(self) -> None:
        """At the end of a task: automaton and cache stay, both of bounded size, and what batches took goes."""
        give_back()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        keys = node.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)
        out, todo, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            found = self.keys[at] == keys[todo]
            out[todo[found]] = self.nodes[at[found]]
            go = ~found & (self.nodes[at] >= 0)
            todo, at = todo[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def count_words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word; an uncuttable word counts 1."""
        m = len(starts)
        node, count, bad = np.zeros(m, np.int32), np.zeros(m, np.int64), np.zeros(m, bool)
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still reading stand in front
        size = (ends - starts)[order]
        begin = starts[order]

        def read(own: np.ndarray, byte: np.ndarray) -> None:
            todo = own[~bad[own]]
            byte = byte[~bad[own]]
            while len(todo):
                to = self._child(node[todo], byte)
                node[todo[to >= 0]] = to[to >= 0]
                todo, byte = todo[to < 0], byte[to < 0]
                stuck = self.fail[node[todo]] < 0
                bad[todo[stuck]] = True
                todo, byte = todo[~stuck], byte[~stuck]
                count[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]

        for b in self.mark:
            read(np.arange(m), np.full(m, b, np.uint8))
        for k in range(int(size[0]) if m else 0):
            own = np.arange(int(np.searchsorted(-size, -k, "left")))
            read(own, raw[begin[own] + k])
        todo = np.flatnonzero((node > 0) & ~bad)
        while len(todo):
            stuck = self.fail[node[todo]] < 0
            bad[todo[stuck]] = True
            todo = todo[~stuck]
            count[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[node[todo] > 0]
        out = np.empty(m, np.int64)
        out[order] = np.where(bad, 1, count)
        return out

    def count_texts(self, column: pa.Array):
        """For parts of the column in order: words and pieces of each text."""
        raw, offsets = text_buffer(column)
        for i, j in chunks(offsets):
            own = raw[offsets[i] : offsets[j]]
            starts, ends, before = space_words(own, offsets[i : j + 1] - offsets[i])
            entry = self.cache.lookup(own, starts, ends, lambda new: (np.ones(len(new), np.int64), self.count_words(own, starts[new], ends[new]).astype(np.int32)))  # noqa: B023
            upto = np.append(0, np.cumsum(self.cache.flat[self.cache.starts[entry]].astype(np.int64)))
            yield np.diff(before), np.diff(upto[before])


@functools.cache
def counter(path: str) -> LongestMatch:
    """The entries of a byte-level vocabulary file, as word pieces: a space starts a word."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, special = byte_symbols(), {t["content"] for t in spec["added_tokens"]}
    return LongestMatch([bytes(symbols[c] for c in token) for token in spec["model"]["vocab"] if token not in special and all(c in symbols for c in token)])


def count_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_pieces of every whole text."""

    def run(batches):
        match = counter(path)
        for batch in batches:
            i = 0
            for words, pieces in match.count_texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(words)), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], ["id", "n_words", "n_pieces"])
                i += len(words)
        match.release()

    frame = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, n_words long, n_pieces long").withColumnRenamed("id", id_col)
