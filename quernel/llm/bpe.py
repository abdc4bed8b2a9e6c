"""BPE encoding and decoding by contiguous rank arrays (operator 3).

A short word is two rows of a matrix: the ids between its part boundaries, and the ranks of adjacent ids. All
distinct new words of a batch are worked on together: find each row's smallest rank (the leftmost, on a tie),
delete that boundary, and refresh the ranks on either side, until no row has a rank left. Words of over
``LONG_WORD`` bytes use a heap over a linked list, which is not quadratic. Words seen before come from a bounded
cache that a task keeps.

Texts are cut into words by the byte-level pattern of the vocabulary file; the file's special tokens are split out
first, as its own library does. The ids equal those of the ``tokenizers`` library; tests hold them against it.

Edge cases: null and empty texts give no ids and an empty text; repeated rows give repeated results; every other
column of the input is left alone by the query.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._words import CHUNK_BYTES, WordCache, chunks, gather_spans, give_back, text_buffer

LONG_WORD = 48
#: Words that the library encodes at once.
BLOCK_WORDS = 4096
NONE = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@functools.cache
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, of every code point."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    """Encoder and decoder for one byte-level vocabulary file in the ``tokenizers`` format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.n_ids = 1 + max([*vocab.values(), *self.special.values()])
        token_bytes = [b""] * self.n_ids
        for token, i in vocab.items():
            token_bytes[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        for content, i in self.special.items():
            token_bytes[i] = content
        self.token_bytes = token_bytes
        self.token_lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in symbols.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.uint64) for k in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pair_rank = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(zip(left, right, merged, strict=True))}
        self._table(left << np.uint64(32) | right, merged)
        self.cache = WordCache(np.uint32)

    def _table(self, keys: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1) * 5))))
        size = 1 << self.bits
        self.slot_key = np.full(size, np.uint64(2**64 - 1))
        self.slot_rank = np.full(size, NONE, np.int32)
        self.slot_id = np.zeros(size, np.int32)
        for rank, (key, at, new) in enumerate(zip(keys, self._slot(keys), merged, strict=True)):
            while self.slot_key[at] != np.uint64(2**64 - 1):
                at = (at + 1) & (size - 1)
            self.slot_key[at], self.slot_rank[at], self.slot_id[at] = key, rank, new

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of adjacent ids; no rank where either is negative."""
        keys = a.astype(np.uint64) << np.uint64(32) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        rank, new = np.full(len(keys), NONE, np.int32), np.zeros(len(keys), np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        at = at[todo]
        while len(todo):
            key = self.slot_key[at]
            hit = key == keys[todo]
            rank[todo[hit]], new[todo[hit]] = self.slot_rank[at[hit]], self.slot_id[at[hit]]
            go = ~hit & (key != np.uint64(2**64 - 1))
            todo, at = todo[go], (at[go] + 1) & (len(self.slot_key) - 1)
        return rank, new

    def _merge_short(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: a row of bytes for each word, padded to the right. Returns (ids, how many of each row)."""
        m, width = words.shape
        cols = np.arange(width)
        ids = np.where(cols < lengths[:, None], self.byte_ids[words], -1).astype(np.int32)
        left = lengths.astype(np.int64).copy()
        if width < 2:
            return ids, left
        rank, new = (x.reshape(m, width - 1) for x in self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        out, live = ids.copy(), np.arange(m)
        while len(live):
            k = len(live)
            row = np.arange(k)
            best = rank.argmin(axis=1)
            go = rank[row, best] != NONE
            if not go.all():
                out[live[~go], : ids.shape[1]] = ids[~go]
                live, ids, rank, new, best = live[go], ids[go], rank[go], new[go], best[go]
                k = len(live)
                row = np.arange(k)
                if not k:
                    break
            ids[row, best] = new[row, best]
            left[live] -= 1
            # the boundary after `best` goes: what stands to the right moves up by one
            w = ids.shape[1]
            move = np.arange(w - 1)
            move = move + (move > best[:, None])
            tail = np.full((k, 1), -1, np.int32)
            ids = np.hstack((np.take_along_axis(ids, move, 1), tail))
            if w > 2:
                move = np.arange(w - 2)
                move = move + (move >= best[:, None])
                rank = np.hstack((np.take_along_axis(rank, move, 1), np.full((k, 1), NONE, np.int32)))
                new = np.hstack((np.take_along_axis(new, move, 1), np.zeros((k, 1), np.int32)))
            else:
                rank[:] = NONE
            before, after = np.maximum(best - 1, 0), np.minimum(best + 1, w - 1)
            r, c = self._ranks(np.concatenate((ids[row, before], ids[row, best])), np.concatenate((ids[row, best], ids[row, after])))
            r[:k][best == 0] = NONE
            has = np.flatnonzero(best > 0)
            rank[has, best[has] - 1], new[has, best[has] - 1] = r[:k][has], c[:k][has]
            has = np.flatnonzero(best < w - 1)
            rank[has, best[has]], new[has, best[has]] = r[k:][has], c[k:][has]
            most = int(left[live].max())
            if most < ids.shape[1]:
                if most < 2:
                    out[live, :most] = ids[:, :most]
                    break
                ids, rank, new = ids[:, :most], rank[:, : most - 1], new[:, : most - 1]
        return out, left

    def _merge_long(self, word: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.pair_rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := self.pair_rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [i for i in ids if i >= 0]

    def encode_words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids. Each word stands for itself: nothing is cached here."""
        lengths = ends - starts
        n_ids = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in ((1, 8), (9, 12), (13, 20), (21, LONG_WORD)):
            pick = np.flatnonzero((lengths >= low) & (lengths <= high))
            for at in range(0, len(pick), 1 << 15):
                own = pick[at : at + (1 << 15)]
                width = int(lengths[own].max())
                where = np.minimum(starts[own][:, None] + np.arange(width), len(raw) - 1)
                ids, left = self._merge_short(raw[where], lengths[own])
                n_ids[own] = left
                found.append((own, left, ids[np.arange(width) < left[:, None]]))
        for i in np.flatnonzero(lengths > LONG_WORD):
            ids = np.array(self._merge_long(raw[starts[i] : ends[i]].tobytes()), np.int64)
            n_ids[i] = len(ids)
            found.append((np.array([i]), n_ids[i : i + 1], ids))
        flat = np.zeros(int(n_ids.sum()), np.uint32)
        place = np.cumsum(n_ids) - n_ids
        for own, left, ids in found:
            index = np.arange(len(ids)) + np.repeat(place[own] - (np.cumsum(left) - left), left)
            flat[index] = ids
        return n_ids, flat

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of the words of every text, and which of them are special tokens (their ids, else -1)."""
        data = raw.tobytes()
        chars = np.frombuffer(data.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        cuts, special = offsets[:-1], {}
        if self.special_at is not None and any(s in data for s in self.special):
            for i in range(len(offsets) - 1):
                for m in self.special_at.finditer(data, int(offsets[i]), int(offsets[i + 1])):
                    special[m.start()] = self.special[m[0]]
                    cuts = np.append(cuts, (m.start(), m.end()))
            cuts = np.unique(cuts)
        cuts = np.unique(np.searchsorted(lead, cuts[cuts < len(raw)]))
        n = len(chars)
        kind = char_classes()[chars]
        edge = np.zeros(n + 1, bool)
        edge[cuts] = edge[n] = True
        first = edge[:-1].copy()
        first[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(first)
        to = np.append(at[1:], n)
        start = np.zeros(n + 2, bool)
        start[at] = True
        blank = (kind[at] == SPACE) & ~edge[to]
        run_at, run_to = at[blank], to[blank]
        start[run_to[run_to - run_at > 1] - 1] = True
        start[run_to[chars[run_to - 1] == 32]] = False
        one = np.flatnonzero((chars[at] == 39) & (to - at == 1) & ~edge[to] & start[at])
        one = one[kind[to[one]] == LETTER] if len(one) else one
        if len(one):
            p, size = to[one], to[one + 1] - to[one]
            c1, c2 = chars[p], chars[np.minimum(p + 1, n - 1)]
            take = np.where(np.isin(c1, [ord(c) for c in "stmd"]), 1, 0)
            pair = ((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)
            take = np.where(pair & (size > 1), 2, take)
            p, size, take = p[take > 0], size[take > 0], take[take > 0]
            start[p] = False
            start[(p + take)[size > take]] = True
        begin = lead[np.flatnonzero(start[:n])]
        ids = np.full(len(begin), -1, np.int64)
        if special:
            pos = np.array(sorted(special))
            where = np.searchsorted(begin, pos)
            ids[where] = [special[p] for p in pos]
            ends = np.append(begin[1:], len(raw))
            tail = np.array([len(self.token_bytes[special[p]]) for p in pos]) + pos
            keep = np.ones(len(begin), bool)  # what pattern words lie inside a special token go
            for a, b in zip(pos, tail, strict=True):
                keep[np.searchsorted(begin, a) + 1 : np.searchsorted(begin, b)] = False
            del ends
            begin, ids = begin[keep], ids[keep]
        return begin, ids

    def _encode_buffer(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """All ids and each text's offsets in them, then the number and the ids of every word, and each text's offsets in those."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        starts, special = self.spans(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        apart = {int(i): int(special[i]) for i in np.flatnonzero(special >= 0)}

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if apart and any(i in apart for i in new.tolist()):  # special tokens come together with long words
                parts = [np.array([apart[i]], np.uint32) if i in apart else self.encode_words(raw, starts[i : i + 1], ends[i : i + 1])[1] for i in new.tolist()]
                return np.array([len(x) for x in parts]), np.concatenate(parts)
            return self.encode_words(raw, starts[new], ends[new])

        entry = self.cache.lookup(raw, starts, ends, make, apart)
        n_ids = self.cache.lengths[entry].astype(np.int64)
        ids = gather_spans(self.cache.flat, self.cache.starts[entry], n_ids)
        upto = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(n_ids, out=upto[1:])
        at = np.searchsorted(starts, offsets)
        return ids, upto[at], entry + self.cache.before, n_ids, at

    def encode(self, column: pa.Array | pa.ChunkedArray):
        """For parts of the column in order: the ids of all their texts as one array, and each text's offsets."""
        for ids, offsets, *_ in self.encode_by_word(column):
            yield ids, offsets

    def encode_by_word(self, column: pa.Array | pa.ChunkedArray):
        """The same, then a number for each word (words of one number have the same ids), how many ids it has, and each text's offsets in the words."""
        raw, offsets = text_buffer(column)
        for i, j in chunks(offsets):
            own = offsets[i : j + 1] - offsets[i]
            text = raw[offsets[i] : offsets[j]]
            if j - i == 1 and len(text) > 2 * CHUNK_BYTES:
                parts = [self._encode_buffer(x, np.array([0, len(x)])) for x in self._pieces(text)]
                ids, number, size = (np.concatenate([x[k] for x in parts]) for k in (0, 2, 3))
                yield ids, np.array([0, len(ids)]), number, size, np.array([0, len(size)])
            else:
                yield self._encode_buffer(text, own)

    def _pieces(self, text: np.ndarray):
        """A very long text, cut where a word ends whatever surrounds it: between a letter and a space."""
        data, at = text.tobytes(), 0
        cut = re.compile(rb"[A-Za-z](?= [A-Za-z])")
        while at < len(data):
            m = cut.search(data, at + CHUNK_BYTES) if at + CHUNK_BYTES < len(data) else None
            to = m.end() if m else len(data)
            yield text[at:to]
            at = to

    def release(self) -> None:
        """At the end of a task: vocabulary and cache stay, both of bounded size, and what batches took goes."""
        give_back()

    def decode(self, ids: np.ndarray) -> bytes:
        return gather_spans(self.token_flat, self.token_starts[ids], self.token_lengths[ids]).tobytes()


@functools.cache
def encoder(path: str) -> RankArrayBPE:
    """One per worker process and vocabulary."""
    return RankArrayBPE(path)


class LibraryBPE(RankArrayBPE):
    """Cuts and caches words as above, but every distinct word is encoded by the ``tokenizers`` library.

    A word of the pattern, encoded alone, gives the ids that it gives within its text; so whole texts get the
    library's ids at the cost of their distinct words. Those come to the library in the vocabulary's own symbols for
    bytes, a space between words (none of the symbols is one), which is where it cuts instead of by the pattern.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer(Tokenizer.from_file(path).model)  # special tokens never come here
        self.library.model._resize_cache(0)  # no word comes twice
        self.library.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.symbol = np.zeros(256, np.uint32)
        for c, b in byte_symbols().items():
            self.symbol[b] = ord(c)

    def encode_words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found: list[np.ndarray] = []
        n_ids = np.zeros(len(starts), np.int64)
        for at in range(0, len(starts), BLOCK_WORDS):  # an encoding of the library is far larger than its ids
            own = slice(at, at + BLOCK_WORDS)
            size = ends[own] - starts[own]
            stop = np.cumsum(size)
            text = np.full(int(stop[-1]) + len(size), 32, np.uint32)
            text[np.arange(stop[-1]) + np.repeat(np.arange(len(size)), size)] = self.symbol[gather_spans(raw, starts[own], size)]
            (one,) = self.library.encode_batch_fast([text.tobytes().decode("utf-32-le")], add_special_tokens=False)
            ids = np.array(one.ids, np.uint32)
            upto = np.cumsum(self.token_lengths[ids])  # where each id ends, in bytes
            last = np.searchsorted(upto, stop)
            if last[-1] != len(ids) - 1 or (upto[last] != stop).any():
                raise ValueError("the library's ids don't stand for the bytes of the words")
            n_ids[own] = np.diff(last, prepend=-1)
            found.append(ids)
        return n_ids, np.concatenate(found) if found else np.zeros(0, np.uint32)


@functools.cache
def library_encoder(path: str) -> LibraryBPE:
    return LibraryBPE(path)


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every whole text."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            i = 0
            for ids, offsets in bpe.encode(batch.column(1)):
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), lists], ["id", "ids"])
                i += n
        bpe.release()

    frame = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of every id list; null lists give an empty text."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    frame = rows.select(rows[id_col].alias("id"), rows[ids_col].alias("ids"))
    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def roundtrip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text, then decodes its ids."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            i = 0
            for ids, offsets in bpe.encode(batch.column(1)):
                n = len(offsets) - 1
                wide = ids.astype("<u4").tobytes()
                text = bpe.decode(ids)
                upto = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(bpe.token_lengths[ids], out=upto[1:])
                at = upto[offsets]
                a = [hashlib.sha256(wide[4 * x : 4 * y]).hexdigest() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                # the library replaces broken UTF-8; ids of a whole text give whole characters
                b = [hashlib.sha256(text[x:y].decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
                cols = [batch.column(0).slice(i, n), pa.array(np.diff(offsets)), pa.array(a, pa.string()), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                i += n
        bpe.release()

    frame = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
