"""Vectorised word spans and word caches shared by the text operators.

Everything here works on one UTF-8 byte buffer that holds many texts end to end, so that a step costs a few
numpy passes over the buffer instead of a Python loop over words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Texts are worked on in buffers of about so many bytes.
CHUNK_BYTES = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system where the C library can: workers stay for later tasks and other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the int64 offsets of each (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of texts of about ``limit`` bytes together; one text longer than that stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: mask[n] keeps the n lowest bytes of a 64-bit number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SHORT_WORD = 15


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two numbers for each word of up to ``SHORT_WORD`` bytes: its bytes, with its length on top, so no two share them."""
    padded = np.concatenate((raw, np.zeros(24, np.uint8)))
    eight = np.ndarray((len(raw) + 16,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = np.empty((len(starts), 2), np.uint64)
    out[:, 0] = eight[starts] & _LOW[np.minimum(size, 8)]
    out[:, 1] = eight[starts + 8] & _LOW[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    return out


def gather_spans(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[0]:starts[0]+lengths[0]], then the next span, and so on, as one array."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return values[index]


class WordCache:
    """Word -> span of a flat value array; kept by a worker from batch to batch and from task to task.

    Words are told apart by all of their bytes: short ones by their two numbers in a hash table, longer ones by a
    dictionary. At ``limit`` words, or as many bytes of longer ones as ``LONG_BYTES``, words that no later buffer had
    go, or all where more than half of that would stay; so its memory is bounded, and no result depends on it.
    """

    LONG_BYTES = 1 << 22

    def __init__(self, dtype, limit: int = 500_000) -> None:
        self.dtype, self.limit = dtype, limit
        self.n = self.before = 0
        self.clear()

    def clear(self) -> None:
        self.before += self.n  # entries that there were ever: an entry's number is its own with this added
        self._table(1 << 14)
        self.keys = np.zeros((0, 2), np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.again = np.zeros(1, bool)  # what later buffers had; the last one is of words that aren't there
        self.flat = np.zeros(0, self.dtype)
        self.others: dict[bytes | int, int] = {}
        self.n = self.used = self.long_bytes = 0

    def _drop(self) -> None:
        """Makes room: what was looked up again stays."""
        stay = np.flatnonzero(self.again[: self.n])
        number = np.full(self.n, -1)
        number[stay] = np.arange(len(stay))
        others = {x: int(number[i]) for x, i in self.others.items() if number[i] >= 0}
        long_bytes = sum(len(x) for x in others if isinstance(x, bytes))
        keys, lengths = self.keys[stay], self.lengths[stay]
        flat = gather_spans(self.flat, self.starts[stay], lengths)
        self.clear()
        if 2 * len(stay) > self.limit or 2 * long_bytes > self.LONG_BYTES:
            return
        self._add(lengths, flat)
        self.keys[: self.n] = keys
        self.others, self.long_bytes = others, long_bytes
        self._fill()

    def _table(self, size: int) -> None:
        self.slot_key = np.zeros((size, 2), np.uint64)
        self.slot_entry = np.full(size, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ h >> np.uint64(32)) & np.uint64(len(self.slot_entry) - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        at = self._slot(keys)
        out = self.slot_entry[at]
        at_key = self.slot_key.take(at, axis=0)
        other = np.flatnonzero((out >= 0) & ((at_key[:, 0] != keys[:, 0]) | (at_key[:, 1] != keys[:, 1])))
        mask, todo = len(self.slot_entry) - 1, other
        at = at[other]
        while len(todo):
            at = (at + 1) & mask
            entry = self.slot_entry[at]
            same = (self.slot_key.take(at, axis=0) == keys.take(todo, axis=0)).all(axis=1)
            out[todo] = np.where(same, entry, -1)
            go = (entry >= 0) & ~same
            todo, at = todo[go], at[go]
        return out

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Keys that differ from each other and from all that are there."""
        mask = len(self.slot_entry) - 1
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slot_entry[at] < 0
            self.slot_entry[at[free]] = entries[todo[free]]  # of several, the last stays
            placed = free & (self.slot_entry[at] == entries[todo])
            self.slot_key[at[placed]] = keys[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & mask

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros((max(need, len(a) * 3 // 2, 1024), *a.shape[1:]), a.dtype)
        out[: len(a)] = a
        return out

    def _add(self, lengths: np.ndarray, flat: np.ndarray, keys: np.ndarray | None = None) -> int:
        """The first of the new entries, which are numbered on. keys: of short words, else another table has them."""
        n, m, used = self.n, len(lengths), self.used
        self.keys, self.starts, self.lengths = (self._room(a, n + m) for a in (self.keys, self.starts, self.lengths))
        self.again = self._room(self.again, n + m + 1)
        self.again[n:] = False
        self.flat = self._room(self.flat, used + len(flat))
        self.lengths[n : n + m] = lengths
        self.starts[n : n + m] = used + np.cumsum(lengths) - lengths
        self.flat[used : used + len(flat)] = flat
        self.keys[n : n + m] = 0 if keys is None else keys
        self.n, self.used = n + m, used + len(flat)
        if keys is not None:
            if self.n * 2 > len(self.slot_entry):
                self._fill()
            else:
                self._insert(keys, np.arange(n, n + m, dtype=np.int32))
        return n

    def _fill(self) -> None:
        """A table of all short words that are there, at most half full."""
        size = len(self.slot_entry)
        while self.n * 2 > size:
            size *= 2
        self._table(size)
        short = np.flatnonzero(self.keys[: self.n, 1])  # a short word has a length there
        self._insert(self.keys[short], short.astype(np.int32))

    def _by_name(self, names: list, make) -> np.ndarray:
        """Entries by anything hashable."""
        found = np.array([self.others.get(x, -1) for x in names], np.int64)
        self.again[found] = True
        missing = np.flatnonzero(found < 0)
        if len(missing):
            first: dict = {}
            for i in missing.tolist():
                first.setdefault(names[i], i)
            base = self._add(*make(np.array(list(first.values()))))
            self.others.update(zip(first, range(base, self.n), strict=True))
            self.long_bytes += sum(len(x) for x in first if isinstance(x, bytes))
            found[missing] = [self.others[names[i]] for i in missing.tolist()]
        return found

    def lookup(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, make, apart: dict[int, int] | None = None) -> np.ndarray:
        """The entry of each word. make(positions) -> (lengths, flat values) of words that are new.

        apart: number of some positions, which are told apart from words and by that number alone.
        """
        if self.n > self.limit or self.long_bytes > self.LONG_BYTES:
            self._drop()
        size = ends - starts
        long = size > SHORT_WORD
        if apart:
            long[list(apart)] = True
        out = np.empty(len(starts), np.int64)
        rest = np.flatnonzero(long)
        own = np.flatnonzero(~long) if len(rest) else np.arange(len(starts))
        if len(own):
            keys = word_keys(raw, starts[own], ends[own])
            entry = self._find(keys).astype(np.int64)
            self.again[entry] = True
            todo = np.flatnonzero(entry < 0)
            while len(todo):
                _, first, inverse = np.unique(keys[todo, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[todo, 1], return_index=True, return_inverse=True)
                new = todo[first]
                same = (keys.take(new[inverse], axis=0) == keys.take(todo, axis=0)).all(axis=1)  # else two words share that number: the other waits
                base = self._add(*make(own[new]), keys[new])
                entry[todo[same]] = base + inverse[same]
                todo = todo[~same]
                if len(todo):
                    found = self._find(keys[todo])
                    entry[todo] = found
                    todo = todo[found < 0]
            out[own] = entry
        if len(rest):
            names = [apart[i] if apart and i in apart else raw[a:b].tobytes() for i, a, b in zip(rest.tolist(), starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            out[rest] = self._by_name(names, lambda new: make(rest[new]))
        return out


def space_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words ``[^\\x20\\x09-\\x0D]+`` of each text: starts, ends, and how many lie before each text."""
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True  # a word ends with its text
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1])) if len(raw) else np.zeros(0, np.int64)
    after = np.zeros(len(raw), bool)
    after[:-1] = word[1:]
    last = np.zeros(len(raw) + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(word & (~after | last[1:])) + 1 if len(raw) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)
