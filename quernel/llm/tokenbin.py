"""Token ids in binary shards compressed by Re-Pair grammars (operator 4).

Documents are dealt to shards by ranges of their id and sorted within them; a shard is written as blocks of about
``BLOCK_TOKENS`` ids, each with a grammar of its own. In a block, the most frequent pairs of adjacent ids become
nonterminals, round by round, until no pair occurs ``LEAST_COUNT`` times without overlap: the number of rounds and of
rules has no other bound. Pairs inside the tokenizer's words come first, over the block's distinct words, each counted
as often as it occurs; then all pairs that are left, over the whole block. A pair that occurs often both inside words
and across their ends may so have two rules. No pair crosses the end of a document, so each document is a span of
symbols of its own. The block stores the rules and every rule's expansion length; with those, any span of ids is
expanded without the rest.

Block format (little-endian): ``QRP2``, then unsigned 32-bit: bytes of a symbol (2 or 4), ids that occur, rules,
documents, symbols; then the ids that occur (u32, rising; a symbol below their number stands for one of them, the
others for rules), the rules (two symbols each), their expansion lengths (u32), the symbol at which each document
ends (u32), and the symbols. A row of the shard table holds one block beside its place: shard, block, the
ids before it in its shard, its number of ids, and its documents. The table is Parquet in a folder of Spark's own
writer, so that a retried task leaves no second copy and every file system that Spark reaches will do.

Edge cases: null and empty texts are the end id alone; null doc_ids come first, in blocks like any other; rows of one
id go in the order of a hash of their texts, then of their place in the input, and may share several shards; repeated
rows are written each; a text longer than a block is a block of its own; extra columns are left out; an empty table
makes an empty folder.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._shared import new_folder
from ._words import gather_spans
from .bpe import library_encoder

BLOCK_TOKENS = 1 << 20
END_ID = 2
#: A rule takes two symbols and a length, and saves a symbol at each use: with so many it costs nothing.
LEAST_COUNT = 4
#: A round takes pairs down to this part of the most frequent one's count.
PART = 8
MAGIC = b"QRP2"
_HEAD = struct.Struct("<4s5I")
SCHEMA = "shard int, block int, first_token long, n_tokens long, doc_ids array<bigint>, grammar binary"


def _apart(own: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of rising places of pairs of one id with itself: which overlap one before them, every other one from the left."""
    i = np.arange(len(own))
    start = np.maximum.accumulate(np.where(np.append(True, after[own[:-1]] != own[1:]), i, 0)) if len(own) else i
    return (i - start) % 2 == 1


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at] for places that are all there: without that check, and a wide copy of them, it takes half the time."""
    return values.take(at, mode="clip")


def _sorted_pairs(left: np.ndarray, right: np.ndarray, live: np.ndarray, bits: int, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order (left above right), and their places."""
    pair = left.astype(np.uint64)
    pair <<= np.uint64(bits)
    pair |= right
    if 2 * bits + place <= 64:  # one sort of numbers that hold both
        pair <<= np.uint64(place)
        pair |= live.view(np.uint32)
        pair.sort()
        at = pair.astype(np.uint32)
        at &= np.uint32((1 << place) - 1)
        pair >>= np.uint64(place)
        return pair, at.view(np.int32)
    order = np.argsort(pair, kind="stable")
    return pair[order], live[order]


def _grouped(left: np.ndarray, right: np.ndarray, places: np.ndarray, bits: int, place: int, least: int, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places by their pair, the pairs, how many places each has, and how often they occur; pairs that occur less than ``least`` times go."""
    pair, at = _sorted_pairs(left, right, places, bits, place)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(pair)))
    count = np.add.reduceat(_take(times, at), first, dtype=np.int64) if times is not None and len(pair) else size
    often = count >= least
    return _take(at, np.flatnonzero(np.repeat(often, size))), pair[first[often]], size[often], count[often]


def repair(ids: np.ndarray, ends: np.ndarray, base: int, *, least: int = LEAST_COUNT, part: int = PART, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbol ends of the documents, rules). ends: where each document ends in ids, rising.

    times: for each id, how many times its document is there; without it, once.

    A round takes every pair that occurs at least 1 / ``part`` as often as the most frequent one, and ``least`` times.
    Where chosen pairs overlap, the more frequent one has the place. It ends when no pair occurs ``least`` times.
    A pair of older symbols never gains an occurrence, so places stay grouped by their pair from round to round: those
    that are lost go, and only the pairs beside a new symbol are sorted. Pairs of one id with itself are told apart
    anew in each round, as which of them overlap changes with what is lost.
    """
    n = len(ids)
    bits, place = int(base + (n if times is None else int(times.sum())) // least + 1).bit_length(), max(1, n.bit_length())
    seq = np.append(ids, 0).astype(np.uint32)
    # neighbours within the document; n is none
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends - 1] = before[np.append(0, ends[:-1])] = after[n] = before[n] = n
    rank_at, lost = np.zeros(n + 1, np.uint32), np.zeros(n + 1, bool)
    fresh = np.flatnonzero(after[:n] < n).astype(np.int32)
    own = fresh[:0]  # places of pairs of one id with itself
    at, pairs, size, count = fresh[:0], np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64)  # all others, by their pair
    rules: list[np.ndarray] = []
    made = base
    while True:
        left, right = _take(seq, fresh), _take(seq, _take(after, fresh))
        same = left == right
        if same.any():
            own = np.append(own, fresh[same])
            apart = np.flatnonzero(~same)
            fresh, left, right = (_take(x, apart) for x in (fresh, left, right))
        own.sort()
        odd = _apart(own, after)
        new = _grouped(left, right, fresh, bits, place, least, times)
        at, pairs, size, count = (np.append(x, y) for x, y in zip((at, pairs, size, count), new, strict=True))
        even = own[~odd]
        own_at, own_pairs, own_size, own_count = _grouped(seq[even], seq[even], even, bits, place, least, times)
        own = np.append(own_at, own[odd])
        most = max(count.max(initial=0), own_count.max(initial=0))
        if not most:
            break
        todo, chosen, places_of, often = [], [], [], []
        for places, kinds, places_n, n_of in ((at, pairs, size, count), (own_at, own_pairs, own_size, own_count)):
            pick = n_of >= max(least, int(most) // part)
            todo.append(_take(places, np.flatnonzero(np.repeat(pick, places_n))))
            chosen.append(kinds[pick])
            places_of.append(places_n[pick])
            often.append(n_of[pick])
        todo, chosen, places_of, often = (np.concatenate(x) for x in (todo, chosen, places_of, often))
        order = np.argsort(often, kind="stable")
        rank = np.empty(len(chosen), np.uint32)
        rank[order] = np.arange(1, len(chosen) + 1)
        rank_at[todo] = np.repeat(rank, places_of)
        todo.sort()
        use, rule = [], []
        while len(todo):  # a place goes to its pair if neither neighbour's ranks above; then to the next
            mine, a, b = (_take(x, todo) for x in (rank_at, before, after))
            wins = np.flatnonzero(mine > np.maximum(_take(rank_at, a), _take(rank_at, b)))
            use.append(_take(todo, wins))
            rule.append(order[_take(mine, wins) - 1])
            rank_at[use[-1]] = rank_at[_take(a, wins)] = rank_at[_take(b, wins)] = 0
            todo = _take(todo, np.flatnonzero(_take(rank_at, todo)))
        use, rule = np.concatenate(use), np.concatenate(rule)
        kept = np.bincount(rule, None if times is None else times[use], len(chosen)) >= least  # the most frequent pair always is
        if not kept.all():
            stay = np.flatnonzero(kept[rule])
            use, rule = use[stay], rule[stay]
        chosen = chosen[kept]
        rules.append(np.stack((chosen >> np.uint64(bits), chosen & np.uint64((1 << bits) - 1)), 1).astype(np.uint32))
        seq[use] = (np.cumsum(kept) - 1 + made)[rule]
        made += len(chosen)
        gone = _take(after, use)
        to = _take(after, gone)
        after[use] = to
        before[to] = use
        before[n] = n
        near = _take(before, use)
        lost[use] = lost[gone] = True
        near = _take(near, np.flatnonzero((near < n) & ~_take(lost, near)))
        lost[near] = True
        fresh = np.concatenate((near, _take(use, np.flatnonzero(to < n))))
        own = own[~lost[own]]
        stay = ~_take(lost, at)
        if len(at):
            first = np.cumsum(size) - size
            left_of = np.add.reduceat(stay, first, dtype=np.int64)
            still = left_of if times is None else np.add.reduceat(_take(times, at) * stay, first, dtype=np.int64)
            often = still >= least
            at, pairs, size, count = _take(at, np.flatnonzero(stay & np.repeat(often, size))), pairs[often], left_of[often], still[often]
        lost[use] = lost[near] = False  # what is gone stays lost
    where = np.flatnonzero(~lost[:n])
    return seq[where], np.flatnonzero(after[where] == n) + 1, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _levels(rules: np.ndarray, base: int):
    """Ranges of rules, in order, made of ids and rules of earlier ranges alone: a rule's symbols were there in an earlier round."""
    top = np.maximum(rules[:, 0], rules[:, 1])
    at = 0
    while at < len(rules):
        stop, step = at, 1024
        while stop < len(rules):  # in steps, so that many short ranges don't each read all that is left
            late = np.flatnonzero(top[stop : stop + step] >= base + at)
            if len(late):
                stop += int(late[0])
                break
            stop, step = min(stop + step, len(rules)), 2 * step
        yield at, stop
        at = stop


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule."""
    size = np.ones(base + len(rules), np.int64)
    for a, b in _levels(rules, base):
        size[base + a : base + b] = size[rules[a:b, 0]] + size[rules[a:b, 1]]
    return size[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of a span of symbols."""
    out = symbols.astype(np.int64)
    while len(out) and (out >= base).any():
        big = out >= base
        size = 1 + big
        start = np.cumsum(size) - size
        new = np.empty(int(size.sum()), np.int64)
        new[start[~big]] = out[~big]
        new[start[big]], new[start[big] + 1] = rules[out[big] - base].T
        out = new
    return out.astype(np.uint32)


def _repair_by_word(ids: np.ndarray, ends: np.ndarray, base: int, number: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``repair``, with the pairs inside words first. number, size: as in ``pack_block``."""
    number = np.maximum(number - number.min(where=number >= 0, initial=number.max()) + 1, 0)
    one = np.empty(int(number.max()) + 1, np.int64)
    one[number] = np.arange(len(number))
    own = np.flatnonzero(one[number] == np.arange(len(number)))  # a word of each number
    one[number[own]] = np.arange(len(own))
    kind = one[number]
    at = np.cumsum(size)
    words = gather_spans(ids, at[own] - size[own], size[own])
    symbols, stop, inner = repair(words, np.cumsum(size[own]), base, times=np.repeat(np.bincount(kind).astype(np.int32), size[own]))
    n_symbols = np.diff(stop, prepend=0)
    upto = np.cumsum(n_symbols[kind])
    spans = gather_spans(symbols, (stop - n_symbols)[kind], n_symbols[kind])
    symbols, stop, outer = repair(spans, upto[np.searchsorted(at, ends)], base + len(inner))
    return symbols, stop, np.concatenate((inner, outer))


def pack_block(ids: np.ndarray, ends: np.ndarray, n_ids: int, words: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
    """ids: below n_ids. Those that occur are numbered anew, so that symbols stay short.

    words: a number from -1 and the count of ids, 1 at least, of each word; words of one number are alike, and none
    reaches over a document's end. Without it, all pairs come at once.
    """
    there = np.zeros(n_ids, bool)
    there[ids] = True
    alphabet = np.flatnonzero(there)
    base = len(alphabet)
    number = np.cumsum(there, dtype=np.uint32) - np.uint32(1)
    symbols, at, rules = repair(number[ids], ends, base) if words is None else _repair_by_word(number[ids], ends, base, *words)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = _HEAD.pack(MAGIC, width, base, len(rules), len(ends), len(symbols))
    return b"".join((head, alphabet.astype("<u4").tobytes(), rules.astype(kind).tobytes(), lengths_of(rules, base).astype("<u4").tobytes(), at.astype("<u4").tobytes(), symbols.astype(kind).tobytes()))


class Block:
    """A block's parts, as views of its bytes."""

    def __init__(self, data: bytes) -> None:
        magic, width, self.base, n_rules, n_docs, n_symbols = _HEAD.unpack_from(data) if len(data) >= _HEAD.size else (b"", *[0] * 5)
        if magic != MAGIC or width not in (2, 4) or len(data) != _HEAD.size + 4 * (self.base + n_rules + n_docs) + width * (2 * n_rules + n_symbols):
            raise ValueError("not a whole block of token ids")
        at = _HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.alphabet = part("<u4", self.base)
        self.rules = part(f"<u{width}", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths, self.ends, self.symbols = part("<u4", n_rules), part("<u4", n_docs), part(f"<u{width}", n_symbols)

    def sizes(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Number of ids of the symbols a to b."""
        own = self.symbols[a:b]
        out = np.ones(len(own), np.int64)
        big = own >= self.base
        out[big] = self.lengths[own[big].astype(np.int64) - self.base]
        return out

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the block's document k; only the symbols that they lie in are expanded."""
        a, b = (int(self.ends[k - 1]) if k else 0), int(self.ends[k])
        own = self.symbols[a:b]
        upto = np.cumsum(self.sizes(a, b))
        stop = int(upto[-1]) if stop is None else min(stop, int(upto[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        i, j = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, stop, "left")) + 1
        skip = start - (int(upto[i - 1]) if i else 0)
        return self.alphabet[expand(own[i:j], self.rules, self.base)[skip : skip + stop - start]]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document's end: every rule is expanded once."""
        sizes = self.sizes()
        # ids stand for themselves; the expansion of a rule follows those of the rules before it, and is made of two of them
        long = np.append(np.ones(self.base, np.int64), self.lengths)
        starts = np.cumsum(long) - long
        flat = np.empty(int(long.sum()), np.uint32)
        flat[: self.base] = self.alphabet
        for a, b in _levels(self.rules, self.base):
            two = self.rules[a:b].ravel()
            first = starts[self.base + a]
            part = gather_spans(flat, starts[two], long[two])
            flat[first : first + len(part)] = part
        return gather_spans(flat, starts[self.symbols], sizes), np.append(0, np.cumsum(sizes))[self.ends]


def write_shards(docs: DataFrame, path: str, folder: str, *, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes all texts and writes the shard table to the folder."""
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    tail_word = np.array([-1]), np.array([1])  # a word of its own

    def run(batches):
        bpe, shard, block, before = library_encoder(path), TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        sizes: list[int] = []
        n = 0

        def flush():
            nonlocal block, before, n
            data = pack_block(np.concatenate(held), np.cumsum(sizes), bpe.n_ids, (np.concatenate(numbers), np.concatenate(lengths)))
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            block, before, n = block + 1, before + n, 0
            for x in (names, held, numbers, lengths, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays(row, ["shard", "block", "first_token", "n_tokens", "doc_ids", "grammar"])

        for batch in batches:
            ids_of, i = batch.column(0).to_pylist(), 0
            for ids, offsets, number, length, at in bpe.encode_by_word(batch.column(1)):
                for a, b, c, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if n and n + b - a + len(tail) > block_tokens:
                        yield flush()
                    held.extend((ids[a:b], tail))
                    numbers.extend((number[c:d], tail_word[0]))
                    lengths.extend((length[c:d], tail_word[1]))
                    sizes.append(b - a + len(tail))
                    names.append(ids_of[i])
                    n += sizes[-1]
                    i += 1
        if names:
            yield flush()
        bpe.release()

    if end_id is None:
        raise ValueError("a document without ids has no place in a block: an end id is needed")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # rows of one id, which may be many, are told apart by a hash and then by their place
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place").select("doc_id", "text")
    rows.mapInArrow(run, SCHEMA).write.parquet(folder)


def _per_document(blocks: DataFrame, schema: str, make):
    """make(row of the block, Block) -> a RecordBatch with a row for each document."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                yield make(row, Block(row["grammar"].as_py()))

    return blocks.mapInArrow(run, schema)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of all documents of the shards."""

    def make(row, block):
        ids, ends = block.ids()
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([row["doc_ids"].values, lists], ["doc_id", "ids"])

    return _per_document(spark.read.schema(SCHEMA).parquet(folder).select("doc_ids", "grammar"), "doc_id long, ids array<int>", make)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    # a row for each shard, and shards are tasks of the writer
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    blocks = blocks.join(F.broadcast(shards), "shard").withColumn("first", F.col("base") + F.col("first_token"))

    def make(row, block):
        ids, ends = block.ids()
        starts = np.append(0, ends[:-1])
        data = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(row["first"].as_py() + starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _per_document(blocks.select("first", "doc_ids", "grammar"), "doc_id long, start long, n_tokens long, ids_crc32 long", make)


def roundtrip(docs: DataFrame, path: str) -> DataFrame:
    folder = new_folder(docs.sparkSession, "token-shards")
    write_shards(docs, path, folder)
    return read_digests(docs.sparkSession, folder)


__all__ = ["Block", "expand", "pack_block", "read_digests", "read_ids", "repair", "roundtrip", "write_shards"]
