"""Best-fit packing by linear grouping (operator 7).

Documents longer than a sequence are cut into full pieces, the first of which may be shorter. Full pieces are
sequences of their own; the rest are packed from the histogram of their lengths, which has ``capacity - 1`` numbers
however many documents there are, so the plan is made on the driver in bounded memory:

1. large lengths, sorted downwards, are dealt into groups of equal cardinality and rounded up to a group's largest;
2. configurations of the few rounded sizes are optimised by column generation over the linear relaxation (a knapsack
   prices new configurations); its rounded-down solution is taken, and what remains is filled by the same knapsack;
3. actual lengths take the places of their group, in order, which leaves at least the planned room;
4. small ones go best-fit, longest first, into the room that is left, many equal bins at a time.

A plan is a list of runs: ``bins`` equal sequences, and for each place a length and the first rank of that length
that goes there. The documents find their places by rank: the task that cuts a piece numbers it within its part and
length, and the counts of the parts before are added, so pieces are neither sorted nor shuffled by length, and a
length that a third of all rows share costs no task more than another. The counts (parts times lengths, of which
there are ``capacity``) are broadcast up to ``MOST_BROADCAST`` rows and joined by a shuffle beyond.

Edge cases: a null or empty text still has its end id, so it is a piece of length 1; repeated rows are packed as
often as they come; an empty table gives no rows; further columns of the input are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import new_folder
from .bpe import library_encoder

CAPACITY = 1024
END_ID = 2
#: Counts of (part, length) are broadcast up to so many rows, of 24 bytes each.
MOST_BROADCAST = 1 << 19
#: (groups, p): lengths of at least capacity / p are large; the plan with fewer sequences is taken.
SHAPES = ((48, 2), (96, 3))


def _knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value within capacity, of at most ``most`` of each size, and how many of each."""
    best = np.zeros(capacity + 1)
    taken = []
    for s, v, m in zip(sizes.tolist(), values.tolist(), most.tolist(), strict=True):
        take = np.zeros(capacity + 1, np.int64)
        if v > 1e-12:
            base = best.copy()
            for k in range(1, min(m, capacity // s) + 1):
                new = np.full(capacity + 1, -1.0)
                new[k * s :] = base[: capacity + 1 - k * s] + k * v
                up = new > best + 1e-12
                best[up], take[up] = new[up], k
        taken.append(take)
    room, counts = int(best.argmax()), np.zeros(len(sizes), np.int64)
    value = float(best[room])
    for i in range(len(sizes) - 1, -1, -1):
        counts[i] = taken[i][room]
        room -= int(counts[i]) * int(sizes[i])
    return value, counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how often) that meets the demand exactly or more, in as few bins as it finds."""
    k = len(sizes)
    if not k:
        return []
    fits = np.minimum(capacity // sizes, 1 << 20)
    basis = np.diag(fits).astype(float)
    x = demand / fits
    for _ in range(40 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, new = _knapsack(sizes, prices, fits, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, new.astype(float))
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = new
        x = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    plan = [(basis[:, i].round().astype(np.int64), int(np.floor(x[i] + 1e-9))) for i in range(k)]
    plan = [(c, m) for c, m in plan if m and c.any()]
    left = demand.astype(np.int64) - sum((c * m for c, m in plan), np.zeros(k, np.int64))
    while (left > 0).any():
        first = int(np.flatnonzero(left > 0)[0])  # sizes fall: the largest must go somewhere
        most = np.minimum(np.maximum(left, 0), fits)
        most[first] -= 1
        _, c = _knapsack(sizes, sizes.astype(float), most, capacity - int(sizes[first]))
        c[first] += 1
        m = int(min(left[i] // c[i] for i in np.flatnonzero(c)))
        plan.append((c, max(m, 1)))
        left -= c * max(m, 1)
    return plan


def _grouped(counts: np.ndarray, lengths: list[int], groups: int) -> list[list[list[int]]]:
    """The pieces of these lengths (falling), dealt in order into groups of equal cardinality: [length, how many]."""
    total = int(sum(counts[n] for n in lengths))
    size = max(1, -(-total // groups))
    out: list[list[list[int]]] = [[]]
    room = size
    for n in lengths:
        left = int(counts[n])
        while left:
            if not room:
                out.append([])
                room = size
            m = min(left, room)
            out[-1].append([n, m])
            left, room = left - m, room - m
    return [g for g in out if g]


def _substitute(queues: list[list[list[int]]], config: np.ndarray, times: int, ranks: np.ndarray):
    """Runs in which the actual lengths of each group take the places of a configuration."""
    own = np.flatnonzero(config)
    while times:
        heads = times
        for j in own:
            if queues[j]:
                heads = min(heads, max(1, queues[j][0][1] // int(config[j])))
        places = []
        for j in own:
            for _ in range(int(config[j])):
                if queues[j]:
                    entry = queues[j][0]
                    places.append((entry[0], int(ranks[entry[0]])))
                    ranks[entry[0]] += heads
                    entry[1] -= heads
                    if not entry[1]:
                        queues[j].pop(0)
        if not places:
            return
        yield int(heads), places
        times -= heads


Runs = list[tuple[int, list[tuple[int, int]]]]


def plan_by(histogram: np.ndarray, capacity: int, groups: int, large_part: int) -> Runs:
    """One plan; with 0 groups, for comparison, all lengths go best-fit."""
    counts = histogram.astype(np.int64)
    limit = max(2, -(-capacity // large_part)) if groups else capacity + 1
    ranks = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    lengths = [n for n in range(capacity, limit - 1, -1) if counts[n]]
    if lengths:
        by_size: dict[int, list[list[int]]] = {}
        for part in _grouped(counts, lengths, groups):  # groups that round up to one size are one
            by_size.setdefault(part[0][0], []).extend(part)
        sizes = np.array(list(by_size))
        queues = list(by_size.values())
        demand = np.array([sum(m for _, m in q) for q in queues])
        for config, times in configurations(sizes, demand, capacity):
            runs += _substitute(queues, config, times, ranks)
    by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for bins, places in runs:
        by_room.setdefault(capacity - sum(n for n, _ in places), []).append((bins, places))
    for n in range(min(limit - 1, capacity), 0, -1):
        left = int(counts[n])
        while left:
            room = next((r for r in range(n, capacity + 1) if by_room.get(r)), None)
            if room is None:
                room, run = capacity, (left, [])
            else:
                run = by_room[room].pop()
            per = min(room // n, left)
            bins = min(run[0], left // per)
            if run[1] and bins < run[0]:
                by_room[room].append((run[0] - bins, [(x, r + bins) for x, r in run[1]]))
            places = run[1] + [(n, int(ranks[n]) + i * bins) for i in range(per)]
            ranks[n] += bins * per
            left -= bins * per
            by_room.setdefault(room - per * n, []).append((bins, places))
    return [run for own in by_room.values() for run in own]


def plan(histogram: np.ndarray, capacity: int = CAPACITY, *, shapes: tuple[tuple[int, int], ...] = SHAPES) -> Runs:
    """histogram[n]: how many pieces of length n. Runs (bins, [(length, first rank), ...]) that hold each piece once.

    Of the plans by these (groups, large part), the first with the fewest sequences is taken.
    """
    return min((plan_by(histogram, capacity, *s) for s in shapes), key=lambda runs: sum(bins for bins, _ in runs))


def places_table(runs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Sorted by (length, first rank): length, first rank, first sequence, offset."""
    rows, sequence = [], 0
    for bins, places in runs:
        offset = 0
        for n, rank in places:
            rows.append((n, rank, sequence, offset))
            offset += n
        sequence += bins
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, its part and rank in it (and its ids, if asked for).

    The rank counts the pieces of the same length that its task made before.
    """
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches):
        bpe, part = library_encoder(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            names = batch.column(0).to_pylist()
            i = 0
            for ids, offsets in bpe.encode(batch.column(1)):
                out: list[list] = [[], [], [], [], [], [], []]
                spans: list[np.ndarray] = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own = np.concatenate((ids[a:b], tail))
                    data, n = own.astype("<u4").tobytes(), len(own)
                    spans.append(own)
                    first = n % capacity or min(n, capacity)
                    at, k = 0, 0
                    while at < n:
                        size = first if k == 0 else capacity
                        for column, value in zip(out, (names[i], k, at, size, zlib.crc32(data[4 * at : 4 * (at + size)]), part, seen[size]), strict=True):
                            column.append(value)
                        seen[size] += 1
                        at, k = at + size, k + 1
                    i += 1
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
                if with_ids:
                    ends = pa.array(np.append(0, np.cumsum(out[3])).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*spans, tail[:0]]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"][: len(cols)])
        bpe.release()

    frame = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return frame.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids)


def assign(cut_pieces: DataFrame, *, capacity: int = CAPACITY, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """cut_pieces: rows with length (1 to capacity), part and rank, read from files. part and rank give way to sequence_id and offset."""
    spark = cut_pieces.sparkSession
    counts = cut_pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    n_counts = 0
    for r in counts.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).collect():  # capacity rows at most
        histogram[r["length"]], n_counts = r["n"], n_counts + r["parts"]
    histogram[capacity] = 0
    table = places_table(plan(histogram, capacity))
    beyond = int(histogram.sum())  # there are no more sequences than pieces: full ones are numbered beyond
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if n_counts <= most_broadcast:
        base = F.broadcast(base)
    # a length has few runs, and there are capacity lengths at most: each row looks its own up without leaving the JVM
    runs: dict[int, list] = {}
    for n, first, sequence, offset in table.tolist():
        runs.setdefault(n, []).append((first, sequence, offset))
    places = F.broadcast(spark.createDataFrame(list(runs.items()), "length long, runs array<struct<first: bigint, sequence: bigint, offset: bigint>>"))
    ranked = cut_pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).join(places, "length", "left")
    ranked = ranked.withColumn("place", F.expr("element_at(filter(runs, r -> r.first <= rank), -1)"))
    full = F.col("length") == capacity
    sequence = F.when(full, F.col("rank") + beyond).otherwise(F.col("place.sequence") + F.col("rank") - F.col("place.first"))
    offset = F.when(full, F.lit(0).cast("long")).otherwise(F.col("place.offset"))
    return ranked.select(*[f"`{f.name}`" for f in cut_pieces.schema.fields if f.name not in ("part", "rank")], sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    spark = docs.sparkSession
    rows = pieces(docs, path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    rows.write.parquet(folder := new_folder(spark, "pieces"))
    return assign(spark.read.schema(rows.schema).parquet(folder), capacity=capacity)
