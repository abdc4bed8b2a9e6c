"""Approximate nearest neighbours by a hierarchical k-means tree (operator 9).

The tree is fitted on the driver from a bounded sample (about ``SAMPLE`` rows by a hash of their number) and broadcast
(``MOST_LEAVES`` leaves, give or take the branching); every row is then indexed by the leaf it descends to. A query
walks the tree best bin first: a priority queue gives the node whose centre is nearest, inner nodes put their children
into the queue, and leaves are visited in that order, until both the calibrated number of leaves and k rows besides
the query's own are reached. That number is calibrated: for ``CALIBRATION`` rows the true neighbours among all rows
are found by brute force, and visits widen until they hold ``RECALL`` of those.

Cost: up to ``MOST_LEAVES * leaf_rows`` rows (524,288) a leaf has about ``leaf_rows`` rows at any size of the table.
Beyond that the tree stays as it is, for it must fit a broadcast, and leaves get fuller: a query then reads the part
visits / leaves of the table, in blocks that are spread over tasks.

Rows and queries meet by leaf. A leaf with many rows or queries is cut into blocks of about ``BLOCK`` rows each, by
a hash of their number, so a leaf that a third of all rows share (equal vectors can't be parted) isn't one task; every
block of rows still meets every block of queries of its leaf, so nothing is dropped. Each pair of blocks sends on the
nearest k of each query, and ranks are settled from those.

Distances are found by a matrix product first; whatever could be among the nearest k within its rounding error is
measured again on the original vectors in double precision, so ties go to the smaller id exactly.

Edge cases: vectors that are null, empty or zero, hold a null or a value that isn't finite, have no id, or are not of
the commonest dimension take no part, neither as queries nor as candidates. A row is told apart by its number, not by
its id: rows with one id are candidates each, and as queries each has k rows of its own, among them the other rows of
its id. Fewer than k candidates: all of them. Extra columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import cut

SAMPLE = 20_000
MOST_LEAVES = 2_048
LEAF_ROWS = 256
BRANCH = 16
CALIBRATION = 96
RECALL = 0.98
BLOCK = 4_096


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = np.unique(x[rng.choice(len(x), min(len(x), 4 * k), replace=False)], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        label = _nearest(x, centres)
        size = np.bincount(label, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        centres = sums[size > 0] / size[size > 0][:, None]
    return centres


@dataclass
class Tree:
    """Nodes by number; a node without children is a leaf, numbered by ``leaf``."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int, *, branch: int = BRANCH, seed: int = 3) -> Tree:
        rng = np.random.default_rng(seed)
        least = max(4, len(x) // max(1, leaves))
        centres, first, count = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [0], [0]
        queue = [(0, np.arange(len(x)))]
        for node, rows in queue:
            if len(rows) < 2 * least:
                continue
            own = _kmeans(x[rows], min(branch, max(2, len(rows) // least)), rng)
            label = _nearest(x[rows], own)
            if len(own) < 2 or (label == label[0]).all():
                continue
            first[node], count[node] = len(centres), len(own)
            for i in range(len(own)):
                queue.append((len(centres), rows[label == i]))
                centres.append(own[i])
                first.append(0)
                count.append(0)
        size = np.array(count)
        return cls(np.array(centres), np.array(first), size, np.where(size == 0, np.cumsum(size == 0) - 1, -1))

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node, todo = np.zeros(len(x), np.int64), np.arange(len(x)) if self.count[0] else np.zeros(0, np.int64)
        while len(todo):
            for n in np.unique(node[todo]):
                own = todo[node[todo] == n]
                node[own] = self.first[n] + _nearest(x[own], self.centres[self.first[n] : self.first[n] + self.count[n]])
            todo = todo[self.count[node[todo]] > 0]
        return self.leaf[node]

    def visit(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves, best bin first: ``most`` of them, and more until they hold ``least`` rows by ``sizes``."""
        heap, out, rows = [(0.0, 0)], [], 0
        while heap and (len(out) < most or rows < least):
            _, n = heapq.heappop(heap)
            if not self.count[n]:
                out.append(int(self.leaf[n]))
                rows += int(sizes[out[-1]]) if sizes is not None else 0
                continue
            a, b = int(self.first[n]), int(self.first[n] + self.count[n])
            for d, i in zip(((self.centres[a:b] - q) ** 2).sum(1).tolist(), range(a, b), strict=True):
                heapq.heappush(heap, (d, i))
        return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def top_pairs(queries: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the nearest k of each query, exact, ties to smaller ids; query and row are places here.

    queries, rows: numbers of the table's rows; a query's own is left out.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    norm = (x**2).sum(1)
    for at in range(0, len(queries) if len(rows) else 0, 256):
        own, names = q[at : at + 256], queries[at : at + 256]
        square = (own**2).sum(1)
        near = norm - 2 * own @ x.T + square[:, None]
        near[names[:, None] == rows] = np.inf
        keep = min(k, near.shape[1]) - 1
        bound = np.partition(near, keep, axis=1)[:, keep]
        slack = 1e-10 * (square + norm.max()) + 1e-300
        for i, row in enumerate(near):
            # where fewer than k are there, the bound is infinite: all but its own
            some = np.flatnonzero((row <= bound[i] + slack[i]) & np.isfinite(row))
            d = np.sqrt(((x[some] - own[i]) ** 2).sum(1))
            best = np.lexsort((rows[some], ids[some], d))[:k]
            out.append((np.full(len(best), at + i), some[best], d[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def valid(vector: Column) -> Column:
    """Not null or empty, all finite, not zero."""
    # NaN is the largest double here, so it fails the comparison, too
    finite = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def prepared(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id long, vec) of all rows that take part; row: a number of its own."""
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head(1)
    return rows.where(F.size("vec") == (sizes[0]["n"] if sizes else 0))


def sampled(rows: DataFrame, n: int, total: int, salt: int) -> DataFrame:
    """About n of the total rows, by a hash of their number; all, if there are no more."""
    return rows if total <= n else rows.where(F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1 << 40)) < int(n / total * (1 << 40)))


def _block_top(rows: DataFrame, queries: np.ndarray, numbers: np.ndarray, k: int) -> DataFrame:
    """A bounded set of queries against all rows: query (its row), id, row, score, leaf of each task's nearest."""
    shared = rows.sparkSession.sparkContext.broadcast((numbers, queries))

    def run(batches):
        numbers, queries = shared.value
        found = [np.zeros(0, np.int64)] * 3 + [np.zeros(0), np.zeros(0, np.int32)]
        for batch in batches:
            row, ids, leaf, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(2))
            for at in range(0, len(ids), BLOCK):
                part = slice(at, at + BLOCK)
                a, b, d = top_pairs(numbers, queries, row[part], ids[part], x[part], k)
                found = [np.concatenate(c) for c in zip(found, (numbers[a], ids[part][b], row[part][b], d, leaf[part][b]), strict=True)]
                # of all blocks so far, the nearest k of each query stay
                order = np.lexsort((found[2], found[1], found[3], found[0]))
                first = np.flatnonzero(np.append(True, np.diff(found[0][order]) != 0)) if len(order) else order
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                found = [c[order[rank < k]] for c in found]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query", "id", "row", "score", "leaf"])

    return rows.select("row", "id", "vec", "leaf").mapInArrow(run, "query long, id long, row long, score double, leaf int")


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ranked from 1."""
    order = Window.partitionBy("query").orderBy("score", "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(table: DataFrame, is_query: Column, *, k: int = 10, recall: float = RECALL, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", leaf_rows: int = LEAF_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest k rows of each row of the table that is_query (a condition on ``id``) holds for."""
    spark = table.sparkSession
    rows = prepared(table, id_col=id_col, vector_col=vector_col)
    kind = rows.schema["vec"].dataType.simpleString()
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(sampled(rows, sample, total, 5).select("vec").toArrow().column("vec"))
    tree = Tree.fit(x, min(MOST_LEAVES, max(1, total // leaf_rows)))
    shared = spark.sparkContext.broadcast(tree)

    def index(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.descend(_matrix(batch.column(2))).astype(np.int32))], ["row", "id", "vec", "leaf"])

    # cut, so that a row keeps its number
    indexed = cut(rows.mapInArrow(index, f"row long, id long, vec {kind}, leaf int"))
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # as many rows as leaves
        sizes[r["leaf"]] = r["count"]

    # true neighbours of some rows, and where they stand in the order of visits
    some = sampled(indexed, CALIBRATION, total, 9).select("row", "vec").toArrow()
    numbers, x = some.column("row").to_numpy(), _matrix(some.column("vec"))
    truth = nearest_of(_block_top(indexed, x, numbers, k), k).select("query", "leaf").collect() if len(numbers) else []
    places = {int(n): {leaf: i for i, leaf in enumerate(tree.visit(v, tree.leaves))} for n, v in zip(numbers, x, strict=True)}
    needed = np.sort([places[r["query"]][r["leaf"]] + 1 for r in truth]) if truth else np.array([tree.leaves])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])

    def walk(batches):
        tree = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen = [tree.visit(v, visits, sizes, k + 1) for v in _matrix(part.column(2))]
                size = np.array([len(s) for s in seen])
                again = pa.array(np.repeat(np.arange(len(seen)), size))
                yield pa.RecordBatch.from_arrays([*(c.take(again) for c in part.columns), pa.array(np.concatenate(seen).astype(np.int32))], ["row", "id", "vec", "leaf"])

    asked = cut(indexed.where(is_query).select("row", "id", "vec").mapInArrow(walk, f"row long, id long, vec {kind}, leaf int"))
    counts = asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("q")).collect()
    # as many rows as leaves
    pieces = [(int(r["leaf"]), int(-(-sizes[r["leaf"]] // block)), int(-(-r["q"] // block))) for r in counts if sizes[r["leaf"]]]
    pieces = F.broadcast(spark.createDataFrame(pieces, "leaf int, vs int, qs int"))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(pieces, "leaf").select("leaf", part("vs").alias("v"), every("qs").alias("q"), "row", "id", "vec")
    right = asked.join(pieces, "leaf").select("leaf", every("vs").alias("v"), part("qs").alias("q"), "row", "id", "vec")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        row, ids, query, names = a["row"].to_numpy(), a["id"].to_numpy(), b["row"].to_numpy(), b["id"].to_numpy()
        i, j, d = top_pairs(query, _matrix(b["vec"]), row, ids, _matrix(a["vec"]), k) if len(row) and len(query) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"query": pa.array(query[i], pa.int64()), "query_id": pa.array(names[i], pa.int64()), "row": pa.array(row[j], pa.int64()), "id": pa.array(ids[j], pa.int64()), "score": pa.array(d, pa.float64())})

    found = left.groupBy("leaf", "v", "q").cogroup(right.groupBy("leaf", "v", "q")).applyInArrow(meet, "query long, query_id long, row long, id long, score double")
    return nearest_of(found, k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
