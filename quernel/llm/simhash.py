"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 8).

Two 64-bit fingerprints that differ in at most ``radius`` bits have a common variant within half the radius of
either. So every distinct fingerprint emits all variants within half the radius, equal variants meet, and
fingerprints that meet are linked after their distance has been verified.

The variants of a fingerprint are not shuffled one by one. A variant's bucket is its leading ``k`` bits: a
fingerprint is sent once to each bucket that its variants reach (1 + k + k(k-1)/2 rows for half radius 2, with the
flips it has left), and the bucket makes the variants of the remaining bits. That is the same exchange on variants
with a fraction of the rows. A bucket with too many variants is split by eight further bits, again and again; with
all 64 bits used, a bucket is one variant, which at most 2,081 distinct fingerprints reach. So no task holds an
unbounded group, however the fingerprints lie, and no bucket is capped.

Within a bucket, fingerprints that share variants are joined to the smallest of their local component (stars, never
all pairs). Components over all stars come from alternating large-star and small-star rounds, whose edges are cut
from their lineage in the shared folder. Exact copies share a fingerprint and are never expanded into pairs.

Edge cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other. Null ids
are fingerprinted, but never name a component unless it has no other id (then the component is null). Repeated rows
share their component. Further columns of the input are left out of the result. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import HOT_ROWS, cut, fresh_names, join_by_key, placed_rows
from ._words import chunks, give_back, text_buffer

#: A bucket is split when it would make more variants than this.
BUCKET_VARIANTS = 1 << 21
#: A bucket of more fingerprints gives its memory back at once.
LARGE_BUCKET = 1 << 12
#: Leading bits of a bucket at most; the driver holds a counter for each such bucket.
MOST_BITS = 20
SEED = 42
BLOCK = 200_000


def _hashes(text: bytes, width: int):
    """Hashes of a text's shingles, in blocks."""
    words = text.split()
    if not words:
        return
    norm = b" ".join(words)
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
        return
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        own = zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)
        yield np.fromiter((digest(norm[a:b], SEED) for a, b in own), np.uint64)


def fingerprint_array(texts: list[bytes], width: int) -> np.ndarray:
    """Unsigned fingerprints of UTF-8 texts."""
    counts, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        if held:
            every = np.concatenate([h for _, h in held])
            size = np.array([len(h) for _, h in held])
            bits = np.unpackbits(every.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, np.cumsum(size) - size, axis=0, dtype=np.int32)
            for (i, h), s in zip(held, sums, strict=True):
                counts[i] += s
                total[i] += len(h)
            held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for h in _hashes(text.lower(), width):
            held.append((i, h))
            waiting += len(h)
            if waiting >= BLOCK:
                add()
                waiting = 0
    add()
    bits = (2 * counts > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id long, fp long) of every row, and columns made by ``more``: bytes.lower() and bytes.split() are the ASCII rules of the contract."""
    frame = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[c.alias(name) for name, c in (more or {}).items()])

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            data = raw.tobytes()
            for i, j in chunks(offsets):
                fp = fingerprint_array([data[a:b] for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)], width)
                rest = [batch.column(k).slice(i, j - i) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp.view(np.int64)), *rest], ["doc_id", "fp", *batch.schema.names[2:]])
        give_back()

    rest = "".join(f", {f.name} {f.dataType.simpleString()}" for f in frame.schema.fields[2:])
    return frame.mapInArrow(run, f"doc_id long, fp long{rest}")


def flips(low: int, high: int, most: int) -> list[tuple[int, int]]:
    """Masks of at most ``most`` bits from low up to high (not included), each with the flips it leaves."""
    return [(sum(1 << b for b in c), most - n) for n in range(most + 1) for c in combinations(range(low, high), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _spread(rows: DataFrame, used: int, to: int, half: int) -> DataFrame:
    """rows (bucket, fp, spare) dealt by their leading ``used`` bits -> dealt by their leading ``to`` bits."""
    masks = [(_signed(m), half - left) for m, left in flips(64 - to, 64 - used, half)]
    every = "array(" + ", ".join(f"named_struct('m', {m}L, 'n', {n})" if m != -(1 << 63) else f"named_struct('m', bigint('{m}'), 'n', {n})" for m, n in masks) + ")"
    out = rows.select("head", "fp", "spare", F.explode(F.expr(every)).alias("f")).where("f.n <= spare")
    # the flips so far are kept in `head`: the variant's leading bits
    head = F.expr(f"shiftright(head ^ f.m, {64 - to}) & {(1 << to) - 1}L") if to < 64 else F.expr("head ^ f.m")
    return out.select(F.expr("head ^ f.m").alias("head"), head.alias("bucket"), "fp", F.expr("spare - f.n").alias("spare"))


def _made(used: int, spare: int) -> int:
    return len(flips(0, 64 - used, spare)) if spare >= 0 else 0


def link_bucket(fp: np.ndarray, spare: np.ndarray, used: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest of its component in this bucket) for all but the smallest."""
    fp, order = np.sort(fp), np.argsort(fp, kind="stable")
    spare = spare[order]
    low = fp.view(np.uint64) & np.uint64((1 << (64 - used)) - 1)
    keys, who = [], []
    for k in np.unique(spare):
        own = np.flatnonzero(spare == k)
        masks = np.array([m for m, _ in flips(0, 64 - used, int(k))], np.uint64)
        keys.append((low[own][:, None] ^ masks).ravel())
        who.append((own, len(masks)))
    every = np.concatenate(keys)
    ranked = np.sort(every)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return fp[:0], fp[:0]
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    at = np.minimum(np.searchsorted(twice, every), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == every)
    group, member = at[hit], np.concatenate([np.repeat(o, n) for o, n in who])[hit]
    first = np.full(len(twice), len(fp), np.int64)
    np.minimum.at(first, group, member)
    a, b = member, first[group]
    near = np.bitwise_count(fp[a].view(np.uint64) ^ fp[b].view(np.uint64)) <= radius
    pairs = np.unique(a[near] * len(fp) + b[near])
    a, b = pairs // len(fp), pairs % len(fp)
    label = np.arange(len(fp))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _linked(rows: DataFrame, used: int, radius: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy()
        a, b = link_bucket(fp, group.column("spare").to_numpy(), used, radius) if len(fp) > 1 else (fp[:0], fp[:0])
        if len(fp) > LARGE_BUCKET:
            give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("bucket", "fp", "spare").groupBy("bucket").applyInArrow(run, "a long, b long")


def star_edges(distinct: DataFrame, radius: int = 4, *, bucket_variants: int = BUCKET_VARIANTS) -> DataFrame:
    """(a, b) with a > b, whose components are those of all links within ``radius``. distinct: (fp), already cut."""
    if radius % 2:
        # two who share a variant within half the radius are within the radius only if that is even
        raise ValueError(f"the radius must be even: {radius}")
    half = radius // 2
    n = distinct.count()
    used = max(6, min(MOST_BITS, int(n * _made(0, half) * 4 // bucket_variants).bit_length()))
    rows = _spread(distinct.select(F.col("fp").alias("head"), "fp", F.lit(half).alias("spare")), 0, used, half)
    # what each bucket would make, from the count of fingerprints by their leading bits: 2**used numbers at most
    found = distinct.groupBy(F.expr(f"shiftright(fp, {64 - used}) & {(1 << used) - 1}L").alias("h")).count().toArrow()
    heads = np.zeros(1 << used, np.int64)
    heads[found["h"].to_numpy()] = found["count"].to_numpy()
    load = np.zeros(1 << used)
    for mask, left in flips(0, used, half):
        load += heads[np.arange(1 << used) ^ mask] * float(_made(used, left))
    hot = np.flatnonzero(load > bucket_variants)
    if not len(hot):
        return cut(_linked(rows, used, radius).distinct())
    spark = distinct.sparkSession
    # at most 2**MOST_BITS bucket numbers of 8 bytes
    small = F.broadcast(spark.createDataFrame(pa.table({"bucket": pa.array(hot, pa.int64())})))
    edges = cut(_linked(rows.join(small, "bucket", "left_anti"), used, radius).distinct())
    rows = rows.join(small, "bucket", "left_semi")
    while used < 64:
        to = min(64, used + 8)
        rows = cut(_spread(rows, used, to, half))
        weight = F.expr(f"CASE spare {' '.join(f'WHEN {k} THEN {_made(to, k)}L' for k in range(half + 1))} END")
        loads = rows.groupBy("bucket").agg(F.sum(weight).alias("load"))
        hot = cut(loads.where(F.col("load") > (bucket_variants if to < 64 else 1 << 62)).select("bucket"))
        edges = edges.unionByName(_linked(rows.join(hot, "bucket", "left_anti"), to, radius))
        if hot.isEmpty():
            break
        rows, used = rows.join(hot, "bucket", "left_semi"), to
    return cut(edges.distinct())


def connected(edges: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root): every node of the edges (a, b), with the smallest node of its component; roots included.

    A node with very many neighbours meets them by a join of its own (``join_by_key``), so a hub isn't one task.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    while True:
        # large star: the larger neighbours of a node go to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_by_key(both.where("b > a"), least, "a", 2 * n, hot_rows=hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        near = join_by_key(large, least, "a", 2 * n, hot_rows=hot_rows)
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = cut(small.distinct())
        now = new.count()
        same = now == n and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges, n = new, now
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def rooted(fps: DataFrame, radius: int = 4, *, bucket_variants: int = BUCKET_VARIANTS) -> DataFrame:
    """fps: rows with fp, each once, already cut. Adds root: the smallest fingerprint of its component."""
    roots = connected(star_edges(fps.select("fp"), radius, bucket_variants=bucket_variants))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(prints: DataFrame, radius: int = 4, *, bucket_variants: int = BUCKET_VARIANTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """prints: (doc_id, fp), already cut. Returns (fp, component_id, n) of every distinct fingerprint; n: its rows."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    placed = cut(rooted(distinct, radius, bucket_variants=bucket_variants))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    return join_by_key(placed, named, "root", distinct.count(), count_col="fps", hot_rows=hot_rows).select("fp", "component_id", "n")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    named = cut(components(prints, radius, hot_rows=hot_rows))
    return join_by_key(prints, named, "fp", prints.count(), hot_rows=hot_rows).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, with all columns of docs: that with the smallest id (a null id comes last), and of
    rows with one id the first by a hash of its text, then by its place.

    Each row has a place of its own in files (``placed_rows``): the chosen places meet the rows once, one row each, so
    no key is hot, and texts are neither grouped nor ranked.
    """
    rows, place = placed_rows(docs)
    key = F.xxhash64(F.col(text_col).isNull(), F.col(text_col))
    prints = cut(fingerprints(rows, id_col=id_col, text_col=text_col, width=width, more={"key": key, "place": place}))
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key", "place")
    distinct = cut(prints.groupBy("fp").agg(F.min(least).alias("least")))
    chosen = rooted(distinct, radius).groupBy("root").agg(F.min("least").alias("x"))
    (name,) = fresh_names(rows.columns, "place")
    chosen = cut(chosen.select(F.col("x.place").alias(name))).hint("shuffle_hash")  # texts go by it, unsorted
    return rows.withColumn(name, place).join(chosen, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
