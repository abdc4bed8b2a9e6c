"""URL filters: rules, then a ratio of character language models (operator 6).

A rule (host and path) decides for its host, all subdomains, and paths that start with its own; the longest rule
wins. What no rule decides is scored by two variable-order Markov models of characters, one of accepted and one of
rejected URLs: each order's estimate is smoothed by the next shorter one, with counts in hashed tables of fixed
size. The score is the difference of log-likelihoods per character. The threshold is calibrated on accepted URLs
that the models haven't seen, so that at most ``FALSE_BLOCKS`` of them would be blocked.

The models are counted over the seeds (``seed_urls``, a bounded set made here) and over every row of the table, without
weights, by a partial aggregation: a row that a rule has decided is labelled by it, and one that no rule decides is
accepted background, unless models of the seeds alone score it above their own threshold. Without that last step the
bad hosts of the background count as accepted, and none of them is blocked any more. The threshold is calibrated
on accepted rows and seeds that are held out, a fifth of either (by a hash of the url, so that copies keep together);
then all are counted. The count tables have ``SLOTS`` numbers for each order: that bounds what is collected and
broadcast, at every size of the input.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed, as there is
nothing to score; repeated rows get equal verdicts; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from ._words import text_buffer

#: (rule, verdict) of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 5
SLOTS = 1 << 16
LAMBDA = 2.0
FALSE_BLOCKS = 0.01
#: One in so many rows and seeds is held out to calibrate, with scores in bins of 1 / BINS.
HELD = 5
BINS = 10_000
_BATCH = 1 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def match_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def seed_urls() -> tuple[list[str], list[str]]:
    """(accepted, rejected): some hundreds of labelled URLs, combined from the words of either kind."""
    good = "news blog docs wiki library science history school music travel garden weather museum journal research open data health recipes sport code project community town".split()
    bad = "casino poker viagra pills cheap-pills replica-watches free-money xxx adult sex porn spam spam-farm link-farm payday-loans lottery bonus-slots hot-girls crack warez keygen cheap-meds betting click-farm".split()
    tops = "example.com example.org example.net com org net info edu".split()
    paths = "/en/{} /fr/{} /de/{} /es/{}/ /{}.html /articles/{} /2024/05/{} /index.php?id={} /en/{}?utm_source=feed /de/{}#top".split()
    out: tuple[list[str], list[str]] = ([], [])
    for k, words in enumerate((good, bad)):
        for i, w in enumerate(words):
            for j in range(len(tops)):
                lead = ("https://www.", "https://", "http://", "https://m.", "https://blog.")[(i + j) % 5]
                name = w if j % 2 else f"{w}-{words[(i + j + 1) % len(words)]}"
                out[k].append(f"{lead}{name}.{tops[j]}{paths[(i * 3 + j) % len(paths)].format((i * 37 + j * 101) % 997)}")
    return out


def _grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Slot of the character and the ``order`` before it, at every place; a text starts after order zeros."""
    n = len(raw)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(n)
    h = np.full(n, 0x9E3779B97F4A7C15 * (order + 1) & (1 << 64) - 1, np.uint64)
    for k in range(order, -1, -1):
        at = place - k
        byte = np.where(at >= start, raw[np.maximum(at, 0)], 0).astype(np.uint64)
        h = (h ^ (byte + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def _contexts(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Slot of the ``order`` characters before each place."""
    n = len(raw)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(n)
    h = np.full(n, 0xD6E8FEB86659FD93 * (order + 1) & (1 << 64) - 1, np.uint64)
    for k in range(order, 0, -1):
        at = place - k
        byte = np.where(at >= start, raw[np.maximum(at, 0)], 0).astype(np.uint64)
        h = (h ^ (byte + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def count_grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts by [gram or context, order, slot]."""
    out = np.zeros((2, ORDER, SLOTS))
    for k in range(ORDER):
        out[0, k] = np.bincount(_grams(raw, offsets, k), minlength=SLOTS)
        out[1, k] = np.bincount(_contexts(raw, offsets, k), minlength=SLOTS)
    return out


def _buffer(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pa.array(urls, pa.string()))


@dataclass(frozen=True)
class UrlModel:
    counts: np.ndarray  # [accepted or rejected, gram or context, order, slot]
    threshold: float = 0.0

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-likelihood when rejected less that when accepted, per character; 0 for an empty url."""
        diff = np.zeros(len(raw))
        for sign, own in ((-1, self.counts[0]), (1, self.counts[1])):
            p = np.full(len(raw), 1 / 256)
            for k in range(ORDER):
                gram, context = own[0, k][_grams(raw, offsets, k)], own[1, k][_contexts(raw, offsets, k)]
                p = (np.minimum(gram, context) + LAMBDA * p) / (context + LAMBDA)
            diff += sign * np.log(p)
        upto = np.append(0, np.cumsum(diff))
        size = np.diff(offsets)
        return (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(size, 1)


def seed_counts(keep=lambda i: True) -> np.ndarray:
    return np.stack([count_grams(*_buffer([u for i, u in enumerate(urls) if keep(i)])) for urls in seed_urls()])


def _seed_model(false_blocks: float) -> UrlModel:
    """Of the seeds alone, to label rows."""
    scores = UrlModel(seed_counts(lambda i: i % HELD)).scores(*_buffer([u for i, u in enumerate(seed_urls()[0]) if i % HELD == 0]))
    return UrlModel(seed_counts(), max(0.0, float(np.quantile(scores, 1 - false_blocks, method="higher"))))


def _rejected(batch: pa.RecordBatch, seeds: UrlModel) -> np.ndarray:
    """Labels of (url, rejected): a null one by the seeds' models."""
    label = np.array(pa.compute.fill_null(batch.column(1), False), bool)
    free = np.array(pa.compute.is_null(batch.column(1)), bool)
    if free.any():
        label[free] = seeds.scores(*text_buffer(batch.column(0).filter(pa.array(free)))) > seeds.threshold
    return label


def corpus_counts(labelled: DataFrame, seeds: UrlModel) -> np.ndarray:
    """labelled: (url, rejected, held). Counts over all rows, by [held, label, ...]; a task sends each slot once."""
    shared = labelled.sparkSession.sparkContext.broadcast(seeds)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            part = 2 * np.array(batch.column(2), bool) + _rejected(batch, shared.value)
            for kind in np.unique(part):
                rows = batch.column(0).filter(pa.array(part == kind))
                for at in range(0, len(rows), 10_000):
                    got = count_grams(*text_buffer(rows.slice(at, 10_000)))
                    sums[kind] = sums[kind] + got if kind in sums else got
        for kind, counts in sums.items():
            at = np.flatnonzero(counts.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at + int(kind) * counts.size), pa.array(counts.ravel()[at])], ["slot", "n"])

    out = np.zeros((2, 2, 2, ORDER, SLOTS))
    sums = labelled.mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # out.size rows at most
    out.reshape(-1)[np.array(sums["slot"])] = np.array(sums["n"])
    return out


def held_scores(labelled: DataFrame, seeds: UrlModel, model: UrlModel) -> tuple[np.ndarray, np.ndarray]:
    """(score rounded up to a bin, rows) of the accepted rows that are held out."""
    shared = labelled.sparkSession.sparkContext.broadcast((seeds, model))

    def run(batches):
        own, judge_ = shared.value
        for batch in batches:
            scores = judge_.scores(*text_buffer(batch.column(0).filter(pa.array(~_rejected(batch, own)))))
            at, n = np.unique(np.ceil(scores * BINS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["bin", "n"])

    sums = labelled.where("held").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    return np.array(sums["bin"]) / BINS, np.array(sums["n"])


def train(labelled: DataFrame | None = None, *, false_blocks: float = FALSE_BLOCKS) -> UrlModel:
    """Models from the seeds and, if given, from all rows of (url, rejected), where a null label is left to the seeds."""
    seeds = _seed_model(false_blocks)
    if labelled is None:
        return seeds
    rows = labelled.select("url", "rejected", (F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0).alias("held")).where("url IS NOT NULL")
    corpus = corpus_counts(rows, seeds)
    part = UrlModel(seed_counts(lambda i: i % HELD) + corpus[0])
    scores, n = held_scores(rows, seeds, part)
    own = part.scores(*_buffer([u for i, u in enumerate(seed_urls()[0]) if i % HELD == 0]))
    scores, n = np.append(scores, own), np.append(n, np.ones(len(own)))
    order = np.argsort(scores)
    above = n.sum() - np.cumsum(n[order])
    threshold = float(scores[order][np.argmax(above <= false_blocks * n.sum())])
    return UrlModel(seed_counts() + corpus.sum(axis=0), max(0.0, threshold))


def judge(pages: DataFrame, *, rules: Iterable[tuple[str, str]] = RULES, model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score (null where a rule decides) of every row."""
    rules = tuple(rules)
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r for r, v in rules if v == "block"])
    label = F.when(F.col("rule").isNotNull(), blocked).when(F.col("host") == "", False)  # nothing to score is allowed
    model = model or train(rows.select("url", label.alias("rejected")))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            open_ = pa.compute.is_null(batch.column(4))
            url = batch.column(1).filter(open_)
            # a url without a host has nothing to score
            found = np.full(batch.num_rows, np.nan)
            raw, offsets = text_buffer(url)
            found[np.flatnonzero(np.array(open_))] = shared.value.scores(raw, offsets)
            hosts = np.array(pa.compute.binary_length(batch.column(2)))
            found[(hosts == 0) & ~np.isnan(found)] = 0.0
            score = pa.array(found, pa.float64(), mask=np.isnan(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*names, "score"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, url string, host string, path string, rule string, score double")
    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")).when(F.col("score") > model.threshold, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
