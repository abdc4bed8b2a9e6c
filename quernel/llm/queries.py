"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, packing, quality, secrets, simhash, tokenbin, urls, warc, wordpiece
from ._shared import table

#: Vocabulary of the byte-level operators.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(found["fp"]).alias("fingerprint"), "component_id")


def op9_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).drop("key")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.roundtrip(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_roundtrip": op1_warc_roundtrip,
    "op2_secret_scan": op2_secret_scan,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_token_shards": op4_token_shards,
    "op5_word_piece_counts": op5_word_piece_counts,
    "op6_url_filter": op6_url_filter,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash_components": op8_simhash_components,
    "op9_kmeans_tree_neighbours": op9_kmeans_tree_neighbours,
    "op10_line_frequency_rules": op10_line_frequency_rules,
}

#: Base32 of a SHA-1, by groups of five bits.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to
FROM s
"""
_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
wins AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
cover AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY rid),
lines AS (SELECT rid, source, t, trim(lower(x), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS x FROM d)),
long AS (SELECT * FROM lines WHERE strlen(line) >= {quality.MIN_LINE_BYTES}),
often AS (SELECT source, line FROM long GROUP BY source, line HAVING count(DISTINCT t) > {quality.MIN_DOCS}),
gone AS (SELECT rid, CAST(sum(strlen(long.line)) AS BIGINT) AS n FROM long JOIN often ON long.source IS NOT DISTINCT FROM often.source AND long.line = often.line GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, strlen(t) AS size, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(cover.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_bytes
  FROM d JOIN w ON d.rid = w.rid LEFT JOIN cover ON d.rid = cover.rid LEFT JOIN gone ON d.rid = gone.rid),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_bytes, base_failed,
  NOT (base_failed OR removed_bytes > 0 AND (size - removed_bytes < {quality.LEAST_BYTES} OR size - removed_bytes < {quality.LEAST_PART} * size)) AS kept
FROM judged
"""

#: What SQL can express: the others need a tokenizer, XXH64 or a trained model, and are tested against plain Python versions.
ORACLE_SQL: dict[str, str] = {"op1_warc_roundtrip": _WARC, "op10_line_frequency_rules": _QUALITY}
