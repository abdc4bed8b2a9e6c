"""Quality rules with cross-document line frequency (operator 10). DataFrame functions only.

Lines are normalised (lower-cased, without white space at their ends) and hashed together with their host, and the
distinct texts of the host that hold a line are counted over all rows, so a group of exact copies counts once. A line
above the limit is removed; a document is rejected if too little of it stays. The limit is ``min_docs`` texts at every
size of a host. Lines of fewer than ``MIN_LINE_BYTES`` bytes (closing brackets, numbers, single words) are neither
counted nor removed.

Exchanges: a distinct text sends the hashes of its lines once; all that follows works on those. Lines are counted with
partial counts before they are shuffled. Removed lines are by their nature the frequent ones, and a text may be that
of a third of all rows: both joins cut a hot key into parts by its own count (``salted``). Documents are read twice,
for their lines and for the base rules; only ``clean_documents`` shuffles texts, once.

Base rules of a single document: too few words, or too many words in repeated three-word windows. A window's 64-bit
hash stands for it.

Edge cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; null ids
are kept as they are; repeated rows are one text, and each gets its own row of the result; extra columns, of any name,
are left out of the verdicts and kept by ``clean_documents``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import cut, salted

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is removed if more distinct texts of its host hold it.
MIN_DOCS = 20
MIN_LINE_BYTES = 16
#: A document that loses lines is rejected if fewer bytes of lines than this, or a smaller part of them, stay.
LEAST_BYTES = 150
LEAST_PART = 0.5
#: Up to so many different repeated windows are looked up one by one; beyond, windows are sorted with their places.
FEW = 48
SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of a text as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def normalised(line: Column) -> Column:
    return F.btrim(F.lower(line), F.lit(BLANKS))


def covered(places: Column) -> Column:
    """Words that three-word windows at these rising places cover: min(3, gap) each, and 3 at the last."""
    n = F.greatest(F.size(places) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(places, F.lit(2), n), F.slice(places, F.lit(1), n), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(F.size(places) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g))


def base_columns(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Each helper array is a column of its own, so that no expression works it out twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines, hashes, ranked, twice = (F.col(f"`__{x}`") for x in ("words", "lines", "hashes", "ranked", "twice"))
    n = F.greatest(F.size(words) - 2, F.lit(0))
    out = docs.withColumn("__words", words_of(text)).withColumn("__lines", lines_of(text))
    out = out.withColumn("__hashes", F.transform(F.slice(words, F.lit(1), n), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))
    out = out.withColumn("__ranked", F.sort_array(hashes))
    out = out.withColumn("__twice", F.array_distinct(F.filter(ranked, lambda x, i: x == F.get(ranked, i - 1))))
    # few repeated windows: their places by lookup; many: windows sorted with their places, equal neighbours are repeats
    few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
    paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__paired", F.when(F.size(twice) > FEW, paired))
    pairs = F.col("`__paired`")
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    many = F.sort_array(F.transform(F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1))), lambda x: x["i"]))
    places = F.when(F.size(twice) == 0, F.expr("cast(array() as array<int>)")).when(F.size(twice) > FEW, many).otherwise(few)
    out = out.withColumn("__places", places)
    out = (
        out.withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("n_repeat_words", covered(F.col("`__places`")))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__words", "__lines", "__hashes", "__ranked", "__twice", "__paired", "__places")


def line_key(host: Column, normal: Column) -> Column:
    """A line of a host."""
    return F.xxhash64(host, normal)


def text_key(host: Column, text: Column) -> Column:
    """A text of a host; host and text aren't null here or there, so both say so."""
    return F.xxhash64(host.isNull(), host, text)


def _parts(text_col: str, host_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{host_col}`").cast("string")


def distinct_texts(docs: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(key, lines, n): the lines (hash and bytes) of each distinct text of a host, and how many rows it is in; cut."""
    text, host = _parts(text_col, host_col)
    lines = F.transform(F.split(text, "\n"), normalised)
    lines = F.transform(lines, lambda x: F.struct(line_key(host, x).alias("line"), F.octet_length(x).alias("size")))
    lines = F.filter(lines, lambda x: x["size"] >= MIN_LINE_BYTES)
    return cut(docs.select(text_key(host, text).alias("key"), lines.alias("lines")).groupBy("key", "lines").agg(F.count(F.lit(1)).alias("n")))


def frequent_lines(texts: DataFrame, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line, docs): the lines above their host's limit; cut."""
    # explode() would infer a filter on the array's size, which is pushed below and makes the array there once more
    lines = texts.select(F.explode_outer(F.array_distinct("lines.line")).alias("line")).where("line IS NOT NULL")
    return cut(lines.groupBy("line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > min_docs))


def removals(texts: DataFrame, frequent: DataFrame, *, with_lines: bool = False) -> DataFrame:
    """(key, removed, n[, gone]): the bytes of frequent lines of each text that has any."""
    lines = texts.select("key", "n", F.explode_outer("lines").alias("x")).where("x IS NOT NULL").select("key", "n", "x.line", "x.size")
    total = frequent.agg(F.sum("docs")).head()[0] or 0
    lines, frequent, on = salted(lines, frequent, "line", F.col("key"), total, count_col="docs")
    found = lines.join(frequent, on, "left_semi")
    return found.groupBy("key").agg(F.sum("size").alias("removed"), F.first("n").alias("n"), *[F.collect_set("line").alias("gone")] * with_lines)


def judged(rows: DataFrame, docs: DataFrame, *, text_col: str, host_col: str, min_docs: int, with_lines: bool = False) -> DataFrame:
    """rows: made from docs, with text, host and what is to be kept. Adds key, the base columns, removed_bytes and kept."""
    texts = distinct_texts(docs, text_col=text_col, host_col=host_col)
    removed = removals(texts, frequent_lines(texts, min_docs=min_docs), with_lines=with_lines)
    text = F.coalesce("text", F.lit(""))
    base = base_columns(rows.withColumn("key", text_key(F.col("host"), text)).withColumn("size", F.octet_length(text).cast("long"))).drop("text", "host")
    total = texts.agg(F.sum("n")).head()[0] or 0
    base, removed, on = salted(base, removed, "key", F.monotonically_increasing_id(), total)
    out = base.join(removed.drop("n"), on, "left").withColumn("removed_bytes", F.coalesce("removed", F.lit(0).cast("long")))
    stays = F.col("size") - F.col("removed_bytes")
    depleted = (F.col("removed_bytes") > 0) & ((stays < LEAST_BYTES) | (stays < LEAST_PART * F.col("size")))
    return out.withColumn("kept", ~(F.col("base_failed") | depleted))


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """A row for each row of docs: its id, a key of its text, the base columns, removed_bytes, base_failed and kept."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), _parts(text_col, host_col)[1].alias("host"))
    out = judged(rows, docs, text_col=text_col, host_col=host_col, min_docs=min_docs)
    return out.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_bytes", "base_failed", "kept")


def clean_documents(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", length_col: str | None = None, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs that are kept, without their removed lines, with all their columns.

    A text without frequent lines stays as it is, byte for byte. length_col: a column of docs that gets the length of
    a text that has changed. The columns of docs travel in one struct, so no helper can have the name of one.
    """
    text, host = _parts(text_col, host_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), host.alias("host"))
    out = judged(rows, docs, text_col=text_col, host_col=host_col, min_docs=min_docs, with_lines=True)
    # an expression that isn't deterministic stays where it is: the base rules would be pushed below their helper columns, and each of those worked out many times
    out = out.where(F.when(F.monotonically_increasing_id() >= 0, F.col("kept")))
    own, gone = F.col("row").getField, F.col("gone")
    # short lines have no place in `gone`, but could have the hash of a longer one only by chance
    stays = F.filter(F.split(own(text_col), "\n"), lambda x: ~F.array_contains(gone, line_key(own(host_col).cast("string"), normalised(x))))
    out = out.select("row", "gone", F.when(gone.isNotNull(), F.array_join(stays, "\n")).alias("cleaned"))
    changed = {text_col: F.col("cleaned")}
    if length_col:
        changed[length_col] = F.length("cleaned").cast(docs.schema[length_col].dataType)
    return out.select(*[(F.when(gone.isNull(), own(c)).otherwise(changed[c]) if c in changed else own(c)).alias(c) for c in docs.columns])
