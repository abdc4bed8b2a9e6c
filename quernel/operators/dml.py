"""INSERT, UPDATE and DELETE over immutable DataFrames: each makes the table's next state and the number of its rows.

A statement is atomic: the new state replaces the old one when it has been written, or not at all. All matching is by
joins on the primary key; nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..errors import QueryError
from ..sources.catalog import Table
from ..sources.storage import settled


def _same(a: DataFrame, b: DataFrame, key: tuple[str, ...]):
    on = F.lit(True)
    for c in key:
        on = on & (a[f"`{c}`"] == b[f"`{c}`"])
    return on


def _clash(rows: DataFrame, key: tuple[str, ...]) -> bool:
    """Two rows of one key, none of whose columns is null."""
    whole = rows.dropna(subset=list(key)) if key else rows
    return not whole.groupBy(*[f"`{c}`" for c in key]).count().where("count > 1").isEmpty()


def inserted(table: Table, rows: DataFrame, conflict: str) -> tuple[DataFrame, int]:
    """rows: in the table's columns, with ``__at``, their order, in files. The new state, and how many rows went in.

    Rows that only come on top are written alone: the state is the old files and theirs.
    """
    old, key = table.frame, table.primary_key
    bare = lambda df: df.select(*[f"`{c}`" for c, _, _ in table.columns])
    for c, _, nullable in table.columns:
        if not nullable and not rows.where(F.col(f"`{c}`").isNull()).isEmpty():
            raise QueryError(f"column {c!r} can't be null")
    n = rows.count()
    if key and conflict == "FAIL":
        if _clash(bare(rows), key) or not rows.join(old, _same(rows, old, key), "left_semi").isEmpty():
            raise QueryError(f"duplicate key in {table.name!r}")
    elif key:
        last = conflict == "REPLACE"
        order = Window.partitionBy(*[f"`{c}`" for c in key]).orderBy(F.desc("__at") if last else F.asc("__at"))
        rows = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
        if last:
            old = old.join(rows, _same(old, rows, key), "left_anti")
        else:
            rows = settled(rows.join(old, _same(rows, old, key), "left_anti"))
            n = rows.count()
    new = bare(old).unionByName(bare(rows))
    for name, columns in table.unique.items():
        if _clash(new, columns):
            raise QueryError(f"duplicate key in the unique index {name!r}")
    return new, n


def updated(table: Table, matches: DataFrame, names: dict[str, str]) -> tuple[DataFrame, int]:
    """matches: the primary key and the new values of each match; names: column -> its name in matches.

    Of several matches of a row one is taken, the one with the largest values; all are counted.
    """
    old, key = table.frame, table.primary_key
    n = matches.count()
    own = matches.groupBy(*[f"`{c}`" for c in key]).agg(F.max(F.struct(*[f"`{x}`" for x in names.values()])).alias("__new"))
    own = own.withColumn("__hit", F.lit(True))
    both = old.join(own, _same(old, own, key), "left")
    columns = [F.when(own["__hit"], own["__new"][names[c]]).otherwise(old[f"`{c}`"]).alias(c) if c in names else old[f"`{c}`"] for c, _, _ in table.columns]
    new = both.select(*columns)
    for c, _, nullable in table.columns:
        if c in names and not nullable and not new.where(F.col(f"`{c}`").isNull()).isEmpty():
            raise QueryError(f"column {c!r} can't be null")
    return new, n


def deleted(table: Table, keys: DataFrame) -> tuple[DataFrame, int]:
    """keys: the primary keys of the rows that go."""
    return table.frame.join(keys, _same(table.frame, keys, table.primary_key), "left_anti"), keys.count()
