"""DataFrame helpers beside the dialect: what its grammar has no word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def total(x: Column) -> Column:
    """A sum of doubles that is 0 over no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both, by position."""
    if len(a.columns) != len(b.columns):
        raise ValueError("both sides must have as many columns")
    return a.intersect(b.toDF(*a.columns))


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column: rows, nulls, distinct values (approximate), least and greatest value as text; one pass."""
    sums = []
    for c in columns:
        x = F.col(f"`{c}`")
        sums.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("nulls"), F.approx_count_distinct(x).alias("n_distinct"), F.min(x).cast("string").alias("least"), F.max(x).cast("string").alias("greatest")))
    return df.agg(F.array(*sums).alias("x")).select(F.inline("x"))
