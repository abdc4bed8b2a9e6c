"""Shared folder, lineage cuts, names, places of rows, and joins that no key can make hot."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.storage import shared_folder

#: A key of more rows is hot; there are MOST_HOT such keys at most, or the bound rises.
HOT_ROWS, MOST_HOT = 1_000, 1 << 17


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder, so that a lost executor costs a read and not the job."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once in an application, so that their Python workers can import it."""
    context, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_quernel_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    at = Path(tempfile.mkdtemp(prefix="quernel-code-")) / "quernel_code.zip"
    at.write_bytes(data.getvalue())
    context.addPyFile(str(at))
    context._quernel_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names of helper columns that none of ``taken`` has, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out


def placed_rows(docs: DataFrame) -> tuple[DataFrame, Column]:
    """The same rows from files, and a column (file, row) that no two rows share and that every reading gives alike.

    A plain Parquet table has that already; anything else is written to the shared folder first.
    """
    if "_metadata" not in docs.columns and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            docs.select("_metadata.row_index")
        except AnalysisException:
            pass  # no Parquet files
        else:
            return docs, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    (name,) = fresh_names(docs.columns, "row")
    out = docs.withColumn(name, F.monotonically_increasing_id())
    out.write.parquet(folder := new_folder(docs.sparkSession, "rows"))
    return docs.sparkSession.read.schema(out.schema).parquet(folder), F.struct(F.lit("").alias("file"), F.col(f"`{name}`").alias("row"))


def join_by_key(rows: DataFrame, table: DataFrame, key: str, n_rows: int, *, count_col: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the columns of a table that has one row for each key, and ``count_col``, how many rows have it.

    Keys of more than ``hot_rows`` rows are looked up from a broadcast, so their rows stay where they are: of n_rows
    rows, such keys are ``MOST_HOT`` at most. All others meet by a shuffle.
    """
    least = max(hot_rows, n_rows // MOST_HOT)
    if n_rows <= least:
        return rows.join(table, key)
    hot = F.broadcast(table.where(F.col(count_col) > least))
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(count_col) <= least), key)
    return rows.join(hot, key).unionByName(others)


def salted(rows: DataFrame, table: DataFrame, key: str, by: Column, n_rows: int, *, count_col: str = "n", hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """rows, a table that has one row for each key and ``count_col``, how many of rows have it, and what to join them on.

    A key of more than ``hot_rows`` rows is cut into as many parts as it has times that many; ``by`` tells its rows
    apart. Rows learn the parts of hot keys, ``MOST_HOT`` at most, from a broadcast; any kind of join may follow.
    """
    least = max(hot_rows, n_rows // MOST_HOT)
    if n_rows <= least:
        return rows, table, [key]
    parts = F.ceil(F.col(count_col) / least).cast("int")
    hot = F.broadcast(table.where(F.col(count_col) > least).select(key, parts.alias("__parts")))
    rows = rows.join(hot, key, "left").withColumn("__salt", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("__parts"))).otherwise(F.lit(0)).cast("int")).drop("__parts")
    return rows, table.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))), [key, "__salt"]
