"""Files and lineage: Parquet tables, and state in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import QueryError


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one is made on a single machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise QueryError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quernel-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The same rows from Parquet files in the shared folder: a table's state doesn't carry every change before it, and
    filters and columns reach the scan.
    """
    folder = f"{shared_folder(df.sparkSession)}/state-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with whole numbers as 64-bit ones. Nothing is read here but the footer."""
    df = spark.read.parquet(path)
    narrow = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType))]
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in narrow}) if narrow else df


def dialect_type(kind: T.DataType) -> str:
    """The dialect's type of a Spark column."""
    for types, name in (((T.BooleanType,), "boolean"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"), ((T.FloatType, T.DoubleType), "double"), ((T.DecimalType,), "decimal"), ((T.StringType,), "string"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "datetime"), ((T.ArrayType,), "array"), ((T.MapType,), "map")):
        if isinstance(kind, types):
            return name
    return "any"
