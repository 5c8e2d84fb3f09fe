"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tapeweave.session import cut_lineage, shared_folder

__all__ = ["ascii_lower", "cut_lineage", "drop_ids", "field_sql", "map_batches", "read", "stored", "text_or_empty"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that the planner knows its size in front of a join."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def field_sql(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """The field of ``column``, nullable, under ``name``."""
    return T.StructField(name or column, df.schema[column].dataType, True)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def drop_ids(docs: DataFrame, rejected: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``rejected``; rows without an id stay, columns stay as they are."""
    gone = rejected.select(F.col(id_col).alias("__gone")).where("__gone IS NOT NULL").distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
