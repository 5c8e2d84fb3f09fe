"""Fixed table schemas, enforced by name at every boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Column names and types of the bar and return tables.
OHLCV = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)
RETURNS = T.StructType(
    [
        T.StructField("decision_date", T.DateType()),
        T.StructField("execution_date", T.DateType()),
        T.StructField("next_execution_date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("next_open", T.DoubleType()),
        T.StructField("return", T.DoubleType()),
    ]
)
MACRO = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, names, what: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"Missing {what} columns: {missing}")


def conform(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Select and cast to ``schema``; extra columns go, missing ones are an error."""
    require_columns(df, schema.names, what)
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def enforce_ohlcv(df: DataFrame) -> DataFrame:
    return conform(df, OHLCV, "OHLCV")


def enforce_returns(df: DataFrame) -> DataFrame:
    return conform(df, RETURNS, "returns")


def finite(column) -> "Column":
    """True for a present, finite number."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
