"""Macro series features: changes, returns and trailing z-scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeweave.functions.windows import present_in, ratio
from tapeweave.sources.schema import require_columns

SUFFIXES = ("diff", "pct_change", "log_return", "zscore")


def series_name(symbol: str) -> str:
    return "macro_" + re.sub(r"[-=./]", "_", symbol.lower().replace("^", ""))


def series_name_column(symbol: str | Column) -> Column:
    c = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.concat(F.lit("macro_"), F.regexp_replace(F.regexp_replace(F.lower(c), r"\^", ""), r"[-=./]", "_"))


def indexed(macro: DataFrame) -> DataFrame:
    """Readings with the position of their date among all dates of the table.

    Lags and windows step over those positions, so a series that skips a date behaves as if
    it had a null there, without a row being made up for it. The date list is one row per
    period and is broadcast.
    """
    require_columns(macro, ["date", "ticker", "value"], "macro")
    position = F.row_number().over(Window.orderBy("date"))
    dates = macro.select("date").distinct().withColumn("__at", position)
    values = macro.groupBy("date", "ticker").agg(F.first("value", ignorenulls=True).cast("double").alias("value"))
    return values.join(dates, "date")


def macro_features_long(macro: DataFrame, window: int = 20) -> DataFrame:
    """``date, series, level`` and the four transforms."""
    series = Window.partitionBy("ticker").orderBy("__at")
    recent = series.rangeBetween(-(window - 1), 0)
    adjacent = F.lag("__at").over(series) == F.col("__at") - 1
    df = indexed(macro).withColumn("__prev", F.when(adjacent, F.lag("value").over(series)))
    v, p = F.col("value"), F.col("__prev")
    return df.select(
        "date",
        series_name_column("ticker").alias("series"),
        v.alias("level"),
        (v - p).alias("diff"),
        (ratio(v, p) - 1).alias("pct_change"),
        F.when((v > 0) & (p > 0), F.ln(v / F.nullif(p, F.lit(0.0)))).alias("log_return"),
        ratio(v - F.avg("value").over(recent), present_in(recent, F.stddev_samp, "value", 2)).alias("zscore"),
    )


def macro_features(macro: DataFrame, symbols, window: int = 20, levels: bool = False) -> DataFrame:
    """Wide form for the listed symbols: ``<series>_<transform>`` columns per date."""
    long = macro_features_long(macro, window)
    names = [series_name(x) for x in symbols]
    parts = (["level"] if levels else []) + list(SUFFIXES)

    def cell(name, part):
        out = name if part == "level" else f"{name}_{part}"
        return F.max(F.when(F.col("series") == name, F.col(part))).alias(out)

    return long.groupBy("date").agg(*[cell(n, p) for p in parts for n in names])
