"""Bars, benchmark and macro tables from trade prints and timestamped readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def trades_to_bars(trades: DataFrame, sequence: list[str], ticker: str | Column = "ticker") -> DataFrame:
    """Aggregate prints (``date, price, volume``) to one bar per ticker and day.

    ``sequence`` must order prints totally inside a day; first and last prints become open
    and close. All aggregates combine map-side, so one busy ticker or day costs one row per
    map task in the shuffle, not its prints.
    """
    name = F.col(ticker) if isinstance(ticker, str) else ticker
    order = F.struct(*sequence)
    bars = trades.groupBy(F.col("date").cast("date").alias("date"), name.alias("ticker")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("volume").cast("bigint").alias("volume"),
    )
    return bars.select("date", "ticker", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")


def readings_to_macro(readings: DataFrame, every: str = "day") -> DataFrame:
    """Mean value per series and period; ``date`` is the period's start."""
    return readings.groupBy(
        F.date_trunc(every, "ts").alias("date"), F.col("series").alias("ticker")
    ).agg(F.avg("value").alias("value"))


def benchmark_subset(bars: DataFrame, ticker: str) -> DataFrame:
    return bars.filter(F.col("ticker") == ticker)


def trading_calendar(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()
