"""Bar validation in set form, and the error a caller can raise from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeweave.sources.schema import OHLCV, enforce_ohlcv


def null_counts(bars: DataFrame) -> DataFrame:
    """One row per column that holds nulls, counted in a single pass."""
    names = [n for n in OHLCV.names]
    counted = enforce_ohlcv(bars).agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    return counted.unpivot([], names, "column_name", "nulls").filter("nulls > 0")


def missing_tickers(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected tickers without a single bar."""
    return expected.select("ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_anti")


def duplicate_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def validate_bars(bars: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Return the conformed bars, or raise with the first kind of violation found.

    Messages list at most 20 examples; the checks read every row.
    """
    bars = enforce_ohlcv(bars)
    nulls = {r.column_name: r.nulls for r in null_counts(bars).collect()}
    if nulls:
        raise ValueError(f"Null cells per column: {nulls}.")
    if expected is not None:
        missing = [r.ticker for r in missing_tickers(bars, expected).orderBy("ticker").limit(20).collect()]
        if missing:
            raise ValueError(f"No bars for {missing}.")
    if not duplicate_bars(bars).isEmpty():
        raise ValueError("A ticker has more than one bar on a day.")
    return bars
