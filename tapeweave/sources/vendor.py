"""Landed vendor frames (one column per ticker and field) to long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeweave.sources.schema import conform, enforce_ohlcv, finite, MACRO

# Vendor field names and the columns they become.
VENDOR_FIELDS = {
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
}


def _fields(wide: DataFrame, ticker: str, separator: str) -> dict[str, str]:
    return {f: f"{ticker}{separator}{f}" for f in VENDOR_FIELDS if f"{ticker}{separator}{f}" in wide.columns}


def wide_to_long(wide: DataFrame, tickers, date: str = "Date", separator: str = "|") -> DataFrame:
    """Unpivot vendor columns ``<ticker>|<field>`` to one row per date and ticker.

    Missing observations stay null. Without an adjusted close the close stands in.
    The explode is a narrow operation: no shuffle whatever the number of tickers.
    """
    if not tickers:
        raise ValueError("At least one ticker is required.")
    rows = []
    for ticker in tickers:
        present = _fields(wide, ticker, separator)
        if "Close" not in present:
            raise ValueError(f"Vendor frame has no columns for {ticker}.")
        present.setdefault("Adj Close", present["Close"])
        rows.append(
            F.struct(
                F.lit(ticker).alias("ticker"),
                *[
                    (F.col(f"`{present[field]}`") if field in present else F.lit(None)).cast("double").alias(name)
                    for field, name in VENDOR_FIELDS.items()
                ],
            )
        )
    return enforce_ohlcv(wide.select(F.col(date).alias("date"), F.explode(F.array(*rows)).alias("r")).select("date", "r.*"))


def back_adjust(bars: DataFrame) -> DataFrame:
    """Scale open, high, low and close by adj_close/close; unusable factors give nulls."""
    usable = (F.col("close") > 0) & (F.col("adj_close") > 0) & finite("close") & finite("adj_close")
    factor = F.when(usable, F.col("adj_close") / F.col("close"))
    return enforce_ohlcv(bars).withColumns({n: F.col(n) * factor for n in ("open", "high", "low", "close")})


def wide_to_macro(wide: DataFrame, tickers, date: str = "Date", separator: str = "|") -> DataFrame:
    """Long macro values: adjusted close where the vendor has one, else close."""
    rows = []
    for ticker in tickers:
        present = _fields(wide, ticker, separator)
        source = present.get("Adj Close", present.get("Close"))
        if source is None:
            raise ValueError(f"Vendor frame has no price column for {ticker}.")
        rows.append(F.struct(F.lit(ticker).alias("ticker"), F.col(f"`{source}`").cast("double").alias("value")))
    long = wide.select(F.col(date).alias("date"), F.explode(F.array(*rows)).alias("r")).select("date", "r.*")
    return conform(long, MACRO, "macro")
