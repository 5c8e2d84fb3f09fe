"""Universe files and symbol lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def normalized(symbol: str | Column) -> Column:
    c = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.upper(F.trim(c))


def load_universe(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a newline or comma separated text file; tokens starting with # are skipped."""
    tokens = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("token"))
    return tokens.filter((F.trim("token") != "") & ~F.trim("token").startswith("#")).select(
        normalized("token").alias("ticker")
    )


def duplicate_symbols(symbols: DataFrame, column: str = "ticker") -> DataFrame:
    return (
        symbols.groupBy(normalized(column).alias("ticker")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    )


def first_positions(symbols: DataFrame, position: str = "position", column: str = "ticker") -> DataFrame:
    """Each symbol once, at its first position (ordered de-duplication)."""
    return symbols.groupBy(normalized(column).alias("ticker")).agg(F.min(position).alias("position"))


def select_universe(
    symbols: DataFrame, max_stocks: int | None = None, position: str = "position", column: str = "ticker"
) -> DataFrame:
    """Ordered unique symbols, optionally the first ``max_stocks`` of them."""
    unique = first_positions(symbols, position, column)
    return unique if max_stocks is None else unique.orderBy("position", "ticker").limit(max_stocks)


def validate_universe(symbols: DataFrame, expected_count: int | None = None, column: str = "ticker") -> DataFrame:
    out = symbols.select(normalized(column).alias("ticker"))
    if not out.filter(F.coalesce("ticker", F.lit("")) == "").isEmpty():
        raise ValueError("A universe cannot list a blank symbol.")
    repeated = [r.ticker for r in duplicate_symbols(out).orderBy("ticker").limit(20).collect()]
    if repeated:
        raise ValueError(f"Listed more than once: {repeated}.")
    if expected_count is not None and (n := out.count()) != expected_count:
        raise ValueError(f"The universe has {n} names instead of {expected_count}.")
    return out


@dataclass(frozen=True)
class UniverseConfig:
    """A configured list of symbols with its cash and benchmark names."""

    tickers: tuple[str, ...]
    max_stocks: int | None = None
    include_cash: bool = True
    cash_ticker: str = "CASH"
    benchmark_ticker: str = "SPY"

    @property
    def selected(self) -> tuple[str, ...]:
        names = [t.strip().upper() for t in self.tickers]
        if "" in names:
            raise ValueError("A universe cannot list a blank symbol.")
        return tuple(dict.fromkeys(names))[: self.max_stocks]

    @property
    def asset_count(self) -> int:
        return len(self.selected) + (1 if self.include_cash else 0)
