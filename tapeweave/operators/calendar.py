"""Rebalance calendars and open-to-open holding returns.

A calendar has one row per session at most, so it is broadcast; the unpartitioned windows
here run over distinct dates only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeweave.functions.windows import ratio
from tapeweave.sources.schema import enforce_ohlcv, enforce_returns, finite, require_columns

CALENDAR_COLUMNS = ("decision_date", "execution_date", "next_execution_date")


def _sessions(bars: DataFrame) -> DataFrame:
    return bars.select(F.col("date").cast("date").alias("decision_date")).distinct()


def align_to_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    require_columns(calendar, ["date"], "calendar")
    dates = calendar.select(F.col("date").cast("date").alias("date")).distinct()
    return enforce_ohlcv(bars).join(dates, "date", "left_semi")


def weekly_calendar(bars: DataFrame) -> DataFrame:
    """Last session of each ISO week, executed at the next session."""
    by_date = Window.orderBy("decision_date")
    sessions = _sessions(bars).withColumn("execution_date", F.lead("decision_date").over(by_date))
    ends = sessions.filter(F.date_trunc("week", "decision_date") != F.date_trunc("week", "execution_date"))
    return ends.withColumn("next_execution_date", F.lead("execution_date").over(by_date)).dropna()


def daily_calendar(bars: DataFrame) -> DataFrame:
    by_date = Window.orderBy("decision_date")
    return (
        _sessions(bars)
        .select(
            "decision_date",
            F.lead("decision_date", 1).over(by_date).alias("execution_date"),
            F.lead("decision_date", 2).over(by_date).alias("next_execution_date"),
        )
        .dropna()
    )


CALENDARS = {"daily": daily_calendar, "weekly": weekly_calendar}


def rebalance_calendar(bars: DataFrame, frequency: str) -> DataFrame:
    if frequency not in CALENDARS:
        raise ValueError(f"No calendar for {frequency!r}; known: {sorted(CALENDARS)}.")
    return CALENDARS[frequency](bars)


def valid_opens(bars: DataFrame) -> DataFrame:
    return enforce_ohlcv(bars).select("date", "ticker", "open").filter((F.col("open") > 0) & finite("open"))


def execution_prices(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Opens at each execution date (one calendar row to many tickers)."""
    opens = valid_opens(bars).withColumnRenamed("date", "execution_date")
    return opens.join(calendar.select(*CALENDAR_COLUMNS), "execution_date")


def open_to_open_returns(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Return from the execution open to the next execution open, per ticker.

    Bars are read once: the broadcast calendar tells each open which decision it enters and
    which it closes, and one combining aggregate per (decision date, ticker) pairs the two.
    """
    require_columns(calendar, CALENDAR_COLUMNS, "rebalance calendar")
    uses = calendar.select(
        *[F.col(c).cast("date").alias(c) for c in CALENDAR_COLUMNS]
    ).select(
        "*",
        F.inline(
            F.array(
                F.struct(F.col("execution_date").alias("date"), F.lit(True).alias("__enters")),
                F.struct(F.col("next_execution_date").alias("date"), F.lit(False).alias("__enters")),
            )
        ),
    )
    used = valid_opens(bars).join(uses, "date")
    paired = used.groupBy(*CALENDAR_COLUMNS, "ticker").agg(
        F.max(F.when(F.col("__enters"), F.col("open"))).alias("open"),
        F.max(F.when(~F.col("__enters"), F.col("open"))).alias("next_open"),
    )
    both = paired.filter(F.col("open").isNotNull() & F.col("next_open").isNotNull())
    return enforce_returns(both.withColumn("return", ratio(F.col("next_open"), F.col("open")) - 1))


def wide_returns(returns: DataFrame, tickers, value: str = "return", on: str = "decision_date") -> DataFrame:
    """Export form: one column per listed ticker."""
    return returns.groupBy(on).pivot("ticker", list(tickers)).agg(F.first(value, ignorenulls=True))


def decision_dates(table: DataFrame) -> DataFrame:
    """Decision dates from a calendar, from bars (weekly), or from plain dates (Fridays)."""
    names = set(table.columns)
    if "decision_date" in names:
        return table.select(F.col("decision_date").cast("date").alias("date"))
    if "date" not in names:
        raise ValueError(f"No date column among {sorted(names)}.")
    if {"ticker", "open", "high", "low", "close", "adj_close", "volume"} <= names:
        return weekly_calendar(table).select(F.col("decision_date").alias("date"))
    return (
        table.select(F.col("date").cast("date").alias("date")).distinct().filter(F.weekday("date") == 4)
    )


def keep_dates(table: DataFrame, dates: DataFrame, on: str = "date", dates_column: str | None = None) -> DataFrame:
    """Rows whose date is listed."""
    require_columns(table, [on], "table")
    wanted = dates.select(F.col(dates_column or on).cast("date").alias(on))
    return table.join(wanted, on, "left_semi")


def complete_cross_sections(
    calendar: DataFrame, returns: DataFrame, benchmark_returns: DataFrame, bars: DataFrame, required: int
) -> DataFrame:
    """Calendar rows where ``required`` tickers have a return and a valid close, and the benchmark a return."""
    with_returns = _dates_with(returns.withColumnRenamed("decision_date", "date"), required)
    with_closes = _dates_with(bars.filter((F.col("close") > 0) & finite("close")), required)
    with_benchmark = benchmark_returns.select(F.col("decision_date").alias("date")).distinct()
    out = calendar
    for dates in (with_returns, with_benchmark, with_closes):
        out = keep_dates(out, dates, "decision_date", "date")
    return out


def _dates_with(rows: DataFrame, required: int) -> DataFrame:
    return rows.groupBy("date").agg(F.count_distinct("ticker").alias("n")).filter(F.col("n") >= required).select("date")
