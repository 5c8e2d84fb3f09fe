"""Registration, shared views of the driver tables, and number formatting for comparison.

Prices in the driver tables are random, so values span many magnitudes. Both engines print a
value with six significant digits and read it back. Noise below 1e-8 reads as zero, and a
relative nudge of 1e-9 settles exact decimal ties the same way in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeweave.sources.bars import readings_to_macro, trades_to_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def add(name: str, fn, sql: str | None = None) -> None:
    case(name, sql)(fn)


NUDGE = 1.000000001


def sig(x: str | Column, alias: str | None = None) -> Column:
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    text = F.format_string("%.5e", F.when(F.abs(c) < 1e-8, 0.0).otherwise(c * NUDGE))
    return F.when(c.isNotNull(), text.cast("double")).alias(alias or x)


def sig_sql(x: str, alias: str | None = None) -> str:
    v = f"CAST(({x}) AS DOUBLE)"
    return (
        f"CASE WHEN ({x}) IS NOT NULL THEN CAST(printf('%.5e', CASE WHEN abs({v}) < 1e-8 THEN 0e0 "
        f"ELSE {v} * CAST({NUDGE} AS DOUBLE) END) AS DOUBLE) END AS {alias or x}"
    )


def sigs(*names: str) -> list[Column]:
    return [sig(n) for n in names]


def sigs_sql(*names: str) -> str:
    return ", ".join(sig_sql(n) for n in names)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("p_brand").alias("ticker"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        "l_orderkey",
        "l_linenumber",
    )


SEQUENCE = ["l_orderkey", "l_linenumber", "price", "volume"]


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return trades_to_bars(trades(spark, sf), SEQUENCE)


def bench(spark: SparkSession, sf: str) -> DataFrame:
    return trades_to_bars(trades(spark, sf), SEQUENCE, F.lit("MKT"))


def macro(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("ts", F.col("event_type").alias("series"), "value")
    return readings_to_macro(events, "hour")


BARS = """trades AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker, l_extendedprice / l_quantity AS price,
         l_quantity AS qty, l_orderkey AS ok, l_linenumber AS ln
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT date, ticker, first(price ORDER BY ok, ln, price, qty) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ok, ln, price, qty) AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM trades GROUP BY date, ticker)"""
BENCH = """bench AS (
  SELECT date, first(price ORDER BY ok, ln, price, qty) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ok, ln, price, qty) AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM trades GROUP BY date)"""
WEEKLY = """sessions AS (SELECT date AS decision_date, lead(date) OVER (ORDER BY date) AS execution_date
  FROM (SELECT DISTINCT date FROM bars)),
weekly AS (SELECT * FROM (SELECT *, lead(execution_date) OVER (ORDER BY decision_date) AS next_execution_date
  FROM sessions WHERE execution_date IS NOT NULL
    AND date_trunc('week', decision_date) <> date_trunc('week', execution_date))
  WHERE next_execution_date IS NOT NULL)"""
RETURNS = """returns AS (SELECT w.*, a.ticker, a.open, z.open AS next_open, z.open / a.open - 1 AS ret
  FROM weekly w JOIN bars a ON a.date = w.execution_date
  JOIN bars z ON z.date = w.next_execution_date AND z.ticker = a.ticker WHERE a.open > 0 AND z.open > 0)"""
MACRO = """macro AS (SELECT date_trunc('hour', ts) AS date, event_type AS ticker, avg(value) AS value
  FROM events GROUP BY 1, 2)"""


def with_sql(*ctes: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes)
