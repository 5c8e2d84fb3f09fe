"""Parquet and CSV tables, the bar cache, and the market bundle built from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tapeweave.sources.bars import benchmark_subset, trading_calendar
from tapeweave.sources.schema import OHLCV, enforce_ohlcv
from tapeweave.sources.universe import UniverseConfig
from tapeweave.sources.validation import validate_bars


@dataclass(frozen=True)
class MarketBundle:
    bars: DataFrame
    benchmark: DataFrame
    macro: DataFrame
    calendar: DataFrame


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return enforce_ohlcv(spark.read.schema(OHLCV).parquet(path))


def write_bars(bars: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write bars clustered by ticker and sorted by date.

    Readers that window by ticker get compressible, range-prunable files; ``partitions``
    defaults to the session's shuffle width.
    """
    keys = ["ticker"]
    spread = bars.repartition(partitions, *keys) if partitions else bars.repartition(*keys)
    spread.sortWithinPartitions("ticker", "date").write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def load_market(
    spark: SparkSession,
    cache: str,
    universe: UniverseConfig,
    ingest: Callable[[SparkSession], DataFrame],
    macro: DataFrame,
) -> MarketBundle:
    """Read cached bars, or ingest landed data and cache it; then validate and derive views."""
    if not path_exists(spark, cache):
        write_bars(enforce_ohlcv(ingest(spark)), cache)
    names = dict.fromkeys((*universe.selected, universe.benchmark_ticker))
    expected = spark.createDataFrame([(n,) for n in names], "ticker string")
    bars = validate_bars(read_bars(spark, cache), expected)
    return MarketBundle(
        bars=bars,
        benchmark=benchmark_subset(bars, universe.benchmark_ticker),
        macro=macro,
        calendar=trading_calendar(bars).orderBy("date"),
    )
