"""Bar tables bucketed by ticker: the shuffle by ticker is paid once, when the table is written.

The files lie under a path of the caller's; the catalog only knows where, and in how many buckets. A
session whose catalog has forgotten the table (the in-memory one does) attaches it again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tapeweave.functions.windows import Series
from tapeweave.sources.schema import OHLCV, enforce_ohlcv

KEY = "ticker"


def write_bucketed(bars: DataFrame, name: str, path: str, buckets: int) -> None:
    """Write ``bars`` as table ``name``: one file per bucket, sorted by ticker and date.

    Choose ``buckets`` by the size of the table (some 256 MB each); a bucket is read by one task, and the
    longest ticker is bounded by the calendar. The table must not exist yet in this catalog.
    """
    _checked(name, buckets)
    rows = enforce_ohlcv(bars).repartition(buckets, KEY)  # the buckets' own hash: every task writes one file
    rows.write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY, "date").option("path", path).saveAsTable(name)


def attach_bucketed(spark: SparkSession, name: str, path: str, buckets: int) -> None:
    """Make files of ``write_bucketed`` known to this session's catalog, with the number of buckets they were written in."""
    _checked(name, buckets)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OHLCV.fields)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}, date) "
        f"INTO {buckets} BUCKETS LOCATION '{where}'"
    )


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """The bars; an error if windows by ticker over them would shuffle all the same."""
    bars = enforce_ohlcv(spark.table(name))
    if shuffles(Series(KEY).number(bars)):
        raise ValueError(f"Table {name} does not spare the shuffle by {KEY}: it is not bucketed by it, or bucketed scans are off.")
    return bars


def shuffles(df: DataFrame) -> int:
    """Number of exchanges in the physical plan as it stands before execution."""
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def _checked(name: str, buckets: int) -> None:
    if not re.fullmatch(r"\w+(\.\w+)*", name):
        raise ValueError(f"{name!r} is no table name.")
    if buckets < 1:
        raise ValueError("A table has at least one bucket.")
