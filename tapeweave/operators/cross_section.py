"""Per-date (cross-sectional) ranks and standardization."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeweave.functions.groups import percentile_from_rank, with_average_ranks, with_stats
from tapeweave.functions.windows import Series, ratio
from tapeweave.operators.routing import RANK_SUFFIX
from tapeweave.sources.schema import require_columns


def percentile_rank(
    df: DataFrame, value: str, output: str | None = None, on: str = "date", wide: bool = False
) -> DataFrame:
    """Average-tie percentile rank within each date; nulls count in n and stay null."""
    return _percentile_ranks(df, {output or value + RANK_SUFFIX: value}, on, wide)


def _percentile_ranks(df: DataFrame, outputs: dict[str, str], on: str, wide: bool) -> DataFrame:
    require_columns(df, [on, *outputs.values()], "rank input")
    ranks = {f"__rank_{i}": (value, True) for i, value in enumerate(outputs.values())}
    out = with_stats(with_average_ranks(df, [on], ranks, wide), [on], wide, __n=F.count(F.lit(1)))
    scores = {o: percentile_from_rank(r, F.col("__n")) for o, r in zip(outputs, ranks)}
    return out.withColumns(scores).drop(*ranks, "__n")


def percentile_ranks(df: DataFrame, values, on: str = "date", wide: bool = False) -> DataFrame:
    """``percentile_rank`` of several columns at once.

    ``wide``: a date may hold more rows than a task should sort (see ``functions.groups``).
    """
    return _percentile_ranks(df, {v + RANK_SUFFIX: v for v in values}, on, wide)


def cross_sectional_zscore(
    df: DataFrame, value: str, output: str, on: str = "date", wide: bool = False
) -> DataFrame:
    """Population z-score within each date, 0 where the date has no spread."""
    out = with_stats(df, [on], wide, __mean=F.avg(value), __std=F.stddev_pop(value))
    scored = F.when(F.col("__std") > 0, (F.col(value) - F.col("__mean")) / F.nullif("__std", F.lit(0.0)))
    return out.withColumn(output, F.coalesce(scored, F.lit(0.0))).drop("__mean", "__std")


def sample_zscore_at(df: DataFrame, values, date) -> DataFrame:
    """Sample z-scores of one date's rows; no spread or a missing value gives 0."""
    day = df.filter(F.col("date") == F.lit(date).cast("date")).select("date", "ticker", *values)
    stats = {f"__m{i}": F.avg(v) for i, v in enumerate(values)} | {
        f"__s{i}": F.stddev_samp(v) for i, v in enumerate(values)
    }
    out = with_stats(day, ["date"], **stats)
    return out.select(
        "ticker",
        *[
            F.coalesce(ratio(F.col(v) - F.col(f"__m{i}"), F.col(f"__s{i}")), F.lit(0.0)).alias(v)
            for i, v in enumerate(values)
        ],
    )


def zscore_by_ticker(df: DataFrame, values) -> DataFrame:
    """Whole-history sample z-score per ticker; null where the ticker has no spread."""
    stats = {f"__m{i}": F.avg(v) for i, v in enumerate(values)} | {
        f"__s{i}": F.stddev_samp(v) for i, v in enumerate(values)
    }
    out = with_stats(df, ["ticker"], False, **stats)
    scored = {v: ratio(F.col(v) - F.col(f"__m{i}"), F.col(f"__s{i}")) for i, v in enumerate(values)}
    return out.withColumns(scored).select(*df.columns)


def smoothed(df: DataFrame, values, window: int) -> DataFrame:
    """Trailing mean per ticker; windows of one row or less leave the data as it is."""
    if not window or window <= 1:
        return df
    s = Series("ticker")
    out = s.number(df).withColumns({v: s.rolling(F.avg, v, window, 1) for v in values})
    return out.select(*df.columns)
