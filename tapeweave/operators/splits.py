"""Annual walk-forward splits as a table, and range joins that fan rows out to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeweave.config import WalkForwardConfig

BOUNDS = ("train_start", "train_end", "test_start", "test_end")


def split_calendar(dates: DataFrame) -> DataFrame:
    """Decision, execution and next execution date from a calendar or a plain date list."""
    names = dates.columns
    if "decision_date" not in names and "date" not in names:
        raise ValueError(f"No date column among {sorted(names)}.")
    source = "decision_date" if "decision_date" in names else "date"
    execution = "execution_date" if "decision_date" in names and "execution_date" in names else source
    out = dates.select(
        F.col(source).cast("date").alias("decision_date"),
        F.col(execution).cast("date").alias("execution_date"),
        *([F.col("next_execution_date").cast("date")] if "next_execution_date" in names else []),
    )
    if source == "date":
        out = out.distinct()
    if "next_execution_date" not in out.columns:
        following = F.lead("execution_date").over(Window.orderBy("decision_date"))
        out = out.withColumn("next_execution_date", following)
    return out.dropna()


def walk_forward_splits(dates: DataFrame, cfg: WalkForwardConfig) -> DataFrame:
    """One row per split: index and inclusive bounds; splits with an empty side are left out.

    A split is generated while its last test year starts inside the calendar. The table has
    at most one row per calendar year.
    """
    calendar = split_calendar(dates)
    years = calendar.agg(
        F.min(F.year("decision_date")).alias("first"), F.max(F.year("decision_date")).alias("last")
    )
    span = cfg.train_years + cfg.test_years
    count = F.floor((F.col("last") - F.col("first") + 1 - span) / cfg.step_years)
    raw = years.filter(F.col("last") - F.col("first") + 1 >= span).select(
        "first", F.explode(F.sequence(F.lit(0), count.cast("int"))).alias("number")
    )
    shift = F.col("number") * cfg.step_years
    begin = F.col("first") if cfg.expanding else F.col("first") + shift
    end = F.col("first") + shift + cfg.train_years - 1
    day = lambda y, m, d: F.make_date(y.cast("int"), F.lit(m), F.lit(d))
    bounds = raw.select(
        "number",
        day(begin, 1, 1).alias("train_start"),
        day(end, 12, 31).alias("train_end"),
        day(end + 1, 1, 1).alias("test_start"),
        day(end + cfg.test_years, 12, 31).alias("test_end"),
    )
    d = F.col("decision_date")
    sides = (
        calendar.join(F.broadcast(bounds), d.between(F.col("train_start"), F.col("test_end")))
        .groupBy("number", *BOUNDS)
        .agg(
            F.count_if(d <= F.col("train_end")).alias("train_dates"),
            F.count_if(d >= F.col("test_start")).alias("test_dates"),
        )
        .filter("train_dates > 0 AND test_dates > 0")
    )
    index = F.row_number().over(Window.orderBy("number")) - 1
    return sides.select(index.alias("split_index"), *BOUNDS, "train_dates", "test_dates")


def split_violations(splits: DataFrame) -> DataFrame:
    """Splits whose bounds are out of order."""
    return splits.filter(
        (F.col("train_start") > F.col("train_end"))
        | (F.col("test_start") > F.col("test_end"))
        | (F.col("train_end") >= F.col("test_start"))
    )


def check_splits(splits: DataFrame) -> DataFrame:
    if not split_violations(splits).isEmpty():
        raise ValueError("A split tests on days that it also trains on.")
    return splits


def assign_splits(rows: DataFrame, splits: DataFrame, on: str = "date") -> DataFrame:
    """Every row once per split that uses it, tagged ``split_index`` and ``role``.

    The splits table is a few rows long, so the range join is a broadcast loop without a shuffle.
    """
    d = F.col(on)
    bounds = F.broadcast(splits.select("split_index", *BOUNDS))
    joined = rows.join(bounds, d.between(F.col("train_start"), F.col("test_end")))
    role = F.when(d <= F.col("train_end"), "train").when(d >= F.col("test_start"), "test")
    return joined.withColumn("role", role).filter(F.col("role").isNotNull()).drop(*BOUNDS)


def purge_train_tail(rows: DataFrame, horizon: int, on: str = "date", keys=("split_index", "ticker")) -> DataFrame:
    """Drop the last ``horizon - 1`` train rows per split and ticker: their labels reach past the window."""
    if horizon <= 0:
        raise ValueError("horizon must be positive.")
    from_end = F.row_number().over(Window.partitionBy(*keys, "role").orderBy(F.col(on).desc()))
    kept = rows.withColumn("__from_end", from_end)
    return kept.filter((F.col("role") != "train") | (F.col("__from_end") > horizon - 1)).drop("__from_end")
