"""Supervised tables: validity, completeness, pooling and class balance."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tapeweave.operators.routing import EVENT_MODEL, route
from tapeweave.sources.schema import finite

LABELS = ("buy", "hold", "sell")


def all_finite(names) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(finite(n), F.lit(False)) for n in names])


def incomplete_dates(rows: DataFrame, tickers: DataFrame, on: str = "date") -> DataFrame:
    """Dates without exactly one row for every ticker of the list."""
    size = tickers.select("ticker").distinct().agg(F.count(F.lit(1)).alias("expected"))
    per_date = rows.groupBy(on).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"))
    return per_date.join(F.broadcast(size)).filter(
        (F.col("rows") != F.col("expected")) | (F.col("tickers") != F.col("expected"))
    )


def feature_panel(rows: DataFrame, names, tickers: DataFrame | None = None, on: str = "date") -> DataFrame:
    """Routed features with nulls as 0; incomplete dates and non-finite values are errors."""
    out = route(rows, names, (on, "ticker"))
    columns = [c for c in out.columns if c not in (on, "ticker")]
    if tickers is not None and (bad := incomplete_dates(out, tickers, on).orderBy(on).first()):
        raise ValueError(f"{bad[on]} does not have every listed ticker exactly once.")
    out = out.fillna(0.0, columns)
    if not out.filter(~all_finite(columns)).isEmpty():
        raise ValueError("A routed feature is infinite or not a number.")
    return out


def event_panel(rows: DataFrame, on: str = "date") -> DataFrame:
    """The event model's features, non-finite values as 0, and whether the row was whole before."""
    out = route(rows, EVENT_MODEL, (on, "ticker")).withColumn("feature_valid", all_finite(EVENT_MODEL))
    return out.withColumns({n: F.when(finite(n), F.col(n)).otherwise(0.0) for n in EVENT_MODEL})


def pooled_training_rows(rows: DataFrame, *masks: str) -> DataFrame:
    """Rows on which every mask holds; a table without one gives none."""
    return rows.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(m), F.lit(False)) for m in masks]))


def class_counts(rows: DataFrame, labels=LABELS, keys=()) -> DataFrame:
    """Positive count per label and the row count, per key."""
    sums = [F.count_if(F.col(n)).alias(f"__{n}") for n in labels]
    grouped = rows.groupBy(*keys) if keys else rows
    return grouped.agg(F.count(F.lit(1)).alias("__rows"), *sums)


def balanced_weights(rows: DataFrame, labels=LABELS, keys=()) -> DataFrame:
    """Add ``<label>_weight`` = rows / (2 x rows of the class); an empty class is an error, a table without rows is not.

    Two counts per label are aggregated map-side; class groups, however lopsided, never move.
    """
    counts = class_counts(rows, labels, keys)
    empty = reduce(
        lambda a, b: a | b, [(F.col(f"__{n}") == 0) | (F.col(f"__{n}") == F.col("__rows")) for n in labels]
    )
    if not counts.filter(empty & (F.col("__rows") > 0)).isEmpty():
        raise ValueError("A label has only one class, so its classes cannot be balanced.")
    joined = rows.join(counts, list(keys)) if keys else rows.join(F.broadcast(counts))
    size = lambda n: F.when(F.col(n), F.col(f"__{n}")).otherwise(F.col("__rows") - F.col(f"__{n}"))
    weights = {f"{n}_weight": F.col("__rows") / (2.0 * size(n)) for n in labels}
    return joined.withColumns(weights).drop("__rows", *[f"__{n}" for n in labels])


def assembled(rows: DataFrame, names, output: str = "features") -> DataFrame:
    """Feature vector in the given column order; a null or NaN is an error when it is read."""
    return VectorAssembler(inputCols=list(names), outputCol=output, handleInvalid="error").transform(rows)


def unaligned_dates(dates: DataFrame, rows: DataFrame, value: str, on: str = "decision_date", name: str = "ticker") -> DataFrame:
    """Dates on which a value is missing: no row at all, a null, or no row for a name that other dates have."""
    named = name in rows.columns
    cell = F.col(name) if named else F.lit(1)
    wanted = rows.agg((F.count_distinct(cell) if named else F.lit(1)).alias("__wanted"))
    present = rows.filter(F.col(value).isNotNull()).groupBy(on).agg(F.count_distinct(cell).alias("__present"))
    nulls = rows.filter(F.col(value).isNull()).select(on).distinct().withColumn("__null", F.lit(True))
    seen = dates.select(on).distinct().join(present, on, "left").join(nulls, on, "left")
    # one row
    seen = seen.join(F.broadcast(wanted), F.lit(True))
    short = F.coalesce("__present", F.lit(0)) < F.greatest("__wanted", F.lit(1))
    return seen.filter(short | F.col("__null").isNotNull()).select(on)


def aligned_or_error(dates: DataFrame, rows: DataFrame, value: str, on: str = "decision_date") -> DataFrame:
    """Left join on dates that refuses missing cells: every date needs a value for every name of ``rows``."""
    if bad := unaligned_dates(dates, rows, value, on).orderBy(on).first():
        raise ValueError(f"{value} is incomplete on {bad[on]}.")
    return dates.select(on).join(rows, on, "left")


def one_to_one_lookup(rows: DataFrame, lookup: DataFrame, keys) -> DataFrame:
    """Left join on ``keys`` with a lookup that must be unique on them."""
    if not lookup.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"Two lookup rows share their {list(keys)}.")
    return rows.join(lookup, list(keys), "left")


def study_dataset(features: DataFrame, labels: DataFrame, feature_names, label_names) -> DataFrame:
    """Features joined to forward labels; rows with any missing or non-finite number are dropped."""
    wanted = (*feature_names, *label_names)
    joined = features.select("date", "ticker", "close", *feature_names).join(
        labels.select("date", "ticker", *label_names), ["date", "ticker"]
    )
    return joined.filter(all_finite(wanted))
