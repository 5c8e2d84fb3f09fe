"""Tables behind the reports: holdings over time, dominant regimes, long forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tapeweave.operators.weights import CASH

# Sampling frequencies and the period they truncate to.
FREQUENCIES = {"D": "day", "W": "week", "M": "month", "ME": "month", "Q": "quarter", "QE": "quarter", "Y": "year", "YE": "year"}


def _risky(weights: DataFrame, include_cash: bool) -> DataFrame:
    return weights if include_cash else weights.filter(F.col("ticker") != CASH)


def top_names(weights: DataFrame, n: int, include_cash: bool = True) -> DataFrame:
    """The ``n`` names with the largest mean weight over all dates of their table."""
    if n <= 0:
        raise ValueError("top_n must be positive.")
    means = _risky(weights, include_cash).groupBy("ticker").agg(F.avg("weight").alias("mean_weight"))
    return means.orderBy(F.col("mean_weight").desc(), "ticker").limit(n)


def resampled(weights: DataFrame, frequency: str, keys=("portfolio_id", "ticker")) -> DataFrame:
    """Last weight of each period, dated by the period's start."""
    if frequency.upper() not in FREQUENCIES:
        raise ValueError(f"Unknown frequency: {frequency}")
    period = F.date_trunc(FREQUENCIES[frequency.upper()], "decision_date").cast("date")
    return weights.groupBy(*keys, period.alias("period")).agg(F.max_by("weight", "decision_date").alias("weight"))


def active_names(
    weights: DataFrame, threshold: float = 0.001, top_n: int | None = None, include_cash: bool = False
) -> DataFrame:
    """Names whose absolute weight ever exceeds ``threshold``, with their summed use."""
    if threshold < 0:
        raise ValueError("threshold must be non-negative.")
    used = (
        _risky(weights, include_cash)
        .groupBy("ticker")
        .agg(F.max(F.abs("weight")).alias("largest"), F.sum(F.abs("weight")).alias("usage"))
        .filter(F.col("largest") > threshold)
    )
    return used if top_n is None else used.orderBy(F.col("usage").desc(), "ticker").limit(top_n)


def dominant_regime(curve: DataFrame, probabilities: DataFrame, regimes, on: str = "decision_date") -> DataFrame:
    """Join regime probabilities by date and name the largest; the first listed wins ties."""
    joined = curve.join(probabilities.select(on, *regimes), on)
    best = F.greatest(*[F.col(r) for r in regimes]) if len(regimes) > 1 else F.col(regimes[0])
    name = reduce(lambda c, r: c.when(F.col(r) == best, r), regimes[1:], F.when(F.col(regimes[0]) == best, regimes[0]))
    return joined.withColumn("dominant_regime", name)


def long_form(table: DataFrame, columns, ids=("decision_date",), name: str = "feature", value: str = "value") -> DataFrame:
    missing = sorted(set(columns) - set(table.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return table.unpivot(list(ids), list(columns), name, value)


def latest_rows(features: DataFrame, columns) -> DataFrame:
    """Each ticker's most recent row, found with a combining aggregate."""
    last = F.max_by(F.struct("date", *columns), F.col("date")).alias("r")
    return features.groupBy("ticker").agg(last).select("ticker", "r.*")


def latest_ranking(features: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    by = F.col(column).asc() if ascending else F.col(column).desc()
    return latest_rows(features, [column]).filter(F.col(column).isNotNull()).orderBy(by, "ticker")
