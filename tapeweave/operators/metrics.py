"""Performance statistics, stress, capacity and release checks over period returns.

``periods``: portfolio keys, decision_date, ``net_return``, ``benchmark_return`` and optionally
``turnover`` and ``transaction_cost``; one row per portfolio and date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

METRICS = (
    "cumulative_return", "annualized_return", "volatility", "max_drawdown", "mean_turnover",
    "total_transaction_cost", "relative_alpha", "sharpe_ratio", "sortino_ratio", "calmar_ratio",
    "tracking_error", "information_ratio", "beta", "regression_alpha",
)


def equity_curve(periods: DataFrame, keys=("portfolio_id",), value: str = "net_return") -> DataFrame:
    """Growth of one unit, compounded by date within the keys."""
    w = Window.partitionBy(*keys).orderBy("decision_date").rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn("equity", F.product(1 + F.col(value)).over(w))


def drawdown_curve(curve: DataFrame, keys=("portfolio_id",)) -> DataFrame:
    """Distance below the running maximum of the curve itself (the start value is not a peak)."""
    w = Window.partitionBy(*keys).orderBy("decision_date").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("drawdown", 1 - F.try_divide(F.col("equity"), F.max("equity").over(w)))


def _or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / F.nullif(den, F.lit(0.0))).otherwise(0.0)


def performance(periods: DataFrame, periods_per_year: int, keys=("portfolio_id",)) -> DataFrame:
    """The 14 metrics per key. A zero denominator gives 0."""
    if periods_per_year <= 0:
        raise ValueError(f"A year cannot hold {periods_per_year} periods.")
    p, root = float(periods_per_year), math.sqrt(periods_per_year)
    for name in ("turnover", "transaction_cost"):
        if name not in periods.columns:
            periods = periods.withColumn(name, F.lit(0.0))
    r, b = F.col("net_return"), F.col("benchmark_return")
    loss = F.least(r, F.lit(0.0))
    facts = (
        drawdown_curve(equity_curve(periods, keys), keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by("equity", "decision_date").alias("grown"),
            F.product(1 + b).alias("b_grown"),
            F.avg(r).alias("mean"),
            F.stddev_pop(r).alias("sd"),
            F.avg(b).alias("b_mean"),
            F.var_pop(b).alias("b_var"),
            F.covar_pop("net_return", "benchmark_return").alias("cov"),
            F.sqrt(F.avg(loss * loss)).alias("down"),
            F.avg(r - b).alias("active"),
            F.stddev_pop(r - b).alias("active_sd"),
            F.max("drawdown").alias("max_drawdown"),
            F.avg("turnover").alias("mean_turnover"),
            F.sum("transaction_cost").alias("total_transaction_cost"),
        )
    )
    c = F.col
    facts = facts.withColumns(
        {
            "cumulative_return": c("grown") - 1,
            "annualized_return": F.pow(c("grown"), p / c("n")) - 1,
            "volatility": c("sd") * root,
            "relative_alpha": c("grown") - c("b_grown"),
            "sharpe_ratio": _or_zero(c("mean"), c("sd")) * root,
            "sortino_ratio": _or_zero(c("mean") * p, c("down") * root),
            "tracking_error": c("active_sd") * root,
            "information_ratio": _or_zero(c("active") * p, c("active_sd") * root),
            "beta": _or_zero(c("cov"), c("b_var")),
        }
    )
    facts = facts.withColumns(
        {
            "calmar_ratio": _or_zero(c("annualized_return"), c("max_drawdown")),
            "regression_alpha": (c("mean") - c("beta") * c("b_mean")) * p,
        }
    )
    return facts.select(*keys, *METRICS)


def with_benchmark_portfolio(periods: DataFrame, name: str = "BENCHMARK") -> DataFrame:
    """Add the benchmark as a portfolio of its own, measured against itself without costs."""
    spare = [k for k in periods.columns if k not in ("portfolio_id", "net_return", "turnover", "transaction_cost")]
    own = periods.select(*spare).distinct().select(
        "*", F.lit(name).alias("portfolio_id"), F.col("benchmark_return").alias("net_return"),
        F.lit(0.0).alias("turnover"), F.lit(0.0).alias("transaction_cost"),
    )
    return periods.unionByName(own.select(*periods.columns))


def split_metrics_table(periods: DataFrame, splits: DataFrame, periods_per_year: int) -> DataFrame:
    """Per split: test bounds, portfolio metrics and the benchmark's cumulative return."""
    mine = performance(periods, periods_per_year, ("portfolio_id", "split_index"))
    against = (
        periods.groupBy("portfolio_id", "split_index")
        .agg((F.product(1 + F.col("benchmark_return")) - 1).alias("benchmark_cumulative_return"))
    )
    bounds = F.broadcast(splits.select("split_index", "test_start", "test_end"))
    renamed = [
        F.col(m).alias("portfolio_" + m if m not in ("relative_alpha", "tracking_error", "information_ratio", "beta", "regression_alpha") else m)
        for m in METRICS
        if m not in ("annualized_return", "volatility")
    ]
    return (
        mine.join(against, ["portfolio_id", "split_index"])
        .join(bounds, "split_index")
        .select("portfolio_id", "split_index", "test_start", "test_end", "benchmark_cumulative_return", *renamed)
    )


STRESS_MULTIPLIERS = (0.5, 1.0, 2.0, 3.0)


def stressed(periods: DataFrame, multipliers=STRESS_MULTIPLIERS) -> DataFrame:
    """Each period once per cost multiplier, net of the scaled cost."""
    if any(m < 0 or not math.isfinite(m) for m in multipliers):
        raise ValueError(f"Costs cannot be scaled by {list(multipliers)}.")
    m = F.col("multiplier")
    out = periods.withColumn("multiplier", F.explode(F.array(*[F.lit(float(x)) for x in multipliers])))
    return out.withColumn("net_return", F.col("net_return") + F.col("transaction_cost") * (1 - m)).withColumn(
        "transaction_cost", F.col("transaction_cost") * m
    )


def cost_stress(periods: DataFrame, periods_per_year: int, multipliers=STRESS_MULTIPLIERS) -> DataFrame:
    return performance(stressed(periods, multipliers), periods_per_year, ("portfolio_id", "multiplier"))


def delayed_returns(periods: DataFrame, delay: int = 1, value: str = "net_return") -> DataFrame:
    """Shift a return stream by ``delay`` periods with zeros in front."""
    if delay < 0:
        raise ValueError("delay must be non-negative.")
    w = Window.partitionBy("portfolio_id").orderBy("decision_date")
    shifted = F.col(value) if delay == 0 else F.lag(value, delay, 0.0).over(w)
    return periods.withColumn("delayed_return", shifted)


def capacity(volumes: DataFrame, participation: float = 0.10, keys=(), value: str = "dollar_volume") -> DataFrame:
    """Mean dollar volume times the participation limit."""
    if not 0 < participation <= 1:
        raise ValueError("participation must be in (0, 1].")
    grouped = volumes.groupBy(*keys)
    return grouped.agg(F.avg(value).alias("average_dollar_volume")).withColumns(
        {
            "participation_limit": F.lit(participation),
            "estimated_capacity": F.col("average_dollar_volume") * participation,
        }
    )


def block_metrics(periods: DataFrame, periods_per_year: int, block: int) -> DataFrame:
    """Metrics of contiguous blocks of ``block`` periods; an incomplete tail is dropped."""
    if block <= 0:
        raise ValueError("block must be positive.")
    w = Window.partitionBy("portfolio_id").orderBy("decision_date")
    placed = periods.withColumn("block", F.floor((F.row_number().over(w) - 1) / block))
    whole = placed.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("portfolio_id", "block")))
    flat = whole.filter(F.col("__n") == block).withColumns({"turnover": F.lit(0.0), "transaction_cost": F.lit(0.0)})
    return performance(flat, periods_per_year, ("portfolio_id", "block"))


def release_gate(max_drawdown: float, min_information_ratio: float = 0.0) -> Column:
    if max_drawdown < 0:
        raise ValueError("A drawdown limit is at least 0.")
    return (F.col("max_drawdown") <= max_drawdown) & (F.col("information_ratio") >= min_information_ratio)


def release_validation(
    periods: DataFrame, periods_per_year: int, max_drawdown: float, min_information_ratio: float = 0.0
) -> DataFrame:
    """Per portfolio: whether the base case and every cost multiple from 2 up pass the gate."""
    gate = release_gate(max_drawdown, min_information_ratio)
    base = performance(periods, periods_per_year).select("portfolio_id", F.lit(1.0).alias("multiplier"), gate.alias("ok"))
    harder = [m for m in STRESS_MULTIPLIERS if m >= 2]
    stress = cost_stress(periods, periods_per_year, harder).select("portfolio_id", "multiplier", gate.alias("ok"))
    return base.unionByName(stress).groupBy("portfolio_id").agg(
        F.min(F.when(F.col("multiplier") == 1, F.col("ok"))).alias("base_passed"), F.every("ok").alias("passed")
    )
