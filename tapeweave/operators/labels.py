"""Forward labels. Labels may read the future; features never do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeweave.config import EventLabelConfig, check_horizons
from tapeweave.functions.windows import POSITION, Series, ratio
from tapeweave.sources.schema import finite

GAPS = ("close_ema20_gap", "close_ema50_gap", "close_vwap20_gap")


def compounded_ahead(s: Series, value: str, horizon: int) -> Column:
    """Compounded return of this row and the next ``horizon - 1``; null without a whole path."""
    path = s.rows.rowsBetween(0, horizon - 1)
    grown = F.product(1 + F.col(value)).over(path) - 1
    return F.when(F.count(value).over(path) == horizon, grown)


def forward_return_targets(
    returns: DataFrame, horizons=(5, 20, 60), weights=None, value: str = "return", on: str = "decision_date",
    keys=("ticker",),
) -> DataFrame:
    """Weighted compounded forward return per row; rows without the longest horizon are dropped."""
    weights = tuple(weights) if weights is not None else (1.0,) * len(horizons)
    check_horizons(horizons, weights)
    total = sum(weights)
    s = Series(*keys, order=on)
    df = s.number(returns)
    parts = {f"__h{h}": compounded_ahead(s, value, h) for h in horizons}
    df = df.withColumns(parts)
    target = sum((F.col(f"__h{h}") * (w / total) for h, w in zip(horizons, weights)), F.lit(0.0))
    return df.filter(F.col(f"__h{horizons[-1]}").isNotNull()).select(*keys, on, target.alias("target"))


def label_input_problems(rows: DataFrame, value: str = "return") -> DataFrame:
    """Counts of unusable label inputs (non-finite numbers, non-positive closes)."""
    checks = {n: F.count_if(~F.coalesce(finite(n), F.lit(False))) for n in (value, "close", *GAPS)}
    return rows.agg(
        *[c.alias(f"bad_{n}") for n, c in checks.items()], F.count_if(F.col("close") <= 0).alias("bad_price")
    )


def check_label_inputs(rows: DataFrame, value: str = "return") -> DataFrame:
    found = {k: v for k, v in label_input_problems(rows, value).first().asDict().items() if v}
    if found:
        raise ValueError(f"Returns and label inputs must be finite and prices positive: {found}")
    return rows


def event_labels(
    rows: DataFrame, cfg: EventLabelConfig, value: str = "return", on: str = "decision_date", keys=("ticker",)
) -> DataFrame:
    """Buy, hold and sell labels from line crossings and the path that follows them.

    ``rows`` holds one row per series and decision date: the return, the close and its gaps to
    the two averages and the VWAP. The worst point of the path is the smallest prefix sum of
    log growth ahead minus the prefix before it. Rows without a whole path are dropped;
    ``valid`` is false on a series' first row, which has nothing to cross from.
    """
    s = Series(*keys, order=on)
    h = cfg.outcome_horizon
    df = s.number(rows).withColumn("__growth", F.log1p(value))
    df = df.withColumns(
        {"__prefix": s.running(F.sum, "__growth"), **{f"__prev_{g}": s.lag(g) for g in GAPS}}
    )
    path = s.rows.rowsBetween(0, h - 1)
    worst = F.exp(F.min("__prefix").over(path) - (F.col("__prefix") - F.col("__growth"))) - 1
    df = df.withColumns({"__end": compounded_ahead(s, value, h), "__worst": worst})

    def any_line(test):
        hits = [F.coalesce(test(F.col(g), F.col(f"__prev_{g}")), F.lit(False)) for g in GAPS]
        return hits[0] | hits[1] | hits[2]

    rises = any_line(lambda now, before: (now > 0) & (before <= 0))
    falls = any_line(lambda now, before: (now < 0) & (before >= 0))
    holds = (
        (F.col("close_ema20_gap") >= 0)
        | (F.col("close_vwap20_gap") >= 0)
        | (F.col("close_ema50_gap") >= -cfg.ema50_epsilon * F.col("close"))
    )
    return df.filter(F.col("__end").isNotNull()).select(
        *keys,
        on,
        (rises & (F.col("__end") >= cfg.buy_min_return + cfg.round_trip_cost)).alias("buy"),
        holds.alias("hold"),
        (falls & (F.col("__worst") <= -(cfg.sell_min_drawdown + cfg.round_trip_cost))).alias("sell"),
        (F.col(POSITION) > 0).alias("valid"),
    )


def study_labels(bars: DataFrame, return_horizons=(5, 20, 60, 120), drawdown_horizons=(5, 20, 60, 120)) -> DataFrame:
    """Future return and future worst return over each horizon, from closes."""
    s = Series("ticker")
    df = s.number(bars)
    labels = {f"future_return_{h}d": ratio(s.lead("close", h), F.col("close")) - 1 for h in return_horizons}
    for h in drawdown_horizons:
        labels[f"future_max_drawdown_{h}d"] = ratio(F.min("close").over(s.ahead(h)), F.col("close")) - 1
    return df.withColumns(labels).select("date", "ticker", *labels)


def study_label_names(return_horizons=(5, 20, 60, 120), drawdown_horizons=(5, 20, 60, 120)) -> tuple[str, ...]:
    return tuple(f"future_return_{h}d" for h in return_horizons) + tuple(
        f"future_max_drawdown_{h}d" for h in drawdown_horizons
    )
