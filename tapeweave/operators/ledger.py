"""Portfolio accounting over long weights: drift, turnover, costs, value, drawdown and reward.

What is executed depends only on the targets, and drift only on the row before, so the whole
history is a set of joins and aggregates; value and peak are windows over one row per
portfolio and date. Two things are truly path-dependent and stream: capped holdings over dates
without usable targets, and costs that depend on the portfolio's value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tapeweave.config import LedgerConfig, RewardConfig
from tapeweave.functions.groups import with_stats
from tapeweave.functions.sequential import stream_portfolios
from tapeweave.operators.weights import CASH, KEYS, cap_to_cash, is_cash, keep_top_n, normalize, with_cash
from tapeweave.sources.schema import finite

WEIGHT_SCHEMA = "portfolio_id string, decision_date date, ticker string, weight double"


def by_portfolio() -> WindowSpec:
    return Window.partitionBy("portfolio_id").orderBy("decision_date")


def constrained(weights: DataFrame, cfg: LedgerConfig, wide: bool = False) -> DataFrame:
    """Normalize, keep the top N, cap - in the order trades are executed."""
    out = normalize(with_cash(weights, wide=wide), wide=wide)
    if cfg.top_n is not None:
        out = keep_top_n(out, cfg.top_n, wide=wide)
    if cfg.max_position_weight is not None:
        out = cap_to_cash(out, cfg.max_position_weight, wide=wide)
    return out


def stretches(rows: DataFrame) -> DataFrame:
    """Per portfolio and date: whether its targets are usable, and the stretch that it belongs to.

    A stretch opens (``__since``) on a usable date, or on the portfolio's first one, and lasts until
    the next opens; ``__place`` counts its dates from 1 to ``__length``. Targets are unusable with
    a weight that is not finite or without positive weight.
    """
    ok = F.coalesce(finite("weight"), F.lit(False))
    mass = F.sum(F.when(ok, F.greatest("weight", F.lit(0.0))).otherwise(0.0))
    dates = rows.groupBy(*KEYS).agg((F.min(ok) & (mass > 0)).alias("__usable"), F.count(F.lit(1)).alias("__names"))
    opens = F.col("__usable") | (F.row_number().over(by_portfolio()) == 1)
    dates = dates.withColumn("__opens", F.when(opens, F.col("decision_date")))
    dates = dates.withColumn("__since", F.max("__opens").over(by_portfolio())).drop("__opens")
    stretch = Window.partitionBy("portfolio_id", "__since")
    return dates.withColumns(
        {"__place": F.row_number().over(stretch.orderBy("decision_date")), "__length": F.count(F.lit(1)).over(stretch)}
    )


def executed_weights(
    targets: DataFrame, returns: DataFrame, cfg: LedgerConfig, checked: bool = False, wide: bool = False
) -> DataFrame:
    """Executable weights; an unusable target keeps the current (drifted) holdings.

    Holdings on an unusable date depend on the last usable one alone: its executed weights, each
    grown by its returns since, as shares of their sum. A name that is not listed on a date in
    between is gone, and holdings that lost everything become cash. So stretches of dates are
    windows by name. Only a cap couples the names of a stretch; with one, stretches longer than a
    date are streamed, each on its own. ``checked`` skips all this when the caller built the
    weights itself.
    """
    if checked:
        return constrained(targets, cfg, wide)
    rows = with_cash(targets, wide=wide)
    dates = stretches(rows)
    placed = rows.join(dates, list(KEYS))
    held = F.when(is_cash(), 1.0).otherwise(0.0) if cfg.initial == "cash" else 1.0 / F.col("__names")
    opening = placed.filter("__place = 1").withColumn("weight", F.when(F.col("__usable"), F.col("weight")).otherwise(held))
    executed = constrained(opening, cfg, wide).select(*KEYS, "ticker", "weight")
    columns = (*KEYS, "ticker", "weight", "__since", "__place")
    path = executed.join(dates.filter("__place = 1 AND __length > 1"), list(KEYS)).select(*columns)
    path = path.unionByName(placed.filter("__place > 1").select(*columns))
    path = path.join(returns.select("decision_date", "ticker", "return"), ["decision_date", "ticker"], "left")
    earned = F.when(F.coalesce(finite("return"), F.lit(False)), F.col("return")).otherwise(0.0)
    path = path.withColumn("__growth", F.greatest(1 + earned, F.lit(0.0)))
    carried = _carried(path, wide) if cfg.max_position_weight is None else _carried_capped(path, cfg.max_position_weight)
    return executed.unionByName(carried.select(*KEYS, "ticker", "weight"))


def _carried(path: DataFrame, wide: bool) -> DataFrame:
    name = Window.partitionBy("portfolio_id", "__since", "ticker").orderBy("decision_date")
    before = name.rowsBetween(Window.unboundedPreceding, -1)
    listed = F.row_number().over(name) == F.col("__place")  # on every date of the stretch so far
    grown = F.first("weight").over(name.rowsBetween(Window.unboundedPreceding, 0)) * F.product("__growth").over(before)
    later = path.withColumn("weight", F.when(listed, grown).otherwise(0.0)).filter("__place > 1")
    return normalize(later.select(*KEYS, "ticker", "weight"), wide=wide)


def _carried_capped(path: DataFrame, cap: float) -> DataFrame:
    def step(held, day: pd.DataFrame):
        cash, opens = (day.ticker == CASH).to_numpy(), day["__place"].iloc[0] == 1
        w = (day.weight if opens else day.ticker.map(held).fillna(0.0)).to_numpy(dtype=float)
        if not opens:
            w = w / w.sum() if w.sum() > 0 else cash.astype(float)
            w = np.where(cash, w, np.minimum(w, cap))
            w = w + cash * max(1.0 - w.sum(), 0.0)
            w = w / w.sum()
        held = pd.Series(w * day["__growth"].to_numpy(), index=day.ticker.to_numpy())
        return held, day[[*KEYS, "ticker"]].assign(weight=w).iloc[: 0 if opens else None]

    stretch = F.concat_ws(" ", F.col("__since").cast("string"), F.col("portfolio_id")).alias("__stretch")
    return stream_portfolios(path.select(stretch, "*"), lambda: None, step, WEIGHT_SCHEMA, portfolio="__stretch")


def with_returns(weights: DataFrame, returns: DataFrame, strict: bool = True) -> DataFrame:
    """Attach each name's holding return; cash earns 0 unless listed. A held name needs a return."""
    joined = weights.join(returns.select("decision_date", "ticker", "return"), ["decision_date", "ticker"], "left")
    value = F.when(F.col("return").isNotNull(), F.col("return")).when(
        is_cash() | F.lit(not strict) | (F.col("weight") == 0), 0.0
    )
    missing = F.raise_error(F.concat(F.lit("Return table has no return for held name "), F.col("ticker")))
    return joined.withColumn("return", F.coalesce(value, missing.cast("double")))


def with_worth(rows: DataFrame, wide: bool = False) -> DataFrame:
    """Add the cross-section's worth after its returns and the drifted weights."""
    grown = F.greatest(F.col("weight") * (1 + F.col("return")), F.lit(0.0))  # nothing is worth less than nothing
    out = with_stats(rows, KEYS, wide, __worth=F.sum(grown), __names=F.count(F.lit(1)))
    share = F.when(F.col("__worth") > 0, F.try_divide(grown, F.col("__worth")))
    return out.withColumn("drifted_weight", F.coalesce(share, F.col("weight")))


def period_rows(rows: DataFrame, initial: str = "cash", wide: bool = False) -> DataFrame:
    """Gross return and turnover per portfolio and date.

    Turnover is the L1 distance between executed weights and what was carried into the date.
    Every holding is entered at its own date with its weight and at the portfolio's next date
    with minus its drifted weight; sums by name make names that enter or leave count in full.
    The first date is measured from all cash, or from equal weights including cash.
    """
    dates = rows.select(*KEYS).distinct().withColumns(
        {"__next": F.lead("decision_date").over(by_portfolio()), "__step": F.row_number().over(by_portfolio())}
    )
    placed = with_worth(rows, wide).join(dates, list(KEYS))
    opening = F.when(is_cash(), 1.0).otherwise(0.0) if initial == "cash" else 1.0 / F.col("__names")
    entered = F.col("weight") - F.when(F.col("__step") == 1, opening).otherwise(0.0)
    moves = placed.select(
        "portfolio_id",
        "ticker",
        F.inline(
            F.array(
                F.struct(
                    F.col("decision_date"), entered.alias("__w"), (F.col("weight") * F.col("return")).alias("__gain")
                ),
                F.struct(
                    F.col("__next").alias("decision_date"), (-F.col("drifted_weight")).alias("__w"), F.lit(0.0).alias("__gain")
                ),
            )
        ),
    ).filter(F.col("decision_date").isNotNull())
    by_name = moves.groupBy(*KEYS, "ticker").agg(F.abs(F.sum("__w")).alias("__d"), F.sum("__gain").alias("__gain"))
    return by_name.groupBy(*KEYS).agg(F.sum("__gain").alias("gross_return"), F.sum("__d").alias("turnover"))


def with_value(periods: DataFrame) -> DataFrame:
    """Value from 1.0, running peak (1.0 included) and drawdown."""
    so_far = by_portfolio().rowsBetween(Window.unboundedPreceding, 0)
    out = periods.withColumn("portfolio_value", F.product(1 + F.col("net_return")).over(so_far))
    out = out.withColumn("peak_value", F.greatest(F.lit(1.0), F.max("portfolio_value").over(so_far)))
    return out.withColumn("drawdown", 1 - F.col("portfolio_value") / F.col("peak_value"))


def with_liquidity_costs(periods: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Costs that grow with the traded share of average dollar volume, hence with value.

    One row per portfolio and date reaches the sequential step, whatever the number of names.
    """
    schema = (
        "portfolio_id string, decision_date date, gross_return double, turnover double, "
        "transaction_cost double, net_return double"
    )

    def step(value, day):
        row = day.iloc[0]
        traded = max(row.turnover * value / cfg.average_dollar_volume, 0.0)
        rate = cfg.cost_rate + (cfg.spread_bps + cfg.impact_bps * np.sqrt(traded)) / 10_000.0
        cost = row.turnover * rate
        net = row.gross_return - cost
        out = day[["portfolio_id", "decision_date", "gross_return", "turnover"]]
        return value * (1 + net), out.assign(transaction_cost=cost, net_return=net)

    slim = periods.select(*KEYS, "gross_return", "turnover")
    return stream_portfolios(slim, lambda: 1.0, step, schema, name="decision_date")


def reward_column(cfg: RewardConfig, benchmark: str = "benchmark_return") -> Column:
    """Log return less drawdown, downside, turnover and active-risk penalties."""
    excess = F.col("drawdown") - cfg.drawdown_limit
    x = excess / cfg.drawdown_temp
    soft = cfg.drawdown_temp * (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))
    hard = F.greatest(excess, F.lit(0.0))
    shortfall = F.greatest(cfg.sortino_target_return - F.col("net_return"), F.lit(0.0))
    active = F.col("net_return") - F.col(benchmark)
    return (
        F.ln(F.greatest(1 + F.col("net_return"), F.lit(1e-8)))
        - cfg.drawdown_penalty * (hard if cfg.drawdown_penalty_type == "hinge" else soft)
        - cfg.sortino_downside_penalty * shortfall * shortfall
        - cfg.turnover_penalty * F.col("turnover")
        - cfg.active_risk_penalty * active * active
    )


def ledger(
    targets: DataFrame,
    returns: DataFrame,
    cfg: LedgerConfig | None = None,
    benchmark: DataFrame | None = None,
    checked: bool = False,
    wide: bool = False,
    strict: bool = True,
) -> DataFrame:
    """One row per portfolio and decision date: gross, turnover, cost, net, value, peak, drawdown.

    With ``benchmark`` (decision_date, benchmark_return; one row per date) the reward is added.
    A portfolio's path runs over all its dates, so splits continue one another. A held name
    without a return is an error, or with ``strict`` off earns nothing on that date.
    """
    cfg = cfg or LedgerConfig()
    rows = with_returns(executed_weights(targets, returns, cfg, checked, wide), returns, strict)
    periods = period_rows(rows, cfg.initial, wide)
    if cfg.average_dollar_volume is None:
        cost = F.col("turnover") * cfg.cost_rate
        periods = periods.withColumns({"transaction_cost": cost, "net_return": F.col("gross_return") - cost})
    else:
        periods = with_liquidity_costs(periods, cfg)
    out = with_value(periods)
    if benchmark is not None:
        out = out.join(benchmark.select("decision_date", "benchmark_return"), "decision_date", "left")
        out = out.withColumn("reward", reward_column(cfg.reward))
    return out


def objective(periods: DataFrame, drawdown_limit: float = 0.2, penalty: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Evaluation of the allocation objective: negative Sharpe plus mean excess drawdown."""
    excess = F.greatest(1 - F.col("portfolio_value") / (F.col("peak_value") + eps) - drawdown_limit, F.lit(0.0))
    facts = periods.groupBy("portfolio_id").agg(
        F.avg("net_return").alias("mean_net_return"),
        F.stddev_pop("net_return").alias("net_return_volatility"),
        F.avg(excess).alias("mean_drawdown_excess"),
        F.avg("turnover").alias("mean_turnover"),
        F.max_by("portfolio_value", "decision_date").alias("final_equity"),
    )
    sharpe = F.col("mean_net_return") / (F.col("net_return_volatility") + eps)
    return facts.withColumn("sharpe_ratio", sharpe).withColumn(
        "loss", -F.col("sharpe_ratio") + penalty * F.col("mean_drawdown_excess")
    )


def allocation_export(weights: DataFrame, names, extra: tuple[str, ...] = ()) -> DataFrame:
    """Wide export: one column per listed name and cash."""
    return (
        weights.groupBy(*KEYS, *extra)
        .pivot("ticker", [*names, CASH])
        .agg(F.first("weight", ignorenulls=True))
    )
