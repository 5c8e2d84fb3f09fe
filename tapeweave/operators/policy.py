"""Hold/buy/sell policy: one-step gate and funding for any number of portfolios, and replay over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeweave.config import PolicyConfig
from tapeweave.functions.groups import with_stats
from tapeweave.functions.sequential import stream_portfolios
from tapeweave.operators.weights import CASH, KEYS, is_cash

FLAT, BUY, HOLD, SELL = "FLAT", "BUY", "HOLD", "SELL"
BEFORE = "0001-01-01"  # sorts before every decision date
PROBABILITIES = ("p_buy", "p_hold", "p_sell")


def _broken() -> Column:
    bad = F.lit(False)
    for p in PROBABILITIES:
        bad = bad | ~F.coalesce(F.col(p).between(0, 1) & ~F.isnan(p), F.lit(False))
    return bad


def bad_probabilities(rows: DataFrame) -> DataFrame:
    """Rows whose probabilities are missing or outside [0, 1]."""
    return rows.filter(_broken())


def checked_probabilities(rows: DataFrame) -> DataFrame:
    """The same rows; reading one whose probabilities are missing or outside [0, 1] is an error."""
    cells = [F.coalesce(F.col(p).cast("string"), F.lit("null")) for p in PROBABILITIES]
    told = F.concat(F.lit("No probabilities for "), F.col("ticker"), F.lit(": "), F.concat_ws(", ", *cells))
    stop = F.raise_error(told).cast("double")
    return rows.withColumns({p: F.when(_broken(), stop).otherwise(F.col(p)) for p in PROBABILITIES})


def checked_holdings(rows: DataFrame) -> DataFrame:
    """The same rows; a weight that is missing, not finite or negative is an error."""
    fine = F.coalesce((F.col("weight") >= 0) & (F.col("weight") < float("inf")) & ~F.isnan("weight"), F.lit(False))
    told = F.concat(F.lit("No weight for "), F.col("ticker"), F.lit(": "), F.coalesce(F.col("weight").cast("string"), F.lit("null")))
    return rows.withColumn("weight", F.when(fine, F.col("weight")).otherwise(F.raise_error(told).cast("double")))


def action_column(cfg: PolicyConfig, weight: str = "weight") -> Column:
    held = F.col(weight) > cfg.holding_epsilon
    free = F.coalesce(F.col("tradable"), F.lit(True))
    leave = (F.col("p_sell") >= cfg.sell_threshold) | (F.col("p_hold") < cfg.hold_threshold)
    return (
        F.when(held & free & leave, SELL)
        .when(held, HOLD)
        .when(free & (F.col("p_buy") >= cfg.buy_threshold), BUY)
        .otherwise(FLAT)
    )


def decide(holdings: DataFrame, probabilities: DataFrame, cfg: PolicyConfig, keys=KEYS) -> DataFrame:
    """Gate each asset by what is held. The cash row comes along without an action.

    Names without holdings start at weight 0; holdings without probabilities cannot trade.
    Probabilities outside [0, 1] and weights below 0, missing or not finite are errors.
    """
    probabilities, holdings = checked_probabilities(probabilities), checked_holdings(holdings)
    rows = probabilities if "tradable" in probabilities.columns else probabilities.withColumn("tradable", F.lit(True))
    rows = rows.withColumn("tradable", F.coalesce("tradable", F.lit(True)))
    both = rows.join(holdings.select(*keys, "ticker", "weight"), [*keys, "ticker"], "full")
    both = both.fillna(0.0, ["weight"]).fillna(False, ["tradable"])
    return both.withColumn("action", F.when(~is_cash(), action_column(cfg)))


def fund(decisions: DataFrame, cfg: PolicyConfig, keys=KEYS, wide: bool = False) -> DataFrame:
    """Sell, keep holds, then admit ranked buys while slots and cash last.

    Every entry costs the same weight, so the admitted buys are the first
    ``min(slots, cash / entry)`` by probability and ticker. Wide cross-sections rank only
    ``max_positions`` rows per group and map task.
    """
    sold, buy = F.col("action") == SELL, F.col("action") == BUY
    kept = ~is_cash() & ~sold & (F.col("weight") > cfg.holding_epsilon)
    books = with_stats(
        decisions.fillna("", ["action"]),
        keys,
        wide,
        __funds=F.sum(F.when(sold | is_cash(), F.col("weight")).otherwise(0.0)),
        __kept=F.count(F.when(kept, 1)),
    )
    room = F.least(cfg.max_positions - F.col("__kept"), F.floor((F.col("__funds") + 1e-12) / cfg.entry_weight))
    first = Window.partitionBy(*keys).orderBy(buy.desc(), F.col("p_buy").desc(), F.col("ticker"))
    if wide:
        top = books.filter(buy).withColumn("__rank", F.row_number().over(first))
        top = top.filter(F.col("__rank") <= cfg.max_positions).select(*keys, "ticker", "__rank")
        books = books.join(top, [*keys, "ticker"], "left")
    else:
        books = books.withColumn("__rank", F.row_number().over(first))
    marked = books.withColumn("admitted", F.coalesce(buy & (F.col("__rank") <= room), F.lit(False)))
    out = with_stats(marked, keys, wide, __entries=F.count(F.when(F.col("admitted"), 1)))
    target = (
        F.when(is_cash(), F.greatest(F.col("__funds") - F.col("__entries") * cfg.entry_weight, F.lit(0.0)))
        .when(sold, 0.0)
        .when(F.col("admitted"), cfg.entry_weight)
        .otherwise(F.greatest("weight", F.lit(0.0)))
    )
    return out.select(
        *keys, "ticker", F.nullif("action", F.lit("")).alias("action"), "admitted",
        (buy & ~F.col("admitted")).alias("rejected"), target.alias("target_weight"),
    )


def replay(rows: DataFrame, cfg: PolicyConfig, initial: DataFrame | None = None) -> DataFrame:
    """Run gate and funding along every portfolio's dates, holdings drifting in between.

    ``rows``: portfolio_id, decision_date, ticker, the three probabilities, tradable, return.
    ``initial`` (portfolio_id, ticker, weight) is the book before the first date, for a run that
    goes on from another; a portfolio without one starts in cash, and what a book leaves of 1 is
    cash. With h names at the start, at most max(h, ``max_positions``) are held, and what is
    bought on a date is among its first ``max_positions`` eligible buys that are not held. Only
    names on such a list some day, or in the book, pass through the sequential step; all others
    are FLAT or unfunded BUY on every date and are labelled in place.
    """
    rows = checked_probabilities(rows if "tradable" in rows.columns else rows.withColumn("tradable", F.lit(True)))
    wanted = F.coalesce("tradable", F.lit(True)) & (F.col("p_buy") >= cfg.buy_threshold)
    first = Window.partitionBy(*KEYS).orderBy(F.col("p_buy").desc(), F.col("ticker"))
    ranked = rows.filter(wanted).withColumn("__rank", F.row_number().over(first))
    if initial is None:
        names = ranked.filter(F.col("__rank") <= 2 * cfg.max_positions).select("portfolio_id", "ticker").distinct()
    else:
        book = checked_holdings(initial.select("portfolio_id", "ticker", "weight")).filter(~is_cash() & (F.col("weight") > 0))
        sizes = book.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("__held"))
        most = cfg.max_positions + F.greatest(F.coalesce("__held", F.lit(0)), F.lit(cfg.max_positions))
        listed = ranked.join(sizes, "portfolio_id", "left").filter(F.col("__rank") <= most)
        names = listed.select("portfolio_id", "ticker").union(book.select("portfolio_id", "ticker")).distinct()
    fields = (*KEYS, "ticker", *PROBABILITIES, "tradable", "return", "__start")
    rows = rows.withColumn("__start", F.lit(None).cast("double"))
    needed = (
        rows.join(names, ["portfolio_id", "ticker"], "left_semi")
        .withColumn("tradable", F.coalesce("tradable", F.lit(True)))
        .select(*fields)
    )
    # one row per date without a name, so that every date is stepped even if no needed name trades
    never = [F.lit(0.0).alias(p) for p in PROBABILITIES]
    visits = rows.select(*KEYS).distinct().select(
        *KEYS, F.lit("").alias("ticker"), *never, F.lit(False).alias("tradable"), F.lit(0.0).alias("return"),
        F.lit(None).cast("double").alias("__start"),
    )
    steps = needed.unionByName(visits)
    if initial is not None:
        steps = steps.unionByName(
            book.select(
                "portfolio_id", F.lit(BEFORE).cast("date").alias("decision_date"), "ticker", *never,
                F.lit(False).alias("tradable"), F.lit(0.0).alias("return"), F.col("weight").alias("__start"),
            )
        )
    held = stream_portfolios(
        steps,
        lambda: ({}, 1.0),
        lambda state, day: _step(state, day, cfg),
        "portfolio_id string, decision_date date, ticker string, action string, weight double",
    )
    idle = rows.select(*KEYS, "ticker", F.when(wanted, BUY).otherwise(FLAT).alias("__idle"))
    return held.join(idle, [*KEYS, "ticker"], "full").select(
        *KEYS,
        "ticker",
        F.coalesce("action", "__idle").alias("action"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
    )


def _step(state, day: pd.DataFrame, cfg: PolicyConfig):
    """One date: state is ({ticker: drifted weight}, cash)."""
    weights, cash = state
    if day["__start"].notna().any():
        book = dict(zip(day.ticker, day["__start"]))
        return (book, max(0.0, 1.0 - sum(book.values()))), day.head(0)
    at = {name: i for i, name in enumerate(day.ticker)}
    tradable, p_buy, p_hold, p_sell = (day[c].to_numpy() for c in ("tradable", "p_buy", "p_hold", "p_sell"))
    leave = tradable & ((p_sell >= cfg.sell_threshold) | (p_hold < cfg.hold_threshold))
    action, target = {}, dict(weights)
    for name, w in weights.items():
        if w <= cfg.holding_epsilon:
            continue
        sold = name in at and leave[at[name]]
        action[name] = SELL if sold else HOLD
        if sold:
            cash += target.pop(name)
    open_slots = cfg.max_positions - sum(1 for w in target.values() if w > cfg.holding_epsilon)
    tickers = day.ticker.to_numpy()
    wants = np.flatnonzero(tradable & (p_buy >= cfg.buy_threshold))
    for i in wants[np.lexsort((tickers[wants], -p_buy[wants]))]:
        name = tickers[i]
        if name in action:
            continue
        action[name] = BUY
        if open_slots > 0 and cash + 1e-12 >= cfg.entry_weight:
            target[name] = cfg.entry_weight
            cash -= cfg.entry_weight
            open_slots -= 1
    names = list(action)
    out = pd.DataFrame(
        {
            "portfolio_id": day.portfolio_id.iloc[0],
            "decision_date": day.decision_date.iloc[0],
            "ticker": [*names, CASH],
            "action": [*(action[n] for n in names), None],
            "weight": [*(target.get(n, 0.0) for n in names), cash],
        }
    )
    earned = day["return"].to_numpy(dtype=float)
    worth = {n: w * (1.0 + (earned[at[n]] if n in at else 0.0)) for n, w in target.items()}
    total = sum(worth.values()) + cash
    if not np.isfinite(total) or total <= 0 or min(worth.values(), default=0.0) < 0:
        raise ValueError(f"Returns of {day.decision_date.iloc[0]} leave a portfolio without positive worth.")
    return ({n: v / total for n, v in worth.items()}, cash / total), out


def holding_periods(actions: DataFrame, keys=("ticker",), on: str = "decision_date") -> DataFrame:
    """Completed trades: from a buy while flat to the first later sell, with rows held.

    Only Buy and Sell rows matter. A Buy opens when the event before it is a Sell (or none);
    its exit is the next Sell. Row positions are counted over all of the series' rows.
    """
    order = Window.partitionBy(*keys).orderBy(on)
    rows = actions.withColumn("__row", F.row_number().over(order))
    events = rows.filter(F.col("action").isin(BUY, SELL))
    previous = F.lag("action").over(order)
    opens = (F.col("action") == BUY) & (F.coalesce(previous, F.lit(SELL)) == SELL)
    closes = (F.col("action") == SELL) & (previous == BUY)
    turns = events.withColumn("__edge", F.when(opens, "open").when(closes, "close")).filter("__edge IS NOT NULL")
    paired = turns.withColumns({"__exit": F.lead(on).over(order), "__exit_row": F.lead("__row").over(order)})
    done = paired.filter((F.col("__edge") == "open") & F.col("__exit").isNotNull())
    return done.select(
        *keys,
        F.col(on).alias("entry_date"),
        F.col("__exit").alias("exit_date"),
        (F.col("__exit_row") - F.col("__row") + 1).alias("holding_periods"),
    )


def action_counts(actions: DataFrame, keys=()) -> DataFrame:
    return actions.filter(F.col("action").isNotNull()).groupBy(*keys, "action").agg(F.count(F.lit(1)).alias("n"))


def holding_summary(periods: DataFrame, keys=()) -> DataFrame:
    grouped = periods.groupBy(*keys) if keys else periods.groupBy()
    h = F.col("holding_periods").cast("double")
    quart = F.percentile(h, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), F.avg(h).alias("mean"), F.stddev_samp(h).alias("std"), F.min(h).alias("min"),
        quart[0].alias("q25"), quart[1].alias("median"), quart[2].alias("q75"), F.max(h).alias("max"),
    )
