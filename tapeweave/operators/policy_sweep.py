"""Replay of many policy settings in one pass over the probabilities.

Settings are cut into blocks; a task steps one portfolio through its dates for one block, with a
matrix of weights (settings x held names). The rows are read once per block, not once per setting,
and a date costs a few matrix operations however many settings the block has.

Settings share the ranking of buys (by probability and ticker), so the names that some setting of a
block can ever buy are the first of the ranking under its lowest threshold. Only those pass through
the stream; names that no setting of the block holds any more leave the matrix.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeweave.config import PolicyConfig
from tapeweave.functions.sequential import stream_portfolios
from tapeweave.operators.policy import BEFORE, BUY, FLAT, HOLD, PROBABILITIES, SELL, checked_holdings, checked_probabilities
from tapeweave.operators.weights import CASH, KEYS, is_cash

BLOCK_SETTINGS = 64
SCHEMA = "portfolio_id string, setting string, decision_date date, ticker string, action string, weight double"


def sweep(
    rows: DataFrame,
    settings: Mapping[str, PolicyConfig],
    initial: DataFrame | None = None,
    block: int = BLOCK_SETTINGS,
    every_name: bool = True,
) -> DataFrame:
    """``replay`` of every portfolio under every setting: its rows, with the name of the setting beside them.

    ``rows`` and ``initial`` are those of ``replay``; every setting starts from the same book. Without
    ``every_name`` a date lists what a setting holds, buys or wants to buy among the names that passed
    through the stream, and cash; with it the names that are out of its reach come along, which is the
    table once per setting.
    """
    if not settings:
        raise ValueError("A sweep needs at least one setting.")
    if block < 1:
        raise ValueError("A block holds at least one setting.")
    names = list(settings)
    blocks = [[(n, settings[n]) for n in names[i : i + block]] for i in range(0, len(names), block)]
    rows = checked_probabilities(rows if "tradable" in rows.columns else rows.withColumn("tradable", F.lit(True)))
    rows = rows.withColumn("tradable", F.coalesce("tradable", F.lit(True)))
    book = None
    if initial is not None:
        book = checked_holdings(initial.select("portfolio_id", "ticker", "weight")).filter(~is_cash() & (F.col("weight") > 0))
    held = stream_portfolios(
        _steps(rows, book, blocks),
        lambda: None,
        lambda state, day: _step(state, day, blocks[int(day["__part"].iloc[0])]),
        SCHEMA,
        portfolio=("portfolio_id", "__part"),
    )
    if not every_name:
        return held
    return held.join(_idle(rows, settings), ["portfolio_id", "setting", "decision_date", "ticker"], "full").select(
        "portfolio_id", "setting", "decision_date", "ticker",
        F.coalesce("action", "__idle").alias("action"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
    )


def as_portfolios(swept: DataFrame, separator: str = "/") -> DataFrame:
    """Every (portfolio, setting) as a portfolio of its own, as the ledger and the metrics take them."""
    return swept.withColumn("portfolio_id", F.concat_ws(separator, "portfolio_id", "setting")).drop("setting")


def _per_part(blocks, of) -> Column:
    """A literal of each row's block."""
    return F.element_at(F.array(*[F.lit(of([c for _, c in b])) for b in blocks]), F.col("__part") + 1)


def _steps(rows: DataFrame, book: DataFrame | None, blocks) -> DataFrame:
    """What every block's stream needs: names within reach, one row a date without a name, the first book."""
    part = F.explode(F.array(*[F.lit(i) for i in range(len(blocks))])).alias("__part")
    lowest = min(c.buy_threshold for b in blocks for _, c in b)
    first = Window.partitionBy(*KEYS).orderBy(F.col("p_buy").desc(), F.col("ticker"))
    ranked = rows.filter(F.col("tradable") & (F.col("p_buy") >= lowest)).withColumn("__rank", F.row_number().over(first))
    # a row has the same rank under any threshold that it meets
    slots = max(c.max_positions for b in blocks for _, c in b)
    if book is None:
        listed = ranked.filter(F.col("__rank") <= 2 * slots).withColumn("__held", F.lit(0))
    else:
        sizes = book.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("__held"))
        listed = ranked.join(sizes, "portfolio_id", "left").fillna(0, ["__held"])
        listed = listed.filter(F.col("__rank") <= slots + F.greatest("__held", F.lit(slots)))
    most = _per_part(blocks, lambda cs: max(c.max_positions for c in cs))
    reach = listed.select("portfolio_id", "ticker", "p_buy", "__rank", "__held", part)
    reach = reach.filter(
        (F.col("p_buy") >= _per_part(blocks, lambda cs: min(c.buy_threshold for c in cs)))
        & (F.col("__rank") <= most + F.greatest(F.col("__held"), most))
    ).select("portfolio_id", "ticker", "__part")
    if book is not None:
        reach = reach.union(book.select("portfolio_id", "ticker", part))
    nothing = F.lit(None).cast("double").alias("__start")
    fields = ("portfolio_id", "__part", "decision_date", "ticker", *PROBABILITIES, "tradable", "return")
    steps = rows.join(reach.distinct(), ["portfolio_id", "ticker"]).select(*fields, nothing)
    still = [*(F.lit(0.0).alias(p) for p in PROBABILITIES), F.lit(False).alias("tradable"), F.lit(0.0).alias("return")]
    dates = rows.select(*KEYS).distinct().select("portfolio_id", part, "decision_date", F.lit("").alias("ticker"), *still, nothing)
    steps = steps.unionByName(dates)
    if book is None:
        return steps
    opening = F.lit(BEFORE).cast("date").alias("decision_date")
    return steps.unionByName(book.select("portfolio_id", part, opening, "ticker", *still, F.col("weight").alias("__start")))


def _idle(rows: DataFrame, settings: Mapping[str, PolicyConfig]) -> DataFrame:
    """Every row once per setting, with the action of a name that is not held and gets nothing."""
    limits = F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(float(c.buy_threshold)).alias("least")) for n, c in settings.items()])
    wanted = F.col("tradable") & (F.col("p_buy") >= F.col("__s.least"))
    return rows.select(*KEYS, "ticker", "tradable", "p_buy", F.explode(limits).alias("__s")).select(
        "portfolio_id", "__s.setting", "decision_date", "ticker", F.when(wanted, BUY).otherwise(FLAT).alias("__idle")
    )


def _step(state, day: pd.DataFrame, block):
    """One date for a block: state is (names, weights as settings x names, cash by setting)."""
    cfgs = [c for _, c in block]
    limit = {f: np.array([getattr(c, f) for c in cfgs], dtype=float) for f in PolicyConfig.__dataclass_fields__}
    names, weights, cash = state or (np.empty(0, dtype=object), np.zeros((len(cfgs), 0)), np.ones(len(cfgs)))
    if day["__start"].notna().any():
        book = day["__start"].to_numpy(dtype=float)
        rest = np.full(len(cfgs), max(0.0, 1.0 - sum(book)))
        return (day.ticker.to_numpy(), np.tile(book, (len(cfgs), 1)), rest), None
    day = day[day.ticker != ""] if len(day) > 1 else day
    # the matrix over the held names and those of the date, the latter from column `old` on or in place
    place = {n: i for i, n in enumerate(names)}
    for n in day.ticker:
        place.setdefault(n, len(place))
    at = np.array([place[n] for n in day.ticker])
    old, weights = weights, np.zeros((len(cfgs), len(place)))
    weights[:, : old.shape[1]] = old
    names = np.array(list(place), dtype=object)
    tradable, earned = np.zeros(len(names), dtype=bool), np.zeros(len(names))
    tradable[at], earned[at] = day.tradable.to_numpy(dtype=bool), day["return"].to_numpy(dtype=float)
    p = {}
    for c in PROBABILITIES:
        p[c] = np.zeros(len(names))
        p[c][at] = day[c].to_numpy(dtype=float)
    per = {f: v[:, None] for f, v in limit.items()}
    held = weights > per["holding_epsilon"]
    sold = held & tradable & ((p["p_sell"] >= per["sell_threshold"]) | (p["p_hold"] < per["hold_threshold"]))
    # exits one after another in the order of the book, as a single replay adds them
    for i in np.flatnonzero(sold.any(axis=0)):
        cash = cash + np.where(sold[:, i], weights[:, i], 0.0)
    weights = np.where(sold, 0.0, weights)
    wanted = ~held & tradable & (p["p_buy"] >= per["buy_threshold"])
    slots = limit["max_positions"] - (weights > per["holding_epsilon"]).sum(axis=1)
    order = np.lexsort((names, -p["p_buy"]))
    turn = np.empty(wanted.shape, dtype=int)
    turn[:, order] = wanted[:, order].cumsum(axis=1)
    sought, bought = wanted.sum(axis=1), np.zeros(len(cfgs), dtype=int)
    while (more := (bought < np.minimum(slots, sought)) & (cash + 1e-12 >= limit["entry_weight"])).any():
        cash = np.where(more, cash - limit["entry_weight"], cash)
        bought += more
    weights = np.where(wanted & (turn <= bought[:, None]), per["entry_weight"], weights)
    out = _listed(day, [n for n, _ in block], names, held, sold, wanted, weights, cash)
    worth = weights * (1.0 + earned)
    total = worth.sum(axis=1) + cash
    if not np.isfinite(total).all() or (total <= 0).any() or (worth < 0).any():
        raise ValueError(f"Returns of {day.decision_date.iloc[0]} leave a portfolio without positive worth.")
    stay = (worth > 0).any(axis=0)
    return (names[stay], worth[:, stay] / total[:, None], cash / total), out


def _listed(day, settings, names, held, sold, wanted, weights, cash) -> pd.DataFrame:
    """The rows of one date: names with an action, by setting, then cash."""
    setting, name = np.nonzero(held | wanted)
    action = np.where(sold[setting, name], SELL, np.where(held[setting, name], HOLD, BUY))
    called = np.array(settings, dtype=object)
    return pd.DataFrame(
        {
            "portfolio_id": day.portfolio_id.iloc[0],
            "setting": np.concatenate([called[setting], called]),
            "decision_date": day.decision_date.iloc[0],
            "ticker": np.concatenate([names[name], np.full(len(called), CASH, dtype=object)]),
            "action": np.concatenate([action.astype(object), np.full(len(called), None, dtype=object)]),
            "weight": np.concatenate([weights[setting, name], cash]),
        }
    )
