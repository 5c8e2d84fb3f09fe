import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeweave.config import PolicyConfig
from tapeweave.operators import policy
from tapeweave.operators.policy import replay
from tapeweave.operators.policy_sweep import as_portfolios, sweep

SCHEMA = "portfolio_id string, decision_date date, ticker string, p_buy double, p_hold double, p_sell double, tradable boolean, return double"
KEY = ["portfolio_id", "decision_date", "ticker"]


def settings(n, seed=3):
    rng = np.random.default_rng(seed)
    return {
        f"s{i:03d}": PolicyConfig(
            buy_threshold=float(rng.choice([0.0, 0.4, 0.6, 0.8, 1.0])), hold_threshold=float(rng.choice([0.0, 0.2, 0.5])),
            sell_threshold=float(rng.choice([0.7, 0.9, 1.0])), entry_weight=float(rng.choice([0.03, 0.1])), max_positions=int(rng.integers(1, 9)),
        )
        for i in range(n)
    }


@pytest.fixture(scope="module")
def market(spark):
    """Two portfolios, 30 weeks, 25 names of which some are missing on some dates; probabilities with ties."""
    rng, rows = np.random.default_rng(8), []
    for portfolio in ("p", "q"):
        for week in range(30):
            for i in range(25):
                if rng.random() < 0.15:
                    continue
                p = [float(x) for x in rng.integers(0, 11, 3) / 10]
                rows.append((portfolio, dt.date(2024, 1, 5) + dt.timedelta(7 * week), f"N{i:02d}", *p, bool(rng.random() < 0.9), float(rng.normal(0, 0.05))))
    return spark.createDataFrame(rows, SCHEMA)


def tables(swept, market, chosen, initial=None):
    """The sweep and one replay per setting, side by side."""
    one = None
    for name, cfg in chosen.items():
        rows = replay(market, cfg, initial).withColumn("setting", F.lit(name))
        one = rows if one is None else one.unionByName(rows)
    order = ["setting", *KEY]
    return [df.select(*order, "action", "weight").toPandas().sort_values(order).reset_index(drop=True) for df in (swept, one)]


def same(a, b):
    pd.testing.assert_frame_equal(a.drop(columns="weight"), b.drop(columns="weight"))
    np.testing.assert_allclose(a.weight, b.weight, rtol=1e-9, atol=1e-12)


def test_a_sweep_is_one_replay_per_setting(market):
    chosen = settings(8)
    same(*tables(sweep(market, chosen, block=3), market, chosen))


def test_a_hundred_settings_do_not_depend_on_the_blocks(market):
    chosen = settings(100)
    order = ["setting", *KEY]
    a, b = (sweep(market, chosen, block=n).toPandas().sort_values(order).reset_index(drop=True) for n in (100, 13))
    same(a, b)
    there = a.merge(market.select(*KEY).toPandas(), on=KEY)
    assert len(there) == 100 * market.count() and (a.ticker == "CASH").sum() == 100 * 60
    assert not a.duplicated(order).any()


def test_a_hundred_settings_equal_a_hundred_single_replays(market):
    """The single replay's step, over every name and date of the table, once per setting."""
    chosen, rows = settings(100, seed=5), market.toPandas().sort_values(KEY).assign(__start=np.nan)
    parts = []
    for name, cfg in chosen.items():
        for _, path in rows.groupby("portfolio_id"):
            state = ({}, 1.0)
            for _, day in path.groupby("decision_date"):
                state, out = policy._step(state, day.reset_index(drop=True), cfg)
                parts.append(out.assign(setting=name))
    order = ["setting", *KEY]
    plain, swept = pd.concat(parts, ignore_index=True), sweep(market, chosen, block=32, every_name=False).toPandas()
    # buys that get nothing are listed for other names by the two: the sweep keeps to names within reach
    a, b = (t[(t.action != "BUY") | (t.weight > 0)].sort_values(order).reset_index(drop=True) for t in (swept[[*order, "action", "weight"]], plain[[*order, "action", "weight"]]))
    assert len(a) > 30_000
    same(a, b)


def test_a_sweep_goes_on_from_a_given_book(spark, market):
    chosen = settings(4, seed=11)
    initial = spark.createDataFrame([("p", "N03", 0.3), ("p", "Z", 0.2), ("p", "CASH", 0.5), ("q", "N01", 1.0)], "portfolio_id string, ticker string, weight double")
    same(*tables(sweep(market, chosen, initial, block=2), market, chosen, initial))


def test_active_rows_hold_all_weight(market):
    chosen = settings(5)
    active = as_portfolios(sweep(market, chosen, every_name=False))
    sums = active.groupBy("portfolio_id", "decision_date").agg(F.sum("weight").alias("w")).toPandas()
    assert len(sums) == 2 * 5 * 30 and "p/s000" in set(sums.portfolio_id)
    np.testing.assert_allclose(sums.w, 1.0, atol=1e-9)


def test_bounds(spark, market):
    with pytest.raises(ValueError, match="at least one setting"):
        sweep(market, {})
    assert sweep(market.where("false"), settings(2)).collect() == []
    broken = market.withColumn("p_hold", F.lit(2.0))
    with pytest.raises(Exception, match="No probabilities for"):
        sweep(broken, settings(2)).collect()
    lost = market.withColumn("return", F.lit(-5.0)).withColumn("p_buy", F.lit(1.0))
    with pytest.raises(Exception, match="without positive worth"):
        sweep(lost, {"a": PolicyConfig(entry_weight=0.1, max_positions=10)}).collect()
