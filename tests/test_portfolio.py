import datetime as dt

import numpy as np
import pytest

from tapeweave.config import EventLabelConfig, LedgerConfig, PolicyConfig, PreprocessConfig, Transform
from tapeweave.operators.calendar import open_to_open_returns, weekly_calendar
from tapeweave.operators.covariance import shrunk_covariance
from tapeweave.operators.labels import event_labels
from tapeweave.operators.ledger import executed_weights, ledger
from tapeweave.operators.metrics import block_metrics, delayed_returns, performance
from tapeweave.operators.policy import decide, fund, holding_periods, replay
from tapeweave.operators.preprocess import preprocess
from tapeweave.operators.routing import Family, build_order, feature_set

WEIGHTS = "portfolio_id string, decision_date date, ticker string, weight double"
RETURNS = "decision_date date, ticker string, `return` double"


def test_two_week_calendar_and_returns(spark):
    opens = {5: 100.0, 8: 101.0, 9: 102.0, 10: 103.0, 11: 104.0, 12: 105.0, 15: 111.1}
    rows = [(dt.date(2024, 1, d), "AAA", o, o, o, o, o, 1) for d, o in opens.items()]
    schema = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long"
    bars = spark.createDataFrame(rows, schema)
    calendar = weekly_calendar(bars)
    got = open_to_open_returns(bars, calendar).collect()
    assert [(r.decision_date.day, r.execution_date.day, r.next_execution_date.day) for r in got] == [(5, 8, 15)]
    assert got[0]["return"] == pytest.approx(111.1 / 101.0 - 1)


def test_ledger_equals_a_plain_loop(spark, day):
    rng = np.random.default_rng(3)
    names, T = ["A", "B", "C", "CASH"], 25
    w = rng.random((T, 4))
    w[rng.random((T, 4)) < 0.2] = 0.0
    w[:, 3] += 0.1
    w /= w.sum(axis=1, keepdims=True)
    w[7] = -1.0  # keeps the holdings
    w[8] = np.nan
    r = rng.normal(0, 0.03, (T, 4))
    r[:, 3] = 0.0
    targets = [("p", day(t), n, float(w[t, i])) for t in range(T) for i, n in enumerate(names)]
    returns = [(day(t), n, float(r[t, i])) for t in range(T) for i, n in enumerate(names[:3])]
    got = ledger(
        spark.createDataFrame(targets, WEIGHTS), spark.createDataFrame(returns, RETURNS), LedgerConfig(cost_rate=0.002)
    ).orderBy("decision_date").toPandas()
    held, value, peak, expected = np.array([0, 0, 0, 1.0]), 1.0, 1.0, []
    for t in range(T):
        x = w[t] if np.isfinite(w[t]).all() and np.maximum(w[t], 0).sum() > 0 else held
        turnover = np.abs(x - held).sum()
        net = (x * r[t]).sum() - 0.002 * turnover
        value *= 1 + net
        peak = max(peak, value)
        expected.append((turnover, net, value, 1 - value / peak))
        held = x * (1 + r[t])
        held /= held.sum()
    np.testing.assert_allclose(got[["turnover", "net_return", "portfolio_value", "drawdown"]], expected, atol=1e-12)


def test_liquidity_cost_depends_on_value(spark, day):
    targets = [("p", day(t), n, x) for t in range(3) for n, x in (("A", 0.5 + 0.1 * t), ("CASH", 0.5 - 0.1 * t))]
    returns = [(day(t), "A", 0.1) for t in range(3)]
    cfg = LedgerConfig(average_dollar_volume=10.0, spread_bps=5.0, impact_bps=20.0)
    got = ledger(spark.createDataFrame(targets, WEIGHTS), spark.createDataFrame(returns, RETURNS), cfg).orderBy("decision_date").collect()
    first = got[0]
    assert first.turnover == pytest.approx(1.0)
    assert first.transaction_cost == pytest.approx((5 + 20 * np.sqrt(0.1)) / 10_000)
    value = first.portfolio_value
    share = got[1].turnover * value / 10.0
    assert got[1].transaction_cost == pytest.approx(got[1].turnover * (5 + 20 * np.sqrt(share)) / 10_000)


def test_metrics_match_numpy(spark, day):
    r, b = np.array([0.01, -0.02, 0.03, 0.005]), np.array([0.0, -0.01, 0.02, 0.01])
    rows = [("p", day(i), float(x), float(y)) for i, (x, y) in enumerate(zip(r, b))]
    df = spark.createDataFrame(rows, "portfolio_id string, decision_date date, net_return double, benchmark_return double")
    m = performance(df, 52).first()
    curve = np.cumprod(1 + r)
    assert m.cumulative_return == pytest.approx(curve[-1] - 1)
    assert m.max_drawdown == pytest.approx(np.max(1 - curve / np.maximum.accumulate(curve)))
    assert m.sharpe_ratio == pytest.approx(r.mean() / r.std() * np.sqrt(52))
    assert m.beta == pytest.approx(np.cov(r, b, ddof=0)[0, 1] / b.var())
    assert block_metrics(df, 52, 2).count() == 2 and block_metrics(df, 52, 3).count() == 1
    assert [x.delayed_return for x in delayed_returns(df, 1).orderBy("decision_date").collect()] == [0.0, 0.01, -0.02, 0.03]


def test_gate_keeps_holds_and_ranks_buys(spark, day):
    held = spark.createDataFrame([("p", day(0), "A", 0.4), ("p", day(0), "CASH", 0.6)], WEIGHTS)
    probs = spark.createDataFrame(
        [("p", day(0), "A", 0.1, 0.9, 0.1), ("p", day(0), "B", 0.9, 0.9, 0.1), ("p", day(0), "C", 0.8, 0.9, 0.1)],
        "portfolio_id string, decision_date date, ticker string, p_buy double, p_hold double, p_sell double",
    )
    cfg = PolicyConfig(buy_threshold=0.6, hold_threshold=0.5, sell_threshold=0.7, entry_weight=0.3, max_positions=2, max_position_weight=0.3)
    for wide in (False, True):
        got = {r.ticker: r for r in fund(decide(held, probs, cfg), cfg, wide=wide).collect()}
        assert [got[n].action for n in "ABC"] == ["HOLD", "BUY", "BUY"]
        assert [round(got[n].target_weight, 9) for n in ("A", "B", "C", "CASH")] == [0.4, 0.3, 0.0, 0.3]
        assert got["B"].admitted and got["C"].rejected


def test_replay_holds_sells_and_drifts(spark, day):
    rows = [
        ("p", day(0), "A", 0.9, 0.9, 0.1, 0.10), ("p", day(0), "B", 0.2, 0.9, 0.1, 0.0),
        ("p", day(1), "A", 0.1, 0.9, 0.1, 0.00), ("p", day(1), "B", 0.8, 0.9, 0.1, 0.0),
        ("p", day(2), "A", 0.1, 0.1, 0.9, 0.00), ("p", day(2), "B", 0.1, 0.9, 0.1, 0.0),
    ]
    df = spark.createDataFrame(
        rows, "portfolio_id string, decision_date date, ticker string, p_buy double, p_hold double, p_sell double, `return` double"
    )
    got = {(r.decision_date, r.ticker): r for r in replay(df, PolicyConfig(entry_weight=0.1)).collect()}
    assert [got[day(i), "A"].action for i in range(3)] == ["BUY", "HOLD", "SELL"]
    assert [got[day(i), "B"].action for i in range(3)] == ["FLAT", "BUY", "HOLD"]
    assert got[day(1), "A"].weight == pytest.approx(0.11 / 1.01)
    total = sum(r.weight for (d, _), r in got.items() if d == day(2))
    assert total == pytest.approx(1.0)


def test_holding_periods_pair_first_buy_with_first_sell(spark, day):
    acts = ["BUY", "BUY", "HOLD", "SELL", "SELL", "BUY", "HOLD"]
    rows = [("A", day(i), a) for i, a in enumerate(acts)]
    got = holding_periods(spark.createDataFrame(rows, "ticker string, decision_date date, action string")).collect()
    assert [(r.entry_date, r.exit_date, r.holding_periods) for r in got] == [(day(0), day(3), 4)]


def test_event_labels_need_a_crossing_and_an_outcome(spark, day):
    r = [[0.0, 0.0], [0.03, -0.06], [0.03, 0.0], [0.0, 0.0]]
    g20 = [[-1.0, 1.0], [1.0, -1.0], [1.0, -1.0], [1.0, -1.0]]
    g50 = [[-2.0, 0.0], [2.0, -0.5], [2.0, -2.0], [2.0, -2.0]]
    rows = [(day(t), n, r[t][i], 100.0, g20[t][i], g50[t][i], g20[t][i]) for t in range(4) for i, n in enumerate("AB")]
    schema = "decision_date date, ticker string, `return` double, close double, close_ema20_gap double, close_ema50_gap double, close_vwap20_gap double"
    cfg = EventLabelConfig(outcome_horizon=2)
    got = event_labels(spark.createDataFrame(rows, schema), cfg).orderBy("decision_date", "ticker").collect()
    assert len(got) == 6 and [x.valid for x in got[:2]] == [False, False]
    assert [x.buy for x in got[2:4]] == [True, False]
    assert [x.sell for x in got[2:4]] == [False, True]
    assert [x.hold for x in got[2:4]] == [True, True]


def test_lagged_zscore_stays_inside_its_ticker(spark, day):
    rows = [(day(i), n, v) for n, s in (("A", 0), ("B", 10)) for i, v in enumerate((1.0 + s, 3.0 + s, 5.0 + s))]
    cfg = PreprocessConfig(rolling_window=2, transforms=(Transform("v", "lagged_rolling_zscore"),))
    got = preprocess(spark.createDataFrame(rows, "date date, ticker string, v double"), cfg).orderBy("ticker", "date").collect()
    np.testing.assert_allclose([x.v for x in got], [0, 0, 2.1213203] * 2, rtol=1e-6)


def test_family_order_and_errors():
    plain = lambda df: df
    known = {"a": Family(("x",), plain, ("b",)), "b": Family(("y",), plain), "c": Family((), plain, ("d",)), "d": Family((), plain, ("c",))}
    assert build_order(["a"], known) == ("b", "a")
    with pytest.raises(ValueError):
        build_order(["c"], known)
    with pytest.raises(KeyError):
        build_order(["z"], known)
    assert len(feature_set("three_m_all_v1")) == 29


@pytest.mark.parametrize("cap, initial, wide", [(None, "cash", False), (None, "equal_weight", True), (0.4, "cash", True)])
def test_unusable_targets_keep_what_is_held(spark, day, cap, initial, wide):
    rng = np.random.default_rng(5)
    names, T = ["A", "B", "C", "D", "CASH"], 16
    w = rng.random((T, 5))
    w[[0, 3, 4, 5, 6, 10, 11, 15]] = np.nan
    w[4] = -1.0
    r = np.round(rng.normal(0, 0.2, (T, 5)), 6)
    r[:, 4], r[5, 1] = 0.0, -1.5
    listed = rng.random((T, 5)) < 0.8
    listed[:, 4] = True
    rows = [("p", day(t), n, float(w[t, i])) for t in range(T) for i, n in enumerate(names) if listed[t, i]]
    returns = [(day(t), n, float(r[t, i])) for t in range(T) for i, n in enumerate(names[:4])]
    cfg = LedgerConfig(initial=initial, max_position_weight=cap, top_n=2)
    got = executed_weights(spark.createDataFrame(rows, WEIGHTS), spark.createDataFrame(returns, RETURNS), cfg, wide=wide)
    got = {(x.decision_date, x.ticker): x.weight for x in got.collect()}
    assert len(got) == len(rows)
    cash = np.array([0, 0, 0, 0, 1.0])
    share = lambda x: x / x.sum() if x.sum() > 0 else cash
    held = None
    for t in range(T):
        here = listed[t]
        if held is None:
            held = cash if initial == "cash" else here / here.sum()
        x = w[t] if np.isfinite(w[t][here]).all() and np.maximum(w[t], 0)[here].sum() > 0 else held
        x = share(np.where(here, np.maximum(x, 0), 0))
        top = sorted(range(4), key=lambda i: (-x[i] if here[i] else 1, names[i]))[:2]
        x = share(np.where(np.isin(np.arange(5), [*top, 4]), x, 0))
        if cap is not None:
            x = np.where(cash == 1, x, np.minimum(x, cap))
            x = share(x + cash * max(1 - x.sum(), 0))
        np.testing.assert_allclose([got[day(t), n] for i, n in enumerate(names) if here[i]], x[here], atol=1e-12)
        held = np.maximum(x * (1 + r[t]), 0)


def test_covariance_by_blocks_matches_numpy(spark, day):
    x = np.random.default_rng(2).normal(0, 1, (30, 5))
    rows = [(day(t), f"N{i}", float(x[t, i])) for t in range(30) for i in range(5) if (t, i) != (4, 2)] + [(day(4), "N2", None)]
    want = np.cov(np.delete(x, 4, axis=0), rowvar=False) * (0.7 + 0.3 * np.eye(5))
    got = shrunk_covariance(spark.createDataFrame(rows, RETURNS), [f"N{i}" for i in range(5)], 0.3, block=2, dates=7).collect()
    assert len(got) == 25
    for r in got:
        assert r.covariance == pytest.approx(want[int(r.left[1]), int(r.right[1])])
    with pytest.raises(ValueError):
        shrunk_covariance(spark.createDataFrame(rows[:5], RETURNS), [f"N{i}" for i in range(5)])
