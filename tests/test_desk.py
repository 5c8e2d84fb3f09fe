import math

import pytest
from pyspark.sql import functions as F

from tapeweave.config import DeskConfig
from tapeweave.operators.desk import desk_features, latest_state, scenario_table, snapshots
from tapeweave.operators.lineage import table_fingerprint
from tapeweave.sources.storage import read_bars, write_bars
from tapeweave.sources.validation import validate_bars
from tapeweave.sources.universe import UniverseConfig, load_universe

CFG = DeskConfig(
    ema_fast_span=2, ema_mid_span=3, ema_slow_span=4, atr_window=2, realized_vol_window=2, downside_vol_window=2,
    drawdown_window=4, momentum_short_window=2, momentum_medium_window=4, momentum_skip_window=1, high_lookback=4,
    volume_window=3, swing_left=1, swing_right=1, liquidity_lookback=20, zone_lookback=40, stress_lookback=5,
)


def plain_zone(levels, close, atr, side, fallback):
    chosen = sorted(x for x in levels if (x < close if side == "demand" else x > close)) or [fallback]
    groups = []
    for x in chosen:
        if groups and abs(x - sum(groups[-1]) / len(groups[-1])) <= CFG.zone_cluster_atr * atr:
            groups[-1].append(x)
        else:
            groups.append([x])
    g = groups[-1] if side == "demand" else groups[0]
    n = len(g)
    center = (g[(n - 1) // 2] + g[n // 2]) / 2
    half = max(CFG.zone_half_width_atr * atr, center * 0.0025)
    return center - half, center + half, n


def test_zones_and_scenarios_match_plain_python(zigzag):
    features = desk_features(zigzag, CFG).cache()
    state = {r.ticker: r for r in latest_state(features, CFG).collect()}
    for name in ("AAA", "BBB"):
        rows = features.filter(F.col("ticker") == name).orderBy("date").collect()
        last, recent = rows[-1], rows[-CFG.zone_lookback :]
        for side, column, back in (("demand", "low_event", "support"), ("supply", "high_event", "resistance")):
            levels = [r[column] for r in recent if r[column] is not None]
            low, high, touches = plain_zone(levels, last.close, last.atr, side, last[back])
            got = state[name][f"__{side}"]
            assert got.low == pytest.approx(low) and got.high == pytest.approx(high) and got.touches == touches
        s = state[name]
        refs = [x for x in (last.swing_avwap, last.stress_avwap) if x is not None and math.isfinite(x)]
        trigger = max(last.resistance, s["__supply"].high, max(refs) if refs else last.close) + 0.1 * last.atr
        stop = max(min(last.resistance, s["__supply"].low) - 0.25 * last.atr, trigger - 2.0 * last.atr)
        assert s.long_scenario.trigger == pytest.approx(round(trigger, 2), abs=0.011)
        assert s.long_scenario.stop == pytest.approx(round(stop, 2), abs=0.011)
        assert s.error is None
    assert scenario_table(snapshots(latest_state(features, CFG))).count() == 4


def test_pivots_appear_only_once_confirmed(zigzag):
    rows = desk_features(zigzag, CFG).filter("ticker = 'AAA'").orderBy("date").collect()
    events = [i for i, r in enumerate(rows) if r.high_event is not None]
    assert events
    for i in events:
        assert rows[i].high_event == rows[i - 1].high and rows[i].high_pivot_position == i - 1


def test_fingerprint_ignores_order_and_sees_changes(zigzag):
    a = table_fingerprint(zigzag).first()
    assert a == table_fingerprint(zigzag.orderBy(F.col("date").desc())).first()
    assert a != table_fingerprint(zigzag.withColumn("volume", F.col("volume") + 1)).first()
    assert a != table_fingerprint(zigzag.union(zigzag)).first()


def test_bars_round_trip_and_validation(spark, zigzag, tmp_path):
    write_bars(zigzag, str(tmp_path / "bars"))
    again = read_bars(spark, str(tmp_path / "bars"))
    assert table_fingerprint(again).first() == table_fingerprint(zigzag).first()
    validate_bars(again, spark.createDataFrame([("AAA",)], "ticker string"))
    with pytest.raises(ValueError, match="No bars"):
        validate_bars(again, spark.createDataFrame([("ZZZ",)], "ticker string"))
    with pytest.raises(ValueError, match="more than one bar"):
        validate_bars(again.union(again))


def test_universe_file(spark, tmp_path):
    path = tmp_path / "names.txt"
    path.write_text("aaa, bbb\n# note\nccc\n\n")
    assert sorted(r.ticker for r in load_universe(spark, str(path)).collect()) == ["AAA", "BBB", "CCC"]
    assert UniverseConfig((" spy", "SPY", "qqq"), max_stocks=2).selected == ("SPY", "QQQ")
