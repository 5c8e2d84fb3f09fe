"""Research desk: causal per-ticker state, levels, anchored prices, scenarios and ranking.

Everything is windows over a ticker's bars. Level lists inside a window are bounded by the
lookback, and the latest state per ticker is a combining aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeweave.config import DeskConfig
from tapeweave.functions.ewm import Ewm, block_rows_for, with_ewm
from tapeweave.functions.groups import with_average_ranks, with_stats
from tapeweave.functions.windows import (
    POSITION,
    Series,
    first_max_position,
    ratio,
    swing_high,
    swing_low,
    true_range,
)
from tapeweave.sources.schema import finite

ANNUAL = math.sqrt(252.0)
STRESS_LEAST = 2.0


def desk_series(cfg: DeskConfig) -> Series:
    return Series("ticker", block_rows=block_rows_for(cfg.ema_fast_span, 2 * cfg.atr_window - 1))


def base_state(bars: DataFrame, cfg: DeskConfig) -> tuple[DataFrame, Series]:
    """Returns, ranges, averages, momentum, risk and liquidity with whole windows only."""
    s = desk_series(cfg)
    df = s.number(bars).withColumn("__prev_close", s.lag("close"))
    df = df.withColumns(
        {
            "return": ratio(F.col("close"), F.col("__prev_close")) - 1,
            "log_return": F.ln(ratio(F.col("close"), F.col("__prev_close"))),
            "true_range": true_range(),
            "dollar_volume": F.col("close") * F.col("volume"),
        }
    )
    df = with_ewm(
        df,
        s,
        Ewm("true_range", "atr", alpha=1.0 / cfg.atr_window, least=cfg.atr_window),
        Ewm("close", "ema_fast", cfg.ema_fast_span, least=cfg.ema_fast_span),
        Ewm("close", "ema_mid", cfg.ema_mid_span, least=cfg.ema_mid_span),
        Ewm("close", "ema_slow", cfg.ema_slow_span, least=cfg.ema_slow_span),
    )
    whole = lambda agg, x, n: s.rolling(agg, x, n, n)
    loss = F.least(F.col("return"), F.lit(0.0))
    loss2 = F.when(F.col("return").isNotNull(), loss * loss)
    impact = F.abs("return") / F.nullif("dollar_volume", F.lit(0.0))
    place = (F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))
    v = cfg.volume_window
    df = df.withColumns({"__loss2": loss2, "__impact": impact})
    df = df.withColumns(
        {
            "realized_vol_20": whole(F.stddev_samp, "return", cfg.realized_vol_window) * ANNUAL,
            "downside_vol_60": F.sqrt(whole(F.avg, "__loss2", cfg.downside_vol_window) * 252.0),
            "max_drawdown_126": ratio(F.col("close"), whole(F.max, "close", cfg.drawdown_window)) - 1,
            "momentum_21d": s.change("close", cfg.momentum_short_window),
            "momentum_126_21d": ratio(s.lag("close", cfg.momentum_skip_window), s.lag("close", cfg.momentum_medium_window))
            - 1,
            "near_52w_high": ratio(F.col("close"), whole(F.max, "close", cfg.high_lookback)) - 1,
            "log_adv_20": F.ln(whole(F.avg, "dollar_volume", v)),
            "volume_z_20": s.lagged_zscore("volume", v),
            "amihud_20": whole(F.avg, "__impact", v),
            "close_location": ratio(place, F.col("high") - F.col("low")),
        }
    )
    return df, s


def confirmed_pivots(df: DataFrame, s: Series, cfg: DeskConfig) -> DataFrame:
    """Pivot level and row, published on the bar that confirms them."""
    right = cfg.swing_right
    out = df.withColumns(
        {
            "swing_high_pivot": swing_high(s, cfg.swing_left, right),
            "swing_low_pivot": swing_low(s, cfg.swing_left, right),
        }
    )
    was_high, was_low = s.lag("swing_high_pivot", right), s.lag("swing_low_pivot", right)
    return out.withColumns(
        {
            "high_event": F.when(was_high, s.lag("high", right)),
            "low_event": F.when(was_low, s.lag("low", right)),
            "low_pivot_position": F.when(was_low, F.col(POSITION) - right),
            "high_pivot_position": F.when(was_high, F.col(POSITION) - right),
        }
    )


def structure(df: DataFrame, s: Series) -> DataFrame:
    """Market structure from the last two confirmed highs and lows, and bars since each."""
    out = df
    for side in ("high", "low"):
        event = F.col(f"{side}_event")
        before = F.last(event, ignorenulls=True).over(s.earlier)
        out = out.withColumn(f"__pair_{side}", F.when(event.isNotNull(), F.struct(before.alias("old"), event.alias("new"))))
        out = out.withColumns(
            {
                f"__pair_{side}": s.carried(f"__pair_{side}"),
                f"bars_since_swing_{side}": F.col(POSITION) - s.carried(F.when(event.isNotNull(), F.col(POSITION))),
            }
        )
    old_h, new_h = F.col("__pair_high.old"), F.col("__pair_high.new")
    old_l, new_l = F.col("__pair_low.old"), F.col("__pair_low.new")
    known = old_h.isNotNull() & old_l.isNotNull()
    # fixed values: the labels
    label = (
        F.when(~F.coalesce(known, F.lit(False)), "insufficient confirmed structure")
        .when((new_h > old_h) & (new_l > old_l), "higher highs and higher lows")
        .when((new_h < old_h) & (new_l < old_l), "lower highs and lower lows")
        .when((new_h > old_h) & (new_l < old_l), "expanding range")
        .otherwise("compression / balance")
    )
    return out.withColumn("market_structure", label).withColumn(
        "structure_score",
        F.when(F.col("market_structure") == "higher highs and higher lows", 1.0)
        .when(F.col("market_structure") == "lower highs and lower lows", -1.0)
        .otherwise(0.0),
    )


def liquidity_levels(df: DataFrame, s: Series, cfg: DeskConfig) -> DataFrame:
    """Nearest confirmed level on each side within the lookback, else the prior window's extreme."""
    n = cfg.liquidity_lookback
    recent = s.rows.rowsBetween(-n, 0)
    out = df.withColumns(
        {
            "__highs": F.collect_list("high_event").over(recent),
            "__lows": F.collect_list("low_event").over(recent),
            "__prior_high": F.max("high").over(s.before(n)),
            "__prior_low": F.min("low").over(s.before(n)),
        }
    )
    above = F.array_min(F.filter("__highs", lambda x: x > F.col("close")))
    below = F.array_max(F.filter("__lows", lambda x: x < F.col("close")))
    return out.withColumns(
        {"resistance": F.coalesce(above, "__prior_high"), "support": F.coalesce(below, "__prior_low")}
    ).drop("__highs", "__lows")


def anchored_prices(df: DataFrame, s: Series, cfg: DeskConfig) -> DataFrame:
    """VWAPs anchored at the last confirmed low pivot and at the strongest recent stress bar.

    Each anchor carries the running sums before it, so a VWAP is one difference of prefixes.
    """
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume")
    out = df.withColumns({"__cum_value": s.running(F.sum, typical), "__cum_volume": s.running(F.sum, "volume")})
    back = cfg.swing_right + 1
    confirmed = F.col("low_pivot_position").isNotNull()
    n = max(cfg.volume_window, 10)
    out = out.withColumns(
        {
            "__value_before": F.coalesce(s.lag("__cum_value", 1), F.lit(0.0)),
            "__volume_before": F.coalesce(s.lag("__cum_volume", 1), F.lit(0)),
            "__swing_value": s.carried(F.when(confirmed, F.coalesce(s.lag("__cum_value", back), F.lit(0.0)))),
            "__swing_volume": s.carried(F.when(confirmed, F.coalesce(s.lag("__cum_volume", back), F.lit(0)))),
            "__range_share": ratio(F.col("true_range"), F.col("__prev_close")),
        }
    )
    out = out.withColumns({"__return_z": s.lagged_zscore("return", n), "__range_z": s.lagged_zscore("__range_share", n)})
    zero = F.lit(0.0)
    positive = lambda c: F.coalesce(F.greatest(F.col(c), zero), zero)
    score = F.coalesce(-F.least(F.col("__return_z"), zero), zero) + positive("volume_z_20") + positive("__range_z")
    out = out.withColumn("stress_score", score)
    eligible = F.coalesce((F.col("return") < 0) & (F.col("stress_score") >= STRESS_LEAST), F.lit(False))
    out = out.withColumn("__stress", F.when(eligible, F.col("stress_score")))
    recent = s.last_n(cfg.stress_lookback)
    out = out.withColumn("stress_anchor_position", first_max_position("__stress", POSITION, recent))
    # the same maximum carries the anchor's prefixes along
    anchor = F.max(
        F.when(
            F.col("__stress").isNotNull(),
            F.struct(F.col("__stress"), (-F.col(POSITION)).alias("p"), F.col("__value_before"), F.col("__volume_before")),
        )
    ).over(recent)
    out = out.withColumn("__anchor", anchor)
    swing = ratio(F.col("__cum_value") - F.col("__swing_value"), F.col("__cum_volume") - F.col("__swing_volume"))
    stress = ratio(
        F.col("__cum_value") - F.col("__anchor.__value_before"), F.col("__cum_volume") - F.col("__anchor.__volume_before")
    )
    out = out.withColumns({"swing_avwap": swing, "stress_avwap": stress}).drop("__anchor")
    return out.withColumn("swing_avwap_distance_atr", ratio(F.col("close") - F.col("swing_avwap"), F.col("atr")))


DESK_COLUMNS = (
    "return", "log_return", "true_range", "atr", "ema_fast", "ema_mid", "ema_slow", "realized_vol_20",
    "downside_vol_60", "max_drawdown_126", "momentum_21d", "momentum_126_21d", "near_52w_high", "dollar_volume",
    "log_adv_20", "volume_z_20", "amihud_20", "close_location", "high_event", "low_event", "high_pivot_position",
    "low_pivot_position", "market_structure", "structure_score", "bars_since_swing_high", "bars_since_swing_low",
    "support", "resistance", "swing_avwap", "stress_score", "stress_anchor_position", "stress_avwap",
    "swing_avwap_distance_atr",
)
BAR = ("open", "high", "low", "close", "volume")


def desk_features(bars: DataFrame, cfg: DeskConfig | None = None) -> DataFrame:
    """Daily desk history per ticker: bars plus every causal state column."""
    cfg = cfg or DeskConfig()
    df, s = base_state(bars.select("date", "ticker", *BAR), cfg)
    df = structure(confirmed_pivots(df, s, cfg), s)
    df = anchored_prices(liquidity_levels(df, s, cfg), s, cfg)
    return df.select("date", "ticker", *BAR, *DESK_COLUMNS)


def with_recent_windows(features: DataFrame, cfg: DeskConfig) -> DataFrame:
    """Recent confirmed levels and up/down-day volume, as of every bar (bounded by the lookbacks)."""
    s = Series("ticker")
    df = s.number(features)
    zone, days = s.last_n(cfg.zone_lookback), s.last_n(cfg.volume_window)
    return df.withColumns(
        {
            "__low_levels": F.collect_list("low_event").over(zone),
            "__high_levels": F.collect_list("high_event").over(zone),
            "__up_volume": F.avg(F.when(F.col("return") > 0, F.col("volume"))).over(days),
            "__down_volume": F.avg(F.when(F.col("return") < 0, F.col("volume"))).over(days),
        }
    )


def level_clusters(levels: Column, side: str, fallback: str, cfg: DeskConfig) -> Column:
    """Levels on one side of the close, folded into clusters in ascending order.

    A level joins the last cluster while it lies within the tolerance of that cluster's mean.
    """
    close, tolerance = F.col("close"), cfg.zone_cluster_atr * F.col("atr")
    chosen = F.filter(levels, (lambda x: x < close) if side == "demand" else (lambda x: x > close))
    chosen = F.array_sort(F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.col(fallback))))
    start = F.array().cast("array<struct<total:double,levels:array<double>>>")

    def add(groups, level):
        tail = F.try_element_at(groups, F.lit(-1))
        joins = F.abs(level - tail["total"] / F.size(tail["levels"])) <= tolerance
        total = F.when(joins, tail["total"]).otherwise(0.0) + level
        members = F.when(joins, tail["levels"]).otherwise(F.array().cast("array<double>"))
        kept = F.when(joins, F.slice(groups, 1, F.size(groups) - 1)).otherwise(groups)
        return F.concat(kept, F.array(F.struct(total.alias("total"), F.concat(members, F.array(level)).alias("levels"))))

    return F.aggregate(chosen, start, add)


def with_zones(rows: DataFrame, cfg: DeskConfig) -> DataFrame:
    """Structs ``__demand`` and ``__supply`` (low, high, touches) of the clusters next to the close.

    Demand is the highest cluster below, supply the lowest above; the centre is the median level.
    """
    sides = {"demand": ("__low_levels", "support", -1), "supply": ("__high_levels", "resistance", 1)}
    out = rows.withColumns(
        {f"__{k}": level_clusters(F.col(lv), k, back, cfg) for k, (lv, back, _) in sides.items()}
    )
    out = out.withColumns(
        {f"__{k}": F.try_element_at(f"__{k}", F.lit(end))["levels"] for k, (_, _, end) in sides.items()}
    )
    for k in sides:
        c, n = F.col(f"__{k}"), F.size(f"__{k}")
        middle = lambda i: F.try_element_at(c, i.cast("int"))
        center = (middle(F.floor((n + 1) / F.lit(2))) + middle(F.floor(n / F.lit(2)) + 1)) / 2
        out = out.withColumn(f"__center_{k}", center)
        width = F.greatest(cfg.zone_half_width_atr * F.col("atr"), F.col(f"__center_{k}") * 0.0025)
        edges = ((F.col(f"__center_{k}") - width).alias("low"), (F.col(f"__center_{k}") + width).alias("high"))
        out = out.withColumn(f"__{k}", F.struct(*edges, n.alias("touches")))
    return out


def scenario(direction: str, cfg: DeskConfig) -> Column:
    """Trigger, bounded stop, two targets, risk and eligibility for one side.

    Uses the row's close, atr, support, resistance, zones and AVWAPs. Prices are rounded half
    to even for display; eligibility is decided on unrounded numbers.
    """
    c = F.col
    sign = 1.0 if direction == "long" else -1.0
    far = F.greatest if direction == "long" else F.least
    near = F.least if direction == "long" else F.greatest
    reference = F.coalesce(far(c("swing_avwap"), c("stress_avwap")), c("close"))
    level = c("resistance") if direction == "long" else c("support")
    outer = c("__supply.high") if direction == "long" else c("__demand.low")
    inner = c("__supply.low") if direction == "long" else c("__demand.high")
    trigger = far(level, outer, reference) + sign * 0.10 * c("atr")
    loose_stop = near(level, inner) - sign * 0.25 * c("atr")
    stop = far(loose_stop, trigger - sign * cfg.max_stop_distance_atr * c("atr"))
    risk = sign * (trigger - stop)
    fraction = F.when(trigger > 0, risk / F.nullif(trigger, F.lit(0.0))).otherwise(F.lit(float("inf")))
    distance = sign * (trigger - c("close")) / c("atr")
    status = F.when(distance <= 0, "triggered").when(distance <= cfg.max_trigger_distance_atr, "watch").otherwise("distant")
    ok = (trigger > 0) & (risk > 0) & (fraction <= cfg.max_risk_fraction) & (distance <= cfg.max_trigger_distance_atr)
    side = ("resistance, supply", "breakout") if direction == "long" else ("support, demand", "breakdown")
    money = lambda x: F.bround(x, 2)
    return F.struct(
        F.lit(direction).alias("direction"),
        status.alias("status"),
        ok.alias("eligible"),
        money(trigger).alias("trigger"),
        money(stop).alias("stop"),
        money(trigger + sign * cfg.target_1_r_multiple * risk).alias("target_1"),
        money(trigger + sign * cfg.target_2_r_multiple * risk).alias("target_2"),
        money(risk).alias("risk_per_share"),
        F.when(fraction < float("inf"), F.bround(fraction, 4)).otherwise(fraction).alias("risk_fraction"),
        F.lit(cfg.target_1_r_multiple).alias("reward_risk_1"),
        F.lit(cfg.target_2_r_multiple).alias("reward_risk_2"),
        money(distance).alias("trigger_distance_atr"),
        F.lit(f"Acceptance beyond confirmed {side[0]} references and AVWAP.").alias("thesis"),
        F.lit(f"Close or stop execution back through the {side[1]} reference.").alias("invalidation"),
    )


REQUIRED = (
    "close", "atr", "ema_fast", "ema_mid", "ema_slow", "support", "resistance", "momentum_21d", "momentum_126_21d",
    "near_52w_high", "realized_vol_20", "downside_vol_60", "max_drawdown_126", "volume_z_20", "log_adv_20", "amihud_20",
)


def trend(close="close", fast="ema_fast", mid="ema_mid", slow="ema_slow") -> Column:
    a, b, c, d = (F.col(x) for x in (close, fast, mid, slow))
    return F.when((a > b) & (b > c) & (c > d), "bullish").when((a < b) & (b < c) & (c < d), "bearish").otherwise("transitional")


def avwap_state() -> Column:
    top, bottom = F.greatest("swing_avwap", "stress_avwap"), F.least("swing_avwap", "stress_avwap")
    return (  # fixed values: the labels
        F.when(top.isNull(), "AVWAP reference unavailable")
        .when(F.col("close") > top, "above all available AVWAP references")
        .when(F.col("close") < bottom, "below all available AVWAP references")
        .otherwise("between AVWAP references")
    )


def volume_state() -> Column:
    up, down = F.col("__up_volume"), F.col("__down_volume")
    return (  # fixed values: the labels
        F.when(up.isNull() | down.isNull(), "mixed")
        .when(up > down * 1.10, "up-day volume dominant")
        .when(down > up * 1.10, "down-day volume dominant")
        .otherwise("balanced")
    )


def with_state(rows: DataFrame, cfg: DeskConfig) -> DataFrame:
    """Zones, labels, scenarios and an error text for rows that miss a required number."""
    out = with_zones(rows, cfg).withColumns(
        {
            "primary_trend": trend(),
            "avwap_state": avwap_state(),
            "price_volume_state": volume_state(),
        }
    )
    missing = [F.when(~F.coalesce(finite(c), F.lit(False)), F.lit(c)) for c in REQUIRED]
    first_missing = F.coalesce(*missing)
    return out.withColumns(
        {
            "trend_score": F.when(F.col("primary_trend") == "bullish", 1.0)
            .when(F.col("primary_trend") == "bearish", -1.0)
            .otherwise(0.0),
            "long_scenario": scenario("long", cfg),
            "bearish_scenario": scenario("bearish", cfg),
            "error": F.when(
                first_missing.isNotNull(),
                F.concat(F.lit("The last bar has no number for "), first_missing, F.lit("; longer history may give one.")),
            ),
        }
    )


SNAPSHOT = (
    "ticker", "as_of", "last_close", "primary_trend", "trend_score", "market_structure", "structure_score",
    "momentum_21d", "momentum_126_21d", "near_52w_high", "realized_vol_20", "downside_vol_60", "max_drawdown_126",
    "atr", "volume_z_20", "price_volume_state", "log_adv_20", "amihud_20", "support", "resistance", "demand_zone_low",
    "demand_zone_high", "demand_zone_touches", "supply_zone_low", "supply_zone_high", "supply_zone_touches",
    "swing_avwap", "stress_avwap", "avwap_state", "bars_since_swing_high", "bars_since_swing_low",
)


def latest_state(features: DataFrame, cfg: DeskConfig | None = None) -> DataFrame:
    """Each ticker's most recent bar with its recent windows, zones and scenarios.

    Only the bars that the lookbacks reach are kept, and one aggregate over them gives the windows
    of ``with_recent_windows`` as of the last one.
    """
    cfg = cfg or DeskConfig()
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    tail = features.withColumn("__back", back).filter(F.col("__back") <= max(cfg.zone_lookback, cfg.volume_window))
    zone, days = F.col("__back") <= cfg.zone_lookback, F.col("__back") <= cfg.volume_window
    last = tail.groupBy("ticker").agg(
        *[F.max(F.when(F.col("__back") == 1, F.col(c))).alias(c) for c in features.columns if c != "ticker"],
        F.collect_list(F.when(zone, F.col("low_event"))).alias("__low_levels"),
        F.collect_list(F.when(zone, F.col("high_event"))).alias("__high_levels"),
        F.avg(F.when(days & (F.col("return") > 0), F.col("volume"))).alias("__up_volume"),
        F.avg(F.when(days & (F.col("return") < 0), F.col("volume"))).alias("__down_volume"),
    )
    return with_state(last, cfg)


def snapshots(state: DataFrame) -> DataFrame:
    """Display form: the 31 observable fields, rounded half to even, plus scenarios and error."""
    money = lambda c: F.bround(F.col(c), 2).alias(c)
    zones = [
        F.col(f"__{side}.touches").alias(f"{side}_zone_touches") if part == "touches"
        else F.bround(F.col(f"__{side}.{part}"), 2).alias(f"{side}_zone_{part}")
        for side in ("demand", "supply")
        for part in ("low", "high", "touches")
    ]
    plain = [c for c in SNAPSHOT if c in state.columns and c not in ("atr", "support", "resistance", "swing_avwap", "stress_avwap")]
    return state.select(
        *plain,
        F.col("date").alias("as_of"),
        F.bround("close", 2).alias("last_close"),
        F.bround("atr", 4).alias("atr"),
        *[money(c) for c in ("support", "resistance", "swing_avwap", "stress_avwap")],
        *zones,
        "long_scenario",
        "bearish_scenario",
        "error",
    ).select(*SNAPSHOT, "long_scenario", "bearish_scenario", "error")


def snapshot_table(snaps: DataFrame) -> DataFrame:
    return snaps.select(*SNAPSHOT, "error")


def scenario_table(snaps: DataFrame) -> DataFrame:
    return snaps.filter(F.col("error").isNull()).select("ticker", F.inline(F.array("long_scenario", "bearish_scenario")))


# Sleeve, metric, source column, unit or definition.
FACTORS = (
    ("Trend", "Primary trend", "primary_trend", "EMA alignment"),
    ("Structure", "Confirmed structure", "market_structure", "Delayed pivot confirmation"),
    ("Momentum", "21-day return", "momentum_21d", "decimal return"),
    ("Momentum", "126-to-21-day return", "momentum_126_21d", "skip-recent momentum"),
    ("Price location", "Distance from 52-week high", "near_52w_high", "decimal distance"),
    ("Risk", "20-day realized volatility", "realized_vol_20", "annualized"),
    ("Risk", "60-day downside volatility", "downside_vol_60", "annualized"),
    ("Risk", "126-day drawdown", "max_drawdown_126", "decimal drawdown"),
    ("Liquidity", "Log 20-day ADV", "log_adv_20", "log dollars"),
    ("Liquidity", "20-day Amihud", "amihud_20", "absolute return / dollar volume"),
    ("Volume", "Volume surprise", "volume_z_20", "lagged 20-day z-score"),
    ("Reference", "AVWAP state", "avwap_state", "daily-bar proxy"),
)


def factor_table(snaps: DataFrame) -> DataFrame:
    """Twelve factor rows per ticker; numbers and labels in separate columns."""
    entries = [
        F.struct(
            F.lit(sleeve).alias("sleeve"),
            F.lit(metric).alias("metric"),
            (F.lit(None).cast("double") if text else F.col(source)).alias("value"),
            (F.col(source) if text else F.lit(None).cast("string")).alias("label"),
            F.lit(unit).alias("units_or_definition"),
        )
        for sleeve, metric, source, unit in FACTORS
        for text in (source in ("primary_trend", "market_structure", "avwap_state"),)
    ]
    return snaps.filter(F.col("error").isNull()).select("ticker", F.inline(F.array(*entries)))


# Rank sleeves as (column, whether larger is better).
SLEEVES = {
    "momentum_rank": (("momentum_21d", True), ("momentum_126_21d", True), ("near_52w_high", True)),
    "structure_rank": (("trend_score", True), ("structure_score", True)),
    "risk_rank": (("realized_vol_20", False), ("max_drawdown_126", True)),
    "liquidity_rank": (("log_adv_20", True), ("amihud_20", False)),
}


def _mean_present(columns) -> Column:
    parts = [F.col(c) for c in columns]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    count = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return F.try_divide(total, count)


def rank_universe(scan: DataFrame, wide: bool = False) -> DataFrame:
    """Percentile sleeves over names without error, their mean, ordered best first; errors last.

    The scan has one row per name; ``wide`` is for universes that no task should sort.
    """
    needed = [c for parts in SLEEVES.values() for c, _ in parts]
    missing = sorted(set(needed) - set(scan.columns))
    if missing:
        raise ValueError(f"The scan cannot be ranked without {missing}.")
    error = F.col("error") if "error" in scan.columns else F.lit(None)
    df = scan.withColumn("__valid", error.isNull())
    ranks = {f"__r_{column}": (column, up) for parts in SLEEVES.values() for column, up in parts}
    df = with_average_ranks(df, ["__valid"], ranks, wide)
    df = with_stats(df, ["__valid"], wide, **{f"__n_{c}": F.count(c) for c in needed})
    share = {f"__r_{c}": F.when(F.col("__valid"), F.try_divide(f"__r_{c}", f"__n_{c}")) for c in needed}
    df = df.withColumns(share)
    df = df.withColumns({name: _mean_present([f"__r_{c}" for c, _ in parts]) for name, parts in SLEEVES.items()})
    df = df.withColumn("research_priority", _mean_present(list(SLEEVES)))
    return df.select(*scan.columns, *SLEEVES, "research_priority").orderBy(
        F.col("research_priority").desc_nulls_last(), "ticker"
    )
