"""Trailing per-ticker feature columns.

All columns come from one shuffle by ticker and one sort: every stage below is a set of window
aggregates over the same series, so consecutive stages stay in one Spark stage, and a column
that is not selected is pruned together with the windows only it needs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tapeweave.config import FeatureConfig
from tapeweave.functions.ewm import Ewm, block_rows_for, with_ewm
from tapeweave.functions.windows import (
    POSITION,
    Series,
    endpoint_slope,
    ratio,
    swing_high,
    swing_low,
    true_range,
)
from tapeweave.operators.routing import BASELINE, EMA_SLOPES, LONG_VOLATILITY, RISK, STRUCTURE, VOLUME_EMA
from tapeweave.sources.schema import enforce_ohlcv

ANNUAL = math.sqrt(252.0)
TINY = 1e-9
ASSET_COLUMNS = tuple(
    dict.fromkeys(
        BASELINE
        + ("mom_21d", "mom_126_21d", "near_52w_high", "log_adv_20", "volume_z_20", "close_vwap20_gap", "amihud_20")
        + STRUCTURE
        + RISK
        + LONG_VOLATILITY
        + VOLUME_EMA
        + EMA_SLOPES
    )
)


def feature_series(cfg: FeatureConfig) -> Series:
    spans = [
        cfg.macd_fast_span, cfg.macd_slow_span, cfg.macd_signal_span, cfg.mr_ewma_span, cfg.klinger_fast_span,
        cfg.klinger_slow_span, cfg.klinger_signal_span, cfg.ema_gap_fast_span, cfg.ema_gap_medium_span,
        cfg.ema_gap_slow_span,
    ]
    return Series("ticker", block_rows=block_rows_for(*spans))


def numbered_bars(bars: DataFrame, cfg: FeatureConfig) -> tuple[DataFrame, Series]:
    """Bars with series positions and the daily quantities most features start from."""
    s = feature_series(cfg)
    out = s.number(enforce_ohlcv(bars)).withColumn("__prev_close", s.lag("close"))
    spread = F.col("high") - F.col("low")
    place = ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / (spread + TINY)
    move = F.col("close") - F.col("__prev_close")
    return (
        out.withColumns(
            {
                "__return": ratio(F.col("close"), F.col("__prev_close")) - 1,
                "__true_range": true_range(),
                "__dollars": F.col("close") * F.col("volume"),
                "__typical_volume": (F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume"),
                "__money_flow": (place if cfg.study_variant else F.when(F.abs(spread) > TINY, place).otherwise(0.0))
                * F.col("volume"),
                "__signed_volume": F.col("volume")
                * F.when(move > 0, 1.0).when(move < 0, -1.0).otherwise(0.0),
            }
        ),
        s,
    )


def averages(df: DataFrame, s: Series, cfg: FeatureConfig) -> DataFrame:
    """Exponential averages of close and signed volume, then of their differences."""
    out = with_ewm(
        df,
        s,
        Ewm("close", "__macd_fast", cfg.macd_fast_span),
        Ewm("close", "__macd_slow", cfg.macd_slow_span),
        Ewm("close", "__mr_average", cfg.mr_ewma_span),
        Ewm("close", "__ema_fast", cfg.ema_gap_fast_span),
        Ewm("close", "__ema_medium", cfg.ema_gap_medium_span),
        Ewm("close", "__ema_slow", cfg.ema_gap_slow_span),
        Ewm("__signed_volume", "__klinger_fast", cfg.klinger_fast_span),
        Ewm("__signed_volume", "__klinger_slow", cfg.klinger_slow_span),
    ).withColumns(
        {
            "__macd": F.col("__macd_fast") - F.col("__macd_slow"),
            "__klinger": F.col("__klinger_fast") - F.col("__klinger_slow"),
            "__log_average": F.ln(F.col("__mr_average") + TINY),
        }
    )
    return with_ewm(
        out,
        s,
        Ewm("__macd", "acc_macd_signal", cfg.macd_signal_span),
        Ewm("__klinger", "acc_klinger_signal", cfg.klinger_signal_span),
    )


def accumulation(df: DataFrame, s: Series, cfg: FeatureConfig) -> DataFrame:
    """Mean-reversion gap, MACD and Klinger signals, and their normalized slopes."""
    n = cfg.accumulation_window
    base = F.col("close") + TINY if cfg.study_variant else F.col("close")
    out = df.withColumns(
        {
            "__mr_vol": s.rolling(F.stddev_samp, "__return", cfg.mr_vol_window, 2),
            "__d_log_average": s.diff("__log_average"),
            "__d_macd": s.diff("acc_macd_signal"),
            "__d_klinger": s.diff("acc_klinger_signal"),
            "__variance": s.rolling(F.var_samp, "__return", cfg.momentum_quality_window, 2),
        }
    )
    return out.withColumns(
        {
            "mr_ewma50_vol_gap": (F.col("__mr_average") - F.col("close")) / base / (F.col("__mr_vol") + TINY),
            "ewma50_slope": endpoint_slope(s, "__log_average", "__d_log_average", n),
            "macd_signal_strength": F.col("acc_macd_signal") * endpoint_slope(s, "acc_macd_signal", "__d_macd", n),
            "klinger_signal_strength": F.col("acc_klinger_signal")
            * endpoint_slope(s, "acc_klinger_signal", "__d_klinger", n),
            "acc_momentum_quality": s.change("close", cfg.momentum_quality_window) / (F.col("__variance") + TINY),
        }
    )


def money_flow(df: DataFrame, s: Series, cfg: FeatureConfig) -> DataFrame:
    """Chaikin money flow, its slope, zero crossings and rows since the last crossing."""
    w = cfg.cmf_window
    out = df.withColumn(
        "cmf",
        s.rolling(F.sum, "__money_flow", w, 2) / (s.rolling(F.sum, "volume", w, 2) + TINY),
    )
    out = out.withColumns({"__d_cmf": s.diff("cmf"), "__prev_cmf": s.lag("cmf")})
    up = (F.col("__prev_cmf") <= 0) & (F.col("cmf") > 0)
    down = (F.col("__prev_cmf") >= 0) & (F.col("cmf") < 0)
    out = out.withColumns(
        {
            "cmf_slope": endpoint_slope(s, "cmf", "__d_cmf", cfg.accumulation_window),
            "cmf_cross_signal": F.when(up, 1.0).when(down, -1.0).otherwise(0.0),
        }
    )
    crossed = F.when(F.col("cmf_cross_signal") != 0, F.col(POSITION))
    return out.withColumn("cmf_days_since_cross", F.col(POSITION) - s.carried(crossed))


def persistence(df: DataFrame, s: Series, cfg: FeatureConfig) -> DataFrame:
    """Signed-return persistence and Bollinger bandwidth."""
    n, b = cfg.fip_window, cfg.bollinger_window
    sign = F.coalesce(F.signum("__return"), F.lit(0.0))
    out = df.withColumns(
        {
            "frog_in_the_pan": s.rolling(F.sum, sign, n, 2) / math.sqrt(n),
            "bollinger_bandwidth": 2.0
            * cfg.bollinger_std_multiplier
            * s.rolling(F.stddev_samp, "close", b, 2)
            / (F.abs(s.rolling(F.avg, "close", b, 2)) + TINY),
        }
    )
    return out.withColumn(
        "fip_over_bollinger_bandwidth", F.col("frog_in_the_pan") / (F.col("bollinger_bandwidth") + TINY)
    )


def momentum(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumns(
        {
            "mom_21d": s.change("close", 21),
            "mom_126_21d": ratio(s.lag("close", 21), s.lag("close", 126)) - 1,
            "near_52w_high": ratio(F.col("close"), s.rolling(F.max, "close", 252, 1)) - 1,
        }
    )


def liquidity(df: DataFrame, s: Series, window: int) -> DataFrame:
    """Dollar volume, volume surprise, VWAP gap and price impact.

    A day without dollar volume has no impact reading; it is left out, not read as zero.
    """
    impact = F.when(F.col("__dollars") > 0, F.abs(F.col("__return")) / F.nullif(F.col("__dollars"), F.lit(0.0)))
    out = df.withColumns({"__adv": s.rolling(F.avg, "__dollars", window, 1), "__impact": impact})
    shares = s.rolling(F.sum, "volume", window, window)
    return out.withColumns(
        {
            "log_adv_20": F.when(F.col("__adv") > 0, F.ln("__adv")),
            "volume_z_20": (F.col("volume") - s.rolling(F.avg, "volume", window, 2))
            / (s.rolling(F.stddev_samp, "volume", window, 2) + TINY),
            "close_vwap20_gap": F.col("close") - ratio(s.rolling(F.sum, "__typical_volume", window, window), shares),
            "amihud_20": s.rolling(F.avg, "__impact", window, 1),
        }
    )


def risk(df: DataFrame, s: Series, cfg: FeatureConfig) -> DataFrame:
    loss = F.when(F.col("__return") < 0, F.col("__return")).otherwise(0.0)
    return df.withColumns(
        {
            "natr_20": s.rolling(F.avg, "__true_range", cfg.atr_window, 1) / (F.abs("close") + TINY),
            "realized_vol_20": s.rolling(F.stddev_samp, "__return", cfg.realized_vol_window, 2) * ANNUAL,
            "realized_vol_126": s.rolling(
                F.stddev_samp, "__return", cfg.historical_vol_window, cfg.historical_vol_window
            )
            * ANNUAL,
            "downside_vol_60": F.sqrt(s.rolling(F.avg, loss * loss, cfg.downside_vol_window, 2)) * ANNUAL,
            "max_drawdown_126": ratio(F.col("close"), s.rolling(F.max, "close", cfg.drawdown_window, 1)) - 1,
        }
    )


def trend(df: DataFrame, s: Series, cfg: FeatureConfig) -> DataFrame:
    n = cfg.ema_slope_window
    fast, medium, slow = (F.col(c) for c in ("__ema_fast", "__ema_medium", "__ema_slow"))
    slopes = {
        f"{name}_slope": (F.col(source) - s.lag(source, n)) / float(n)
        for name, source in (("ema20", "__ema_fast"), ("ema50", "__ema_medium"), ("ema200", "__ema_slow"))
    }
    return df.withColumns(
        {
            "close_ema20_gap": F.col("close") - fast,
            "close_ema50_gap": F.col("close") - medium,
            "close_ema200_gap": F.col("close") - slow,
            "ema20_ema50_distance": fast - medium,
            "ema50_ema200_distance": medium - slow,
            "ema20_ema200_distance": fast - slow,
            **slopes,
        }
    )


def structure(df: DataFrame, s: Series, cfg: FeatureConfig) -> DataFrame:
    """Support, resistance and anchored VWAP from pivots, each visible only once confirmed.

    The VWAP starts at the confirmation bar, so it is a difference of two running sums.
    """
    right = cfg.swing_right
    out = df.withColumns(
        {
            "__atr": s.rolling(F.avg, "__true_range", cfg.atr_window, 1),
            "__pivot_high": swing_high(s, cfg.swing_left, right),
            "__pivot_low": swing_low(s, cfg.swing_left, right),
            "__cum_value": s.running(F.sum, "__typical_volume"),
            "__cum_volume": s.running(F.sum, "volume"),
        }
    )
    out = out.withColumns(
        {
            "__high_level": F.when(s.lag("__pivot_high", right), s.lag("high", right)),
            "__low_level": F.when(s.lag("__pivot_low", right), s.lag("low", right)),
        }
    )
    anchored = F.col("__low_level").isNotNull()
    out = out.withColumns(
        {
            "__resistance": s.carried("__high_level"),
            "__support": s.carried("__low_level"),
            "__anchor_position": s.carried(F.when(anchored, F.col(POSITION))),
            "__anchor_value": s.carried(F.when(anchored, F.col("__cum_value") - F.col("__typical_volume"))),
            "__anchor_volume": s.carried(F.when(anchored, F.col("__cum_volume") - F.col("volume"))),
        }
    )
    vwap = ratio(F.col("__cum_value") - F.col("__anchor_value"), F.col("__cum_volume") - F.col("__anchor_volume"))
    atr = F.when(F.col("__atr") > 0, F.col("__atr"))
    return out.withColumns(
        {
            "confirmed_structure_score": anchored.cast("double") - F.col("__high_level").isNotNull().cast("double"),
            "support_distance_atr": (F.col("close") - F.col("__support")) / atr,
            "resistance_distance_atr": (F.col("__resistance") - F.col("close")) / atr,
            "swing_avwap_distance_atr": (F.col("close") - vwap) / atr,
            "bars_since_swing_low": F.col(POSITION) - F.col("__anchor_position"),
        }
    )


def asset_features(bars: DataFrame, cfg: FeatureConfig | None = None) -> DataFrame:
    """``date, ticker, close`` and every asset feature, one row per bar."""
    cfg = cfg or FeatureConfig()
    df, s = numbered_bars(bars, cfg)
    df = averages(df, s, cfg)
    for step in (accumulation, money_flow, persistence, risk, trend, structure):
        df = step(df, s, cfg)
    df = momentum(liquidity(df, s, cfg.liquidity_window), s)
    return df.select("date", "ticker", "close", *ASSET_COLUMNS)
