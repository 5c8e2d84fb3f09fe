"""Stock-versus-benchmark features on the benchmark's actual dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeweave.functions.blocks import Trailing, with_trailing
from tapeweave.functions.windows import Series, ratio
from tapeweave.operators.routing import MARKET_RELATIVE
from tapeweave.sources.schema import enforce_ohlcv


def with_benchmark(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Left join of the benchmark's close and return by date; absent dates stay null.

    The benchmark has one row per session, so it is broadcast.
    """
    by_date = Window.orderBy("date")
    market = enforce_ohlcv(benchmark).select(
        "date",
        F.col("close").alias("__market"),
        (ratio(F.col("close"), F.lag("close").over(by_date)) - 1).alias("__market_return"),
    )
    return enforce_ohlcv(bars).join(market, "date", "left")


def market_relative_features(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Relative strength, beta, residual momentum and idiosyncratic volatility.

    Beta keeps four separate rolling means: on a missing benchmark date each skips its own nulls.
    """
    s = Series("ticker")
    df = s.number(with_benchmark(bars, benchmark)).withColumn("__r", s.change("close"))
    m, r = F.col("__market_return"), F.col("__r")
    means = {"__e_r": r, "__e_m": m, "__e_rm": r * m, "__e_mm": m * m}
    df = with_trailing(df, s, 252, *[Trailing(name, "avg", x, 2) for name, x in means.items()])
    covariance = F.col("__e_rm") - F.col("__e_r") * F.col("__e_m")
    variance = F.col("__e_mm") - F.col("__e_m") * F.col("__e_m")
    df = df.withColumn("beta_252", covariance / (variance + 1e-9))
    stock_skip = ratio(s.lag("close", 21), s.lag("close", 126))
    market_skip = ratio(s.lag("__market", 21), s.lag("__market", 126)) - 1
    df = with_trailing(df, s, 60, Trailing("idio_vol_60", "stddev_samp", r - F.col("beta_252") * m, 2))
    return df.withColumns(
        {
            "relative_strength_63": ratio(F.col("close"), s.lag("close", 63))
            - ratio(F.col("__market"), s.lag("__market", 63)),
            "residual_mom_126_21": stock_skip - F.col("beta_252") * market_skip,
        }
    ).select("date", "ticker", *MARKET_RELATIVE)
