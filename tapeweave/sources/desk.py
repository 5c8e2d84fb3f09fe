"""Research-desk ingest: normalize raw histories and turn rule violations into an error table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeweave.config import DeskConfig
from tapeweave.sources.schema import finite, require_columns

FIELDS = ("open", "high", "low", "close", "volume")


def cleaned(raw: DataFrame, sequence: str) -> DataFrame:
    """Lower-case names, one row per ticker and date (the last by ``sequence``), finite numbers only.

    Text that is not a number reads as missing. The last copy is found with a combining
    aggregate, so many copies of one row cost nothing in the shuffle.
    """
    names = {c: c.strip().lower() for c in raw.columns}
    df = raw.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    require_columns(df, ["ticker", "date", *FIELDS], "OHLCV")
    row = F.struct(*[F.col(n).cast("string").try_cast("double").alias(n) for n in FIELDS])
    kept = df.groupBy(F.upper(F.trim("ticker")).alias("ticker"), F.col("date").cast("date").alias("date")).agg(
        F.max_by(row, F.col(sequence)).alias("bar")
    )
    out = kept.select("date", "ticker", "bar.*")
    for n in FIELDS:
        out = out.filter(finite(n))
    return out


def history_errors(bars: DataFrame, tickers: DataFrame | None = None, cfg: DeskConfig | None = None) -> DataFrame:
    """``ticker, error`` for every history the desk must refuse, first broken rule first."""
    cfg = cfg or DeskConfig()
    prices = [F.col(n) for n in FIELDS[:4]]
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    bent = (F.col("high") < top) | (F.col("low") > bottom) | (F.col("high") < F.col("low"))
    facts = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("bars"),
        F.max(F.least(*prices) <= 0).alias("bad_price"),
        F.max(F.col("volume") < 0).alias("bad_volume"),
        F.max(bent).alias("bad_geometry"),
    )
    if tickers is not None:
        facts = tickers.select("ticker").distinct().join(facts, "ticker", "left")
    need = cfg.minimum_bars
    error = (
        F.when(F.col("bars").isNull(), F.lit("No bar is there."))
        .when(
            F.col("bars") < need,
            F.format_string(f"%d bars are complete, {need} are needed.", F.col("bars")),
        )
        .when(F.col("bad_price"), F.lit("A price is zero or less."))
        .when(F.col("bad_volume"), F.lit("A volume is less than zero."))
        .when(F.col("bad_geometry"), F.lit("A bar's low and high don't enclose its open and close."))
    )
    return facts.select("ticker", error.alias("error")).filter(F.col("error").isNotNull())


def data_health(features: DataFrame, columns) -> DataFrame:
    """Per ticker and column: share missing in percent, latest value, whether it is finite."""
    latest = F.max_by(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]), F.col("date"))
    gone = [F.avg(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1.0).otherwise(0.0)) for c in columns]
    facts = features.groupBy("ticker").agg(
        latest.alias("__latest"), *[(g * 100).alias(f"__gone_{c}") for g, c in zip(gone, columns)]
    )
    entry = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"__gone_{c}").alias("missing_pct"),
            F.coalesce(finite(F.col(f"__latest.{c}")), F.lit(False)).alias("latest_is_finite"),
            F.col(f"__latest.{c}").alias("latest_value"),
        )
        for c in columns
    ]
    return facts.select("ticker", F.inline(F.array(*entry)))


def missing_mask(features: DataFrame, columns, keys=("date", "ticker")) -> DataFrame:
    """``<column>__missing`` flags; infinities count as missing."""
    return features.select(*keys, *[(~F.coalesce(finite(c), F.lit(False))).alias(f"{c}__missing") for c in columns])
