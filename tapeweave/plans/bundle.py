"""Bars to routed decision-date features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tapeweave.config import FeatureConfig
from tapeweave.operators.asset_features import asset_features
from tapeweave.operators.calendar import decision_dates, keep_dates
from tapeweave.operators.cross_section import percentile_ranks
from tapeweave.operators.macro import macro_features_long
from tapeweave.operators.market_relative import market_relative_features
from tapeweave.operators.routing import LIQUIDITY, MARKET_RELATIVE, MOMENTUM, RANK_SUFFIX, feature_set, route
from tapeweave.session import cut_lineage
from tapeweave.sources.storage import MarketBundle


@dataclass(frozen=True)
class FeatureBundle:
    """Prepared tables at decision dates; ``macro`` stays long (date, series, transforms)."""

    assets: DataFrame
    macro: DataFrame
    dates: DataFrame
    columns: tuple[str, ...]


def feature_bundle(market: MarketBundle, cfg: FeatureConfig | None = None) -> FeatureBundle:
    """Features of the configured set, computed on all bars, then kept at decision dates.

    Ranks compare all names of a date, so the date filter may move below them; it never moves
    below a trailing window.
    """
    cfg = cfg or FeatureConfig()
    columns = feature_set(cfg.feature_set)
    dates = cut_lineage(decision_dates(market.calendar))
    assets = asset_features(market.bars, cfg)
    if any(c in MARKET_RELATIVE for c in columns):
        assets = assets.join(market_relative_features(market.bars, market.benchmark), ["date", "ticker"], "left")
    assets = keep_dates(assets, dates)
    ranked = [c for c in (*MOMENTUM, *LIQUIDITY) if c + RANK_SUFFIX in columns]
    if cfg.add_percentile_ranks:
        ranked = [*MOMENTUM, *LIQUIDITY]
        columns = tuple(dict.fromkeys((*columns, *(c + RANK_SUFFIX for c in ranked))))
    if ranked:
        assets = percentile_ranks(cut_lineage(assets), ranked)
    extra = ("close",) if cfg.feature_set == "three_m_all_v1" else ()
    return FeatureBundle(
        assets=route(assets, columns, ("date", "ticker", *extra)),
        macro=keep_dates(macro_features_long(market.macro), dates),
        dates=dates,
        columns=columns,
    )
