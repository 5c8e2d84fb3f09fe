"""The feature-efficacy study end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tapeweave.config import FeatureConfig, PreprocessConfig, study_features
from tapeweave.operators import asset_features as af
from tapeweave.operators.datasets import study_dataset
from tapeweave.operators.efficacy import by_year, feature_label_correlations, raw_versus_partial, stability
from tapeweave.operators.labels import study_label_names, study_labels
from tapeweave.operators.preprocess import preprocess
from tapeweave.operators.routing import (
    BASELINE,
    EMA_SLOPES,
    VOLUME_EMA,
    Family,
    build_families,
    check_produced,
    family_outputs,
)
from tapeweave.session import cut_lineage


def families(cfg: FeatureConfig) -> dict[str, Family]:
    """The study's feature families over numbered bars, with what each needs."""
    s = af.feature_series(cfg)
    step = lambda f: lambda df: f(df, s, cfg)
    return {
        "base": Family((), lambda df: df),
        "averages": Family(("acc_macd_signal", "acc_klinger_signal"), step(af.averages), ("base",)),
        "accumulation": Family(
            ("mr_ewma50_vol_gap", "ewma50_slope", "macd_signal_strength", "klinger_signal_strength", "acc_momentum_quality"),
            step(af.accumulation),
            ("averages",),
        ),
        "cmf": Family(("cmf", "cmf_slope", "cmf_cross_signal", "cmf_days_since_cross"), step(af.money_flow), ("base",)),
        "frog_in_the_pan": Family(
            ("frog_in_the_pan", "bollinger_bandwidth", "fip_over_bollinger_bandwidth"), step(af.persistence), ("base",)
        ),
        "liquidity": Family(
            ("log_adv_20", "volume_z_20", "close_vwap20_gap", "amihud_20"),
            lambda df: af.liquidity(df, s, cfg.liquidity_window),
            ("base",),
        ),
        "trend": Family((*[c for c in VOLUME_EMA if "ema" in c], *EMA_SLOPES), step(af.trend), ("averages",)),
        "risk": Family(("realized_vol_126",), step(af.risk), ("base",)),
    }


def study_feature_table(bars: DataFrame, enabled, columns, cfg: FeatureConfig) -> DataFrame:
    """Only the enabled families (and what they need), then the model's columns."""
    known = families(cfg)
    check_produced(family_outputs(enabled, known), columns)
    numbered, _ = af.numbered_bars(bars, cfg)
    return build_families(numbered, enabled, known).select("date", "ticker", "close", *columns)


@dataclass(frozen=True)
class StudyResult:
    dataset: DataFrame
    correlations: DataFrame
    yearly: DataFrame
    stability: DataFrame
    partial: DataFrame


def run_study(
    bars: DataFrame,
    enabled=("accumulation", "cmf", "frog_in_the_pan"),
    columns=BASELINE,
    horizons=(5, 20, 60, 120),
    method: str = "spearman",
    cfg: FeatureConfig | None = None,
    preprocessing: PreprocessConfig | None = None,
    partial_label: str = "future_return_60d",
    controls=("mr_ewma50_vol_gap",),
) -> StudyResult:
    """Features, scaling, labels, complete rows; then pooled, yearly, stability and partial tables."""
    cfg = cfg or study_features()
    features = study_feature_table(bars, enabled, columns, cfg)
    scaled = preprocess(features, preprocessing or PreprocessConfig(), keep=("close",))
    labels = study_label_names(horizons, horizons)
    dataset = cut_lineage(study_dataset(scaled, study_labels(bars, horizons, horizons), columns, labels))
    yearly = by_year(dataset, columns, labels, method)
    return StudyResult(
        dataset=dataset,
        correlations=feature_label_correlations(dataset, columns, labels, method),
        yearly=yearly,
        stability=stability(yearly),
        partial=raw_versus_partial(dataset, [c for c in columns if c not in controls], partial_label, controls),
    )
