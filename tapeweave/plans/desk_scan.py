"""Scan a whole universe: clean, compute state, keep errors per ticker, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeweave.config import DeskConfig
from tapeweave.operators.desk import desk_features, latest_state, rank_universe, snapshot_table, snapshots
from tapeweave.session import cut_lineage
from tapeweave.sources.desk import cleaned, history_errors


def scan_bars(bars: DataFrame, cfg: DeskConfig | None = None, tickers: DataFrame | None = None) -> DataFrame:
    """One snapshot row per ticker; a history that breaks a rule yields its error instead."""
    cfg = cfg or DeskConfig()
    errors = history_errors(bars, tickers, cfg)
    good = bars.join(errors.select("ticker"), "ticker", "left_anti")
    snaps = snapshot_table(snapshots(latest_state(desk_features(good, cfg), cfg)))
    values = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in snaps.columns if c not in ("ticker", "error")]
    return snaps.select("ticker", *values, "error").unionByName(errors, allowMissingColumns=True)


def scan_universe(
    raw: DataFrame, sequence: str, cfg: DeskConfig | None = None, tickers: DataFrame | None = None
) -> DataFrame:
    return scan_bars(cleaned(raw, sequence), cfg, tickers)


def ranked_scan(bars: DataFrame, cfg: DeskConfig | None = None) -> DataFrame:
    """Scan and rank. The scan has one row per ticker and is read once per sleeve: written once."""
    return rank_universe(cut_lineage(scan_bars(bars, cfg)))
