"""Walk-forward experiments: all splits prepared at once, models per split, one ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tapeweave.config import (
    BoostedClassifier,
    BoostedRegression,
    EventLabelConfig,
    ExperimentConfig,
    PolicyConfig,
)
from tapeweave.operators.datasets import event_panel, pooled_training_rows
from tapeweave.operators.labels import GAPS, event_labels
from tapeweave.operators.ledger import ledger
from tapeweave.operators.metrics import performance, with_benchmark_portfolio
from tapeweave.operators.models import fit_classifiers, predict_probabilities, split_scores
from tapeweave.operators.policy import PROBABILITIES, replay
from tapeweave.operators.preprocess import preprocess_splits
from tapeweave.operators.routing import EVENT_MODEL
from tapeweave.operators.splits import assign_splits, check_splits, walk_forward_splits
from tapeweave.operators.weights import blend, cap_and_redistribute, policy_portfolios, softmax_weights
from tapeweave.session import cut_lineage


@dataclass(frozen=True)
class WalkForwardResult:
    splits: DataFrame
    targets: DataFrame
    periods: DataFrame
    split_metrics: DataFrame
    total_metrics: DataFrame


def prepared_splits(features: DataFrame, splits: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Every split's train and test rows, scaled chronologically in one pass."""
    return preprocess_splits(assign_splits(features, splits), cfg.preprocess)


def evaluate(
    targets: DataFrame,
    returns: DataFrame,
    benchmark: DataFrame,
    splits: DataFrame,
    cfg: ExperimentConfig,
    strict: bool = True,
) -> WalkForwardResult:
    """Ledger over the test dates of all splits as one continuous path, then metrics."""
    periods = cut_lineage(ledger(targets, returns, cfg.ledger, benchmark, strict=strict))
    tested = assign_splits(periods, splits, "decision_date").filter(F.col("role") == "test").drop("role")
    columns = ["portfolio_id", "split_index", "decision_date", "net_return", "benchmark_return", "turnover", "transaction_cost"]
    with_market = with_benchmark_portfolio(tested.select(*columns))
    return WalkForwardResult(
        splits=splits,
        targets=targets,
        periods=tested,
        split_metrics=performance(with_market, cfg.annualization, ("portfolio_id", "split_index")),
        total_metrics=performance(with_market, cfg.annualization),
    )


def rule_walk_forward(
    features: DataFrame, returns: DataFrame, benchmark: DataFrame, calendar: DataFrame, cfg: ExperimentConfig
) -> WalkForwardResult:
    """Benchmark policies over the test windows."""
    splits = cut_lineage(check_splits(walk_forward_splits(calendar, cfg.walk_forward)))
    tested = assign_splits(returns.join(features.select(F.col("date").alias("decision_date"), "ticker"), ["decision_date", "ticker"]), splits, "decision_date")
    rows = tested.filter(F.col("role") == "test").select("decision_date", "ticker").distinct()
    return evaluate(policy_portfolios(cut_lineage(rows)), returns, benchmark, splits, cfg)


def score_walk_forward(
    features: DataFrame,
    columns,
    returns: DataFrame,
    benchmark: DataFrame,
    calendar: DataFrame,
    cfg: ExperimentConfig,
    model: BoostedRegression,
    current: DataFrame | None = None,
) -> WalkForwardResult:
    """Boosted regressor per split; softmax weights, optionally capped and blended with ``current``."""
    splits = cut_lineage(check_splits(walk_forward_splits(calendar, cfg.walk_forward)))
    scores = cut_lineage(split_scores(prepared_splits(features, splits, cfg), returns, columns, model, cfg.seed))
    named = scores.select(F.lit("boosted").alias("portfolio_id"), F.col("date").alias("decision_date"), "ticker", "score")
    held = named.join(returns.select("decision_date", "ticker"), ["decision_date", "ticker"], "left_semi")
    targets = softmax_weights(held, model.temperature, model.score_clip)
    if model.max_position_weight is not None:
        targets = cap_and_redistribute(targets, model.max_position_weight)
    if model.smoothing_alpha < 1.0:
        if current is None:
            current = policy_portfolios(held, ("equal_weight",)).withColumn("portfolio_id", F.lit("boosted"))
        targets = blend(current, targets, model.smoothing_alpha)
    return evaluate(cut_lineage(targets), returns, benchmark, splits, cfg)


def event_walk_forward(
    features: DataFrame,
    returns: DataFrame,
    benchmark: DataFrame,
    calendar: DataFrame,
    cfg: ExperimentConfig,
    model: BoostedClassifier,
    labels: EventLabelConfig,
    policy: PolicyConfig,
) -> WalkForwardResult:
    """Buy/hold/sell classifiers per split, replayed from cash over each test window.

    ``features`` has the event model's columns and the close. Validity is taken before scaling
    fills warm-up gaps; labels use raw gaps and train returns only. A split without a whole training
    row has no classifiers, so nothing is bought in it: its portfolio stays in cash.
    """
    splits = cut_lineage(check_splits(walk_forward_splits(calendar, cfg.walk_forward)))
    valid = event_panel(features).select("date", "ticker", "feature_valid")
    scaled = prepared_splits(features.select("date", "ticker", *EVENT_MODEL), splits, cfg)
    prepared = cut_lineage(scaled.join(valid, ["date", "ticker"]))
    raw = features.select(F.col("date").alias("decision_date"), "ticker", "close", *GAPS).dropna()
    if splits.isEmpty():
        raise ValueError("The calendar is too short for a split.")
    train = prepared.filter(F.col("role") == "train").withColumnRenamed("date", "decision_date")
    by_split = ("split_index", "ticker")
    outcome = returns.join(raw, ["decision_date", "ticker"]).join(
        train.select("split_index", "decision_date", "ticker"), ["decision_date", "ticker"]
    )
    rows = train.join(event_labels(outcome, labels, keys=by_split), ["split_index", "decision_date", "ticker"])
    rows = cut_lineage(pooled_training_rows(rows, "valid", "feature_valid"))
    fitted = fit_classifiers(rows, EVENT_MODEL, model, cfg.seed, ("split_index",))
    test = prepared.filter(F.col("role") == "test").withColumnRenamed("date", "decision_date")
    scored = predict_probabilities(fitted, test).withColumnRenamed("feature_valid", "tradable")
    known = {p: F.coalesce(p, F.lit(0.0)) for p in PROBABILITIES}
    scored = scored.withColumns({"tradable": F.col("tradable") & F.col("p_buy").isNotNull(), **known})
    steps = scored.join(returns.select("decision_date", "ticker", "return"), ["decision_date", "ticker"])
    named = F.concat(F.lit("event_"), F.col("split_index").cast("string"))
    acted = replay(steps.withColumn("portfolio_id", named), policy)
    # a position whose name does not trade on a date is kept, as the replay keeps it
    return evaluate(cut_lineage(acted), returns, benchmark, splits, cfg, strict=False)
