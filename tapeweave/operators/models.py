"""Pooled boosted-tree models, scored per date and ticker; all splits and classes are grown in the same jobs.

The trees are those of ``boosting``: leaf-wise, regularised, and the same under any partitioning. Nothing in a fit is drawn
at random, so a seed changes no score; it is kept with the model as part of its contract.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeweave.config import BoostedClassifier, BoostedRegression
from tapeweave.operators import boosting
from tapeweave.operators.datasets import LABELS, balanced_weights
from tapeweave.operators.labels import forward_return_targets
from tapeweave.operators.splits import purge_train_tail
from tapeweave.session import cut_lineage

LABEL = "__label"


def regression_trees(cfg: BoostedRegression) -> boosting.Trees:
    return boosting.Trees(
        n=cfg.n_estimators, rate=cfg.learning_rate, leaves=cfg.num_leaves, depth=None if cfg.max_depth == -1 else cfg.max_depth,
        least_rows=cfg.min_child_samples, alpha=cfg.reg_alpha, l2=cfg.reg_lambda, bins=cfg.max_bins,
    )


def classification_trees(cfg: BoostedClassifier) -> boosting.Trees:
    return boosting.Trees(
        n=cfg.max_iter, rate=cfg.learning_rate, leaves=cfg.max_leaf_nodes, depth=cfg.max_depth, least_rows=cfg.min_samples_leaf,
        l2=cfg.l2_regularization, bins=cfg.max_bins, logistic=True,
    )


@dataclass(frozen=True)
class ScoreModel:
    trees: boosting.Ensemble
    config: BoostedRegression
    features: tuple[str, ...]
    seed: int


def fit_regressor(rows: DataFrame, features, cfg: BoostedRegression, seed: int, target: str = "target", keys=()) -> ScoreModel:
    """A pooled regressor of the target on the routed features, one per value of ``keys``."""
    return ScoreModel(boosting.fit(rows, features, regression_trees(cfg), target, keys=keys), cfg, tuple(features), seed)


def predict_scores(model: ScoreModel, rows: DataFrame, features=None) -> DataFrame:
    """Add ``score``. The feature list must be the fitted one; non-finite inputs fail the job."""
    if features is not None and tuple(features) != model.features:
        raise ValueError("The model was fitted on other features.")
    missing = [f for f in model.features if f not in rows.columns]
    if missing:
        raise ValueError(f"The rows to score have no {missing}.")
    return boosting.predict(model.trees, rows)


@dataclass(frozen=True)
class ActionModel:
    """Trees per value of the keys and class."""

    trees: boosting.Ensemble
    features: tuple[str, ...]


def fit_classifiers(rows: DataFrame, features, cfg: BoostedClassifier, seed: int, keys=()) -> ActionModel:
    """Buy, hold and sell classifiers with class-balanced weights, for each value of ``keys``.

    Without a single row there are no classifiers, and every probability is null.
    """
    weighted = balanced_weights(rows, keys=keys)
    cases = [
        F.struct(F.lit(n).alias(LABEL), F.col(n).cast("double").alias("__y"), F.col(f"{n}_weight").alias("__w")) for n in LABELS
    ]
    cases = cut_lineage(weighted.select(*keys, *features, F.inline(F.array(*cases))))
    named = (*keys, LABEL)
    if cases.isEmpty():
        return ActionModel(boosting.Ensemble(tuple(features), named, (), (), ()), tuple(features))
    return ActionModel(boosting.fit(cases, features, classification_trees(cfg), "__y", "__w", named), tuple(features))


def predict_probabilities(model: ActionModel, rows: DataFrame) -> DataFrame:
    """Add ``p_buy``, ``p_hold`` and ``p_sell``: each classifier's probability of its event, null where none was fitted."""
    out = rows
    for label in LABELS:
        scored = boosting.predict(model.trees, out.withColumn(LABEL, F.lit(label)), "__z")
        out = scored.withColumn(f"p_{label}", 1 / (1 + F.exp(-F.col("__z")))).drop(LABEL, "__z")
    return out


def split_scores(
    tagged: DataFrame, returns: DataFrame, features, cfg: BoostedRegression, seed: int = 0, on: str = "date"
) -> DataFrame:
    """Fit on the purged train rows of every split and score its test rows, all splits in the same jobs.

    ``tagged`` holds prepared features per ``split_index`` and ``role``. Targets are built from each split's
    train returns only, so no label crosses into the test window.
    """
    tagged = cut_lineage(tagged)
    train = tagged.filter(F.col("role") == "train")
    held = returns.join(train.select("split_index", F.col(on).alias("decision_date"), "ticker"), ["decision_date", "ticker"])
    target = forward_return_targets(held, cfg.target_horizons, cfg.target_weights, keys=("split_index", "ticker"))
    kept = purge_train_tail(train, cfg.target_horizons[-1], on)
    data = cut_lineage(kept.join(target.withColumnRenamed("decision_date", on), ["split_index", on, "ticker"]))
    splits = {r.split_index for r in tagged.select("split_index").distinct().collect()}
    if not splits:
        raise ValueError("No walk-forward split to fit.")
    bare = splits - {r.split_index for r in data.select("split_index").distinct().collect()}
    if bare:
        raise ValueError(f"Splits {sorted(bare)} have no train row with all of its forward returns.")
    model = fit_regressor(data, features, cfg, seed, keys=("split_index",))
    test = tagged.filter(F.col("role") == "test").select("split_index", on, "ticker", *features)
    return predict_scores(model, test).select("split_index", on, "ticker", "score")


def save_model(spark: SparkSession, model: ScoreModel, folder: str) -> None:
    """The trees, and the feature contract beside them, as JSON."""
    contract = {"config": asdict(model.config), "features": list(model.features), "seed": model.seed}
    for name, text in (("trees", model.trees.to_json()), ("contract", json.dumps(contract))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def load_model(spark: SparkSession, folder: str) -> ScoreModel:
    contract = json.loads(spark.read.text(f"{folder}/contract").first().value)
    settings = {k: tuple(v) if isinstance(v, list) else v for k, v in contract["config"].items()}
    trees = boosting.Ensemble.from_json(spark.read.text(f"{folder}/trees").first().value)
    return ScoreModel(trees, BoostedRegression(**settings), tuple(contract["features"]), contract["seed"])
