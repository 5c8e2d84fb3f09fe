"""Models and whole plans. Whole ensembles have no SQL equivalent; a tree of three leaves has, per model and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate.base import BARS, RETURNS, WEEKLY, add, bars, bench, macro, sig_sql, sigs, sigs_sql, with_sql
from gate.features import features_sql
from gate.market import market_returns, returns, routed_sql, weekly
from gate.portfolio import BASE, LEDGER, PERIOD_SQL, PW, metrics_sql
from gate.transform import POOLED, split_table, splits_sql, training_rows
from tapeweave.config import (
    BoostedClassifier,
    BoostedRegression,
    EventLabelConfig,
    ExperimentConfig,
    FeatureConfig,
    LedgerConfig,
    PolicyConfig,
    WalkForwardConfig,
)
from tapeweave.operators import datasets, metrics, models
from tapeweave.operators.asset_features import asset_features
from tapeweave.operators.calendar import keep_dates
from tapeweave.operators.labels import forward_return_targets
from tapeweave.operators.routing import EVENT_MODEL, feature_set
from tapeweave.operators.splits import assign_splits
from tapeweave.plans.bundle import feature_bundle
from tapeweave.plans.efficacy_study import run_study
from tapeweave.plans.walk_forward import event_walk_forward, prepared_splits, rule_walk_forward, score_walk_forward
from tapeweave.session import cut_lineage
from tapeweave.sources.storage import MarketBundle

COLUMNS = ("cmf", "natr_20", "near_52w_high", "volume_z_20")
SMALL = BoostedRegression(n_estimators=3, max_depth=3, learning_rate=0.1, target_horizons=(1, 4), target_weights=(1.0, 1.0))
TREES = BoostedClassifier(max_iter=2, max_depth=3, learning_rate=0.1)
EXPERIMENT = ExperimentConfig(walk_forward=WalkForwardConfig(train_years=4, test_years=1, step_years=1), ledger=LedgerConfig(cost_rate=0.001))


def decision_features(s, sf, calendar, columns=COLUMNS):
    dates = calendar.select(F.col("decision_date").alias("date"))
    return cut_lineage(keep_dates(asset_features(bars(s, sf)), dates).select("date", "ticker", "close", *columns))


def benchmark(s, sf, calendar):
    return market_returns(s, sf, calendar).select("decision_date", F.col("return").alias("benchmark_return"))


def _scored(s, sf):
    calendar = weekly(s, sf)
    rows = decision_features(s, sf, calendar).withColumnRenamed("date", "decision_date").fillna(0.0)
    target = forward_return_targets(returns(s, sf, calendar), SMALL.target_horizons)
    model = models.fit_regressor(rows.join(target, ["decision_date", "ticker"]), COLUMNS, SMALL, 7)
    return models.predict_scores(model, rows, COLUMNS).select("decision_date", "ticker", "score")


def _probabilities(s, sf):
    rows = cut_lineage(datasets.pooled_training_rows(training_rows(s, sf), "valid", "feature_valid"))
    model = models.fit_classifiers(rows, EVENT_MODEL, TREES, 7)
    return models.predict_probabilities(model, rows).select("decision_date", "ticker", "p_buy", "p_hold", "p_sell")


def _split_scores(s, sf):
    calendar = weekly(s, sf)
    features = decision_features(s, sf, calendar).drop("close")
    tagged = prepared_splits(features, split_table(s, sf), EXPERIMENT)
    return models.split_scores(tagged, returns(s, sf, calendar), COLUMNS, SMALL, 7)


def _rules(s, sf):
    calendar = weekly(s, sf)
    return rule_walk_forward(
        decision_features(s, sf, calendar), returns(s, sf, calendar), benchmark(s, sf, calendar), calendar, EXPERIMENT
    ).split_metrics


def _boosted(s, sf):
    calendar = weekly(s, sf)
    features = decision_features(s, sf, calendar).drop("close")
    return score_walk_forward(
        features, COLUMNS, returns(s, sf, calendar), benchmark(s, sf, calendar), calendar, EXPERIMENT, SMALL
    ).total_metrics


def _events(s, sf):
    calendar = weekly(s, sf)
    labels = EventLabelConfig(outcome_horizon=4)
    policy = PolicyConfig(buy_threshold=0.45, hold_threshold=0.3, sell_threshold=0.7)
    features = decision_features(s, sf, calendar, EVENT_MODEL)
    return event_walk_forward(
        features, returns(s, sf, calendar), benchmark(s, sf, calendar), calendar, EXPERIMENT, BoostedClassifier(), labels, policy
    ).split_metrics


def _bundle(s, sf):
    market = MarketBundle(bars(s, sf), bench(s, sf), macro(s, sf), weekly(s, sf))
    cfg = FeatureConfig(feature_set=BUNDLE)
    return feature_bundle(market, cfg).assets


add("g1_g2_pooled_scores", _scored)
add("g3_g4_action_probabilities", _probabilities)
add("g6_split_scores", _split_scores)
add("g6_boosted_walk_forward", _boosted)
add("k13_event_walk_forward", _events)


# Fits small enough for SQL: one tree of three leaves on two raw columns, four bins. Scores are compared row by row.
TINY = BoostedRegression(
    n_estimators=1, learning_rate=0.1, num_leaves=3, min_child_samples=20, reg_alpha=0.05, reg_lambda=1.0, max_bins=4, target_horizons=(1, 4),
    target_weights=(1.0, 1.0),
)
TINY_CLASSES = BoostedClassifier(max_iter=1, learning_rate=0.1, max_leaf_nodes=3, l2_regularization=1.0, max_bins=4)
RAW = ("close", "volume")


def tree_sql(train: str, test: str, least: int, alpha: float, l2: float, rate: float, bins: int, logistic: bool = False) -> list[str]:
    """CTEs of a tree of three leaves per model ``m``: ``fitted`` gives every test row its score.

    ``train`` selects m, x0, x1, y, w and ``test`` m, x0, x1 with further columns.
    """
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {alpha}, 0))"
    worth = lambda g, h: f"{soft(g)} * {soft(g)} / ({h} + {l2})"
    x = lambda f: f"CASE {f} WHEN 0 THEN x0 ELSE x1 END"
    node = f"CASE WHEN {x('s.f')} <= s.c THEN 'L' ELSE 'R' END"

    def best(rows: str, by: str) -> str:
        return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY gain DESC, f, c) AS place FROM (
    SELECT {by}, f, c, {worth('gl', 'hl')} + {worth('(g - gl)', '(h - hl)')} - {worth('g', 'h')} AS gain FROM (
      SELECT {', '.join('r.' + b for b in by.split(', '))}, k.f, k.c, sum(g) AS g, sum(h) AS h, count(*) AS n, sum(g) FILTER ({x('k.f')} <= k.c) AS gl,
        sum(h) FILTER ({x('k.f')} <= k.c) AS hl, count(*) FILTER ({x('k.f')} <= k.c) AS nl
      FROM {rows} r JOIN cuts k ON k.m = r.m GROUP BY ALL) WHERE nl >= {least} AND n - nl >= {least}) WHERE gain > 0) WHERE place = 1)"""

    full = f"""CASE WHEN s.f IS NULL THEN '' ELSE ({node}) || CASE WHEN t.node = ({node}) THEN
    CASE WHEN {x('t.f')} <= t.c THEN 'l' ELSE 'r' END ELSE '' END END"""
    return [
        f"train_rows AS ({train})",
        f"test_rows AS ({test})",
        "mean AS (SELECT m, sum(w * y) / sum(w) AS p FROM train_rows GROUP BY m)",
        f"grad AS (SELECT a.m, x0, x1, w * (p - y) AS g, w{' * p * (1 - p)' if logistic else ''} AS h FROM train_rows a JOIN mean USING (m))",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY m, f ORDER BY x) AS i, count(*) OVER (PARTITION BY m, f) AS n,
  max(x) OVER (PARTITION BY m, f) AS top FROM (SELECT m, 0 AS f, x0 AS x FROM train_rows UNION ALL SELECT m, 1, x1 FROM train_rows))""",
        f"""cuts AS (SELECT DISTINCT m, f, x AS c FROM ranked JOIN (SELECT m, f, count(DISTINCT x) AS d FROM ranked GROUP BY m, f) USING (m, f)
  WHERE x < top AND (d <= {bins} OR list_contains(list_transform(range(1, {bins}), lambda j: (n * j + {bins - 1}) // {bins}), i)))""",
        f"one AS {best('grad', 'm')}",
        f"halves AS (SELECT r.*, {node} AS node FROM grad r JOIN one s ON s.m = r.m)",
        f"two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY gain DESC, node) AS nth FROM {best('halves', 'm, node')}) WHERE nth = 1)",
        f"leaves AS (SELECT r.m, {full} AS leaf, -{rate} * {soft('sum(g)')} / (sum(h) + {l2}) AS v FROM grad r LEFT JOIN one s ON s.m = r.m LEFT JOIN two t ON t.m = r.m GROUP BY ALL)",
        f"placed AS (SELECT r.*, {full} AS leaf FROM test_rows r LEFT JOIN one s ON s.m = r.m LEFT JOIN two t ON t.m = r.m)",
        f"fitted AS (SELECT a.*, {'ln(p / (1 - p))' if logistic else 'p'} + v AS score FROM placed a JOIN mean USING (m) JOIN leaves l ON l.m = a.m AND l.leaf = a.leaf)",
    ]


def ahead_sql(horizons, window: str) -> str:
    """The equally weighted compounded returns of the next rows; null without the longest path."""
    path = lambda h: f"(product(1 + ret) OVER ({window} ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) - 1)"
    whole = f"count(ret) OVER ({window} ROWS BETWEEN CURRENT ROW AND {horizons[-1] - 1} FOLLOWING) = {horizons[-1]}"
    return f"CASE WHEN {whole} THEN ({' + '.join(map(path, horizons))}) / {len(horizons)} END"


def raw_rows(s, sf, calendar):
    dates = calendar.select(F.col("decision_date").alias("date"))
    return keep_dates(bars(s, sf), dates).select("date", "ticker", "close", F.col("volume").cast("double").alias("volume"))


def _tiny_scores(s, sf):
    calendar = weekly(s, sf)
    rows = raw_rows(s, sf, calendar).withColumnRenamed("date", "decision_date")
    target = forward_return_targets(returns(s, sf, calendar), TINY.target_horizons)
    model = models.fit_regressor(rows.join(target, ["decision_date", "ticker"]), RAW, TINY, 7)
    return models.predict_scores(model, rows, RAW).select("decision_date", "ticker", *sigs("score"))


def _tiny_probabilities(s, sf):
    rows = datasets.pooled_training_rows(training_rows(s, sf), "valid", "feature_valid").select("decision_date", "ticker", "buy", "hold", "sell")
    raw = bars(s, sf).select(F.col("date").alias("decision_date"), "ticker", "close", F.col("volume").cast("double").alias("volume"))
    rows = cut_lineage(rows.join(raw, ["decision_date", "ticker"]))
    model = models.fit_classifiers(rows, RAW, TINY_CLASSES, 7)
    return models.predict_probabilities(model, rows).select("decision_date", "ticker", *sigs("p_buy", "p_hold", "p_sell"))


def _tiny_split_scores(s, sf):
    calendar = weekly(s, sf)
    tagged = assign_splits(raw_rows(s, sf, calendar), split_table(s, sf))
    return models.split_scores(tagged, returns(s, sf, calendar), RAW, TINY, 7).select("split_index", "date", "ticker", *sigs("score"))


_TINY = dict(least=TINY.min_child_samples, alpha=TINY.reg_alpha, l2=TINY.reg_lambda, rate=TINY.learning_rate, bins=TINY.max_bins)
_X = "close AS x0, volume::DOUBLE AS x1"
add(
    "g1_g2_contract",
    _tiny_scores,
    with_sql(
        BARS, WEEKLY, RETURNS,
        f"ahead AS (SELECT decision_date, ticker, {ahead_sql(TINY.target_horizons, 'PARTITION BY ticker ORDER BY decision_date')} AS y FROM returns)",
        *tree_sql(
            f"SELECT 0 AS m, {_X}, y, 1 AS w FROM bars b JOIN ahead a ON a.decision_date = b.date AND a.ticker = b.ticker WHERE y IS NOT NULL",
            f"SELECT 0 AS m, date AS decision_date, ticker, {_X} FROM bars WHERE date IN (SELECT decision_date FROM weekly)", **_TINY,
        ),
    )
    + f"\nSELECT decision_date, ticker, {sigs_sql('score')} FROM fitted",
)
_SIDES = " UNION ALL ".join(
    f"SELECT '{c}' AS m, decision_date, p.ticker, {_X}, {c}::INT AS y, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY {c})) AS w FROM pooled p JOIN bars b ON b.date = p.decision_date AND b.ticker = p.ticker"
    for c in ("buy", "hold", "sell")
)
add(
    "g3_g4_contract",
    _tiny_probabilities,
    features_sql(
        "SELECT decision_date, ticker, " + ", ".join(sig_sql(f"max(1 / (1 + exp(-score))) FILTER (m = '{c}')", f"p_{c}") for c in ("buy", "hold", "sell"))
        + " FROM fitted GROUP BY decision_date, ticker",
        extra=[*POOLED, f"sides AS ({_SIDES})"] + tree_sql(
            "SELECT m, x0, x1, y, w FROM sides", "SELECT m, decision_date, ticker, x0, x1 FROM sides", TINY_CLASSES.min_samples_leaf, 0.0,
            TINY_CLASSES.l2_regularization, TINY_CLASSES.learning_rate, TINY_CLASSES.max_bins, logistic=True,
        ),
    ),
)
_RANGE = "PARTITION BY split_index, ticker ORDER BY decision_date"
add(
    "g6_contract",
    _tiny_split_scores,
    with_sql(
        BARS, WEEKLY, RETURNS, splits_sql(),
        f"""ahead AS (SELECT split_index, decision_date, ticker, {ahead_sql(TINY.target_horizons, _RANGE)} AS y
  FROM returns r JOIN splits ON decision_date BETWEEN train_start AND train_end WHERE EXISTS (SELECT 1 FROM bars b WHERE b.date = r.decision_date AND b.ticker = r.ticker))""",
        f"""early AS (SELECT split_index, date, ticker, {_X}, row_number() OVER (PARTITION BY split_index, ticker ORDER BY date DESC) AS from_end
  FROM bars JOIN splits ON date BETWEEN train_start AND train_end WHERE date IN (SELECT decision_date FROM weekly))""",
        *tree_sql(
            f"SELECT split_index AS m, x0, x1, y, 1 AS w FROM early e JOIN ahead a USING (split_index, ticker) WHERE a.decision_date = e.date AND y IS NOT NULL AND from_end > {TINY.target_horizons[-1] - 1}",
            f"SELECT split_index AS m, date, ticker, {_X} FROM bars JOIN splits ON date BETWEEN test_start AND test_end WHERE date IN (SELECT decision_date FROM weekly)",
            **_TINY,
        ),
    )
    + f"\nSELECT m AS split_index, date, ticker, {sigs_sql('score')} FROM fitted",
)
TESTED = [
    *BASE, splits_sql(4),
    """tested AS (SELECT DISTINCT r.decision_date, r.ticker FROM returns r JOIN bars b ON b.date = r.decision_date AND b.ticker = r.ticker
  JOIN splits ON r.decision_date BETWEEN test_start AND test_end)""",
    PW.replace("FROM returns", "FROM tested"), LEDGER, PERIOD_SQL,
    """paths AS (SELECT p, split_index, decision_date, net, b, turnover, cost FROM lt
  UNION ALL SELECT DISTINCT 'BENCHMARK', split_index, decision_date, b, b, 0, 0 FROM lt)""",
]
add(
    "e10_rule_walk_forward",
    lambda s, sf: _rules(s, sf).select("portfolio_id", "split_index", *sigs(*metrics.METRICS)),
    with_sql(*TESTED, metrics_sql("paths", "p, split_index")) + f"\nSELECT p AS portfolio_id, split_index, {sigs_sql(*metrics.METRICS)} FROM met",
)
BUNDLE = "baseline_plus_liquidity_ranked"
add(
    "c6_feature_bundle",
    lambda s, sf: _bundle(s, sf).select("date", "ticker", *sigs(*feature_set(BUNDLE))),
    routed_sql(BUNDLE, "date IN (SELECT decision_date FROM weekly)", (WEEKLY,)),
)
add("y7_study", lambda s, sf: run_study(bars(s, sf), enabled=("cmf", "frog_in_the_pan"), columns=("cmf", "cmf_slope", "frog_in_the_pan"), horizons=(5, 60), controls=("cmf",)).partial)
