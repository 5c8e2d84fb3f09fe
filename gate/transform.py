"""Preprocessing, walk-forward splits, labels and datasets."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gate.base import BARS, RETURNS, WEEKLY, add, bars, sig, sig_sql, sigs, sigs_sql, with_sql
from gate.features import EXPR, features_sql
from gate.market import returns, weekly
from tapeweave.config import EventLabelConfig, PreprocessConfig, Transform, WalkForwardConfig
from tapeweave.operators import cross_section as xs
from tapeweave.operators import datasets, labels, preprocess, splits
from tapeweave.operators.asset_features import asset_features
from tapeweave.operators.routing import EVENT_MODEL

W = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {} AND {})"


def raw(s, sf):
    """Bars with gaps, and a value constant over stretches, to exercise filling and zero spread."""
    return bars(s, sf).select(
        "date",
        "ticker",
        F.when(F.col("volume") % 5 != 0, F.col("close")).alias("price"),
        F.when(F.col("volume") % 7 == 0, float("inf")).otherwise(F.col("volume").cast("double")).alias("size"),
        F.floor(F.year("date") / 2).cast("double").alias("era"),
        (F.col("volume") % 10 / 10.0).alias("size_percentile_rank"),
    )


RAW = """raw AS (SELECT date, ticker, CASE WHEN volume % 5 <> 0 THEN close END AS price,
  CASE WHEN volume % 7 <> 0 THEN volume::DOUBLE END AS size, floor(year(date) / 2) AS era,
  volume % 10 / 10.0 AS size_percentile_rank FROM bars)"""


def _fill(x: str, part: str = "ticker") -> str:
    return f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY date ROWS UNBOUNDED PRECEDING), 0)"


def _z(x: str, n: int, lagged: bool = False, part: str = "ticker", least: int = 2) -> str:
    a, b = (f"{n} PRECEDING", "1 PRECEDING") if lagged else (f"{n - 1} PRECEDING", "CURRENT ROW")
    w = f"OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN {a} AND {b})"
    return f"CASE WHEN count({x}) {w} >= {least} THEN coalesce(({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0), 0) ELSE 0 END"


CLIP = PreprocessConfig(
    rolling_window=30,
    clip_upper=40000.0,
    transforms=(
        Transform("size", "clipped_passthrough", clip_lower=5.0, clip_upper=45.0),
        Transform("era", "lagged_rolling_zscore", rolling_periods=15, min_periods=3),
    ),
)
add(
    "p1_p6_mixed_transforms",
    lambda s, sf: preprocess.preprocess(raw(s, sf), CLIP).select("date", "ticker", *sigs("price", "size", "era", "size_percentile_rank")),
    with_sql(BARS, RAW)
    + f""", f AS (SELECT date, ticker, {_fill('CASE WHEN price IS NOT NULL THEN least(price, 40000) END')} AS price, {_fill("least(greatest(coalesce(size, 'infinity'::DOUBLE), 5), 45)")} AS size,
  {_fill('least(era, 40000)')} AS era, size_percentile_rank FROM raw)
SELECT date, ticker, {sig_sql(_z('price', 30), 'price')}, {sigs_sql('size')}, {sig_sql(_z('era', 15, True, least=3), 'era')}, {sigs_sql('size_percentile_rank')} FROM f""",
)
add(
    "p2_clip",
    lambda s, sf: raw(s, sf).select("date", "ticker", sig(preprocess.clipped("price", PreprocessConfig(clip_lower=9000.0, clip_upper=20000.0)), "price")),
    with_sql(BARS, RAW) + f"\nSELECT date, ticker, {sig_sql('CASE WHEN price IS NOT NULL THEN greatest(least(price, 20000), 9000) END', 'price')} FROM raw",
)
add(
    "p3_fill",
    lambda s, sf: preprocess.preprocess(raw(s, sf), PreprocessConfig(scale=False, fill_null_value=0.0)).select("date", "ticker", *sigs("price", "size")),
    with_sql(BARS, RAW) + f"\nSELECT date, ticker, {sig_sql(_fill('price'), 'price')}, {sig_sql(_fill('size'), 'size')} FROM raw",
)
add(
    "p4_rolling_zscore",
    lambda s, sf: preprocess.preprocess(raw(s, sf), PreprocessConfig(rolling_window=252)).select("date", "ticker", *sigs("price", "size", "era")),
    with_sql(BARS, RAW)
    + f""", f AS (SELECT date, ticker, {_fill('price')} AS price, {_fill('size')} AS size, era FROM raw)
SELECT date, ticker, """
    + ", ".join(sig_sql(_z(c, 252), c) for c in ("price", "size", "era"))
    + " FROM f",
)
LAGGED = PreprocessConfig(transforms=tuple(Transform(c, "lagged_rolling_zscore", rolling_periods=60) for c in ("price", "size")))
add(
    "p5_lagged_rolling_zscore",
    lambda s, sf: preprocess.preprocess(raw(s, sf), LAGGED).select("date", "ticker", *sigs("price", "size")),
    with_sql(BARS, RAW)
    + f""", f AS (SELECT date, ticker, {_fill('price')} AS price, {_fill('size')} AS size FROM raw)
SELECT date, ticker, {sig_sql(_z('price', 60, True), 'price')}, {sig_sql(_z('size', 60, True), 'size')} FROM f""",
)

SPLIT = WalkForwardConfig(train_years=3)


def split_table(s, sf, cfg=SPLIT):
    return splits.walk_forward_splits(weekly(s, sf), cfg)


def splits_sql(train: int = 3, test: int = 1, step: int = 1, expanding: bool = False) -> str:
    begin = "y0" if expanding else f"y0 + n * {step}"
    end = f"y0 + {train} - 1 + n * {step}"
    return f"""splits AS (SELECT row_number() OVER (ORDER BY n) - 1 AS split_index, make_date({begin}, 1, 1) AS train_start,
  make_date({end}, 12, 31) AS train_end, make_date({end} + 1, 1, 1) AS test_start, make_date({end} + {test}, 12, 31) AS test_end
  FROM (SELECT min(year(decision_date)) AS y0, max(year(decision_date)) AS y1 FROM weekly), (SELECT range AS n FROM range(0, 100))
  WHERE {end} + {test} <= y1
    AND EXISTS (SELECT 1 FROM weekly WHERE decision_date BETWEEN make_date({begin}, 1, 1) AND make_date({end}, 12, 31))
    AND EXISTS (SELECT 1 FROM weekly WHERE decision_date BETWEEN make_date({end} + 1, 1, 1) AND make_date({end} + {test}, 12, 31)))"""


TAGGED = """tagged AS (SELECT r.*, split_index, CASE WHEN date <= train_end THEN 'train' ELSE 'test' END AS role
  FROM raw r JOIN splits ON date BETWEEN train_start AND test_end)"""
add(
    "p8_split_preprocessing",
    lambda s, sf: preprocess.preprocess_splits(splits.assign_splits(raw(s, sf), split_table(s, sf)), PreprocessConfig(rolling_window=60)).select(
        "split_index", "date", "ticker", "role", *sigs("price", "size", "size_percentile_rank")
    ),
    with_sql(BARS, WEEKLY, RAW, splits_sql(), TAGGED)
    + f""", f AS (SELECT split_index, role, date, ticker, {_fill('price', 'split_index, ticker')} AS price, {_fill('size', 'split_index, ticker')} AS size, size_percentile_rank FROM tagged)
SELECT split_index, date, ticker, role, {sig_sql(_z('price', 60, part='split_index, ticker'), 'price')}, {sig_sql(_z('size', 60, part='split_index, ticker'), 'size')}, {sigs_sql('size_percentile_rank')} FROM f""",
)
add(
    "p10_fit_windows",
    lambda s, sf: preprocess.fit_windows(splits.assign_splits(raw(s, sf), split_table(s, sf)), ("split_index", "role")),
    with_sql(BARS, WEEKLY, RAW, splits_sql(), TAGGED)
    + "\nSELECT split_index, role, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM tagged GROUP BY ALL",
)
add(
    "p11_zscore_by_ticker",
    lambda s, sf: xs.zscore_by_ticker(raw(s, sf).select("date", "ticker", "price"), ["price"]).select("date", "ticker", sig("price")),
    with_sql(BARS, RAW) + f"\nSELECT date, ticker, {sig_sql('(price - avg(price) OVER t) / nullif(stddev_samp(price) OVER t, 0)', 'price')} FROM raw WINDOW t AS (PARTITION BY ticker)",
)
add(
    "p11_cross_section_at_date",
    lambda s, sf: xs.sample_zscore_at(raw(s, sf), ["price", "era"], "1999-06-15").select("ticker", *sigs("price", "era")),
    with_sql(BARS, RAW)
    + f"\nSELECT ticker, {sig_sql('coalesce((price - avg(price) OVER ()) / nullif(stddev_samp(price) OVER (), 0), 0)', 'price')}, {sig_sql('0.0', 'era')} FROM raw WHERE date = DATE '1999-06-15'",
)
add(
    "p11_smoothed",
    lambda s, sf: xs.smoothed(raw(s, sf).select("date", "ticker", "price"), ["price"], 10).select("date", "ticker", sig("price")),
    with_sql(BARS, RAW) + f"\nSELECT date, ticker, {sig_sql('avg(price) ' + W.format('9 PRECEDING', 'CURRENT ROW'), 'price')} FROM raw",
)
add(
    "p12_cross_sectional_zscore",
    lambda s, sf: xs.cross_sectional_zscore(bars(s, sf), "close", "z").select("date", "ticker", sig("z")),
    with_sql(BARS)
    + f"\nSELECT date, ticker, {sig_sql('CASE WHEN stddev_pop(close) OVER d > 0 THEN (close - avg(close) OVER d) / stddev_pop(close) OVER d ELSE 0 END', 'z')} FROM bars WINDOW d AS (PARTITION BY date)",
)

# Splits --------------------------------------------------------------------
BOUNDS = ["train_start", "train_end", "test_start", "test_end"]
for label, cfg, args in (
    ("rolling", SPLIT, {}),
    ("expanding", WalkForwardConfig(train_years=2, test_years=2, step_years=2, expanding=True), {"train": 2, "test": 2, "step": 2, "expanding": True}),
):
    add(
        f"s1_{label}_splits",
        lambda s, sf, c=cfg: split_table(s, sf, c).select("split_index", *BOUNDS),
        with_sql(BARS, WEEKLY, splits_sql(**args)) + f"\nSELECT split_index, {', '.join(BOUNDS)} FROM splits",
    )
add(
    "s2_split_calendar",
    lambda s, sf: splits.split_calendar(bars(s, sf).select("date")),
    with_sql(BARS) + "\nSELECT * FROM (SELECT date AS decision_date, date AS execution_date, lead(date) OVER (ORDER BY date) AS next_execution_date FROM (SELECT DISTINCT date FROM bars)) WHERE next_execution_date IS NOT NULL",
)
add(
    "s3_split_violations",
    lambda s, sf: splits.split_violations(split_table(s, sf).withColumn("train_end", F.date_add("train_end", 400 * (F.col("split_index") % 2).cast("int")))).select("split_index", *BOUNDS),
    with_sql(BARS, WEEKLY, splits_sql())
    + "\nSELECT split_index, train_start, CAST(train_end + (400 * (split_index % 2))::INT AS DATE) AS train_end, test_start, test_end FROM splits WHERE split_index % 2 = 1",
)
add(
    "s4_rows_per_split",
    lambda s, sf: splits.assign_splits(returns(s, sf), split_table(s, sf), "decision_date").select("split_index", "role", "decision_date", "ticker", sig("return", "ret")),
    with_sql(BARS, WEEKLY, RETURNS, splits_sql())
    + f"\nSELECT split_index, CASE WHEN decision_date <= train_end THEN 'train' ELSE 'test' END AS role, decision_date, ticker, {sig_sql('ret')} FROM returns JOIN splits ON decision_date BETWEEN train_start AND test_end",
)
add(
    "s5_purged_train_rows",
    lambda s, sf: splits.purge_train_tail(splits.assign_splits(returns(s, sf), split_table(s, sf), "decision_date"), 6, "decision_date").select("split_index", "role", "decision_date", "ticker"),
    with_sql(BARS, WEEKLY, RETURNS, splits_sql())
    + """, x AS (SELECT split_index, CASE WHEN decision_date <= train_end THEN 'train' ELSE 'test' END AS role, decision_date, ticker FROM returns JOIN splits ON decision_date BETWEEN train_start AND test_end)
SELECT split_index, role, decision_date, ticker FROM (SELECT *, row_number() OVER (PARTITION BY split_index, ticker, role ORDER BY decision_date DESC) AS n FROM x) WHERE role = 'test' OR n > 5""",
)

# Labels --------------------------------------------------------------------
def _ahead(h: int, ret: str = "ret", order: str = "decision_date") -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY {order} ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
    return f"CASE WHEN count({ret}) {w} = {h} THEN product(1 + {ret}) {w} - 1 END"


add(
    "l1_forward_return_targets",
    lambda s, sf: labels.forward_return_targets(returns(s, sf), (2, 5, 8), (1.0, 2.0, 1.0)).select("decision_date", "ticker", sig("target")),
    with_sql(BARS, WEEKLY, RETURNS)
    + f""", t AS (SELECT decision_date, ticker, {_ahead(2)} AS a, {_ahead(5)} AS b, {_ahead(8)} AS c FROM returns)
SELECT decision_date, ticker, {sig_sql('a * 0.25 + b * 0.5 + c * 0.25', 'target')} FROM t WHERE c IS NOT NULL""",
)
LABEL = EventLabelConfig(outcome_horizon=4, round_trip_cost=0.002)


def label_rows(s, sf):
    gaps = asset_features(bars(s, sf)).select(F.col("date").alias("decision_date"), "ticker", "close", *labels.GAPS)
    rows = returns(s, sf).select("decision_date", "ticker", "return").join(gaps, ["decision_date", "ticker"])
    return rows.filter(F.col("close_vwap20_gap").isNotNull())


LABEL_CTES = [
    WEEKLY,
    RETURNS,
    f"fv AS (SELECT date, ticker, close, {EXPR['close_ema20_gap']} AS g20, {EXPR['close_ema50_gap']} AS g50, {EXPR['close_vwap20_gap']} AS gv FROM k)",
    "lr AS (SELECT r.decision_date, r.ticker, r.ret, close, g20, g50, gv FROM returns r JOIN fv ON fv.date = r.decision_date AND fv.ticker = r.ticker WHERE gv IS NOT NULL)",
    """lp AS (SELECT *, row_number() OVER o AS n, lag(g20) OVER o AS q20, lag(g50) OVER o AS q50, lag(gv) OVER o AS qv,
  lead(ret, 1) OVER o AS r1, lead(ret, 2) OVER o AS r2, lead(ret, 3) OVER o AS r3 FROM lr WINDOW o AS (PARTITION BY ticker ORDER BY decision_date))""",
    """lb AS (SELECT *, (1+ret)*(1+r1)*(1+r2)*(1+r3) - 1 AS e, least(ret, (1+ret)*(1+r1)-1, (1+ret)*(1+r1)*(1+r2)-1, (1+ret)*(1+r1)*(1+r2)*(1+r3)-1) AS worst,
  coalesce((g20 > 0 AND q20 <= 0) OR (g50 > 0 AND q50 <= 0) OR (gv > 0 AND qv <= 0), false) AS up,
  coalesce((g20 < 0 AND q20 >= 0) OR (g50 < 0 AND q50 >= 0) OR (gv < 0 AND qv >= 0), false) AS dn FROM lp WHERE r3 IS NOT NULL)""",
    """labeled AS (SELECT decision_date, ticker, (up AND e >= 0.05 + 0.002) AS buy, (g20 >= 0 OR gv >= 0 OR g50 >= -0.01 * close) AS hold,
  (dn AND worst <= -(0.05 + 0.002)) AS sell, n > 1 AS valid FROM lb)""",
]
add(
    "l2_event_labels",
    lambda s, sf: labels.event_labels(label_rows(s, sf), LABEL).select("decision_date", "ticker", *[F.col(c).cast("int").alias(c) for c in ("buy", "hold", "sell")]),
    features_sql("SELECT decision_date, ticker, buy::INT AS buy, hold::INT AS hold, sell::INT AS sell FROM labeled", extra=LABEL_CTES),
)
add(
    "l3_label_validity",
    lambda s, sf: labels.event_labels(label_rows(s, sf), LABEL).select("decision_date", "ticker", F.col("valid").cast("int").alias("valid")),
    features_sql("SELECT decision_date, ticker, valid::INT AS valid FROM labeled", extra=LABEL_CTES),
)
add(
    "l4_label_input_problems",
    lambda s, sf: labels.label_input_problems(
        asset_features(bars(s, sf)).withColumn("return", F.col("mom_21d"))
    ),
    features_sql(
        f"""SELECT count(*) FILTER (m IS NULL) AS bad_return, 0 AS bad_close, 0 AS bad_close_ema20_gap, 0 AS bad_close_ema50_gap,
count(*) FILTER (v IS NULL) AS bad_close_vwap20_gap, 0 AS bad_price FROM (SELECT {EXPR['mom_21d']} AS m, {EXPR['close_vwap20_gap']} AS v FROM k)"""
    ),
)


def training_rows(s, sf):
    """Label rows joined to the event panel at decision dates."""
    panel = datasets.event_panel(asset_features(bars(s, sf))).withColumnRenamed("date", "decision_date")
    marked = labels.event_labels(label_rows(s, sf), LABEL)
    return marked.join(panel, ["decision_date", "ticker"])


VALID = " AND ".join(f"({EXPR[c]}) IS NOT NULL" for c in EVENT_MODEL)
POOLED = [*LABEL_CTES, f"fok AS (SELECT date AS decision_date, ticker, {VALID} AS ok FROM k)", "pooled AS (SELECT l.* FROM labeled l JOIN fok USING (decision_date, ticker) WHERE valid AND ok)"]
add(
    "l5_pooled_training_rows",
    lambda s, sf: datasets.pooled_training_rows(training_rows(s, sf), "valid", "feature_valid").select("decision_date", "ticker", F.col("buy").cast("int").alias("buy")),
    features_sql("SELECT decision_date, ticker, buy::INT AS buy FROM pooled", extra=POOLED),
)
add(
    "l6_balanced_weights",
    lambda s, sf: datasets.balanced_weights(labels.event_labels(label_rows(s, sf), LABEL)).select("decision_date", "ticker", *sigs("buy_weight", "hold_weight", "sell_weight")),
    features_sql(
        "SELECT decision_date, ticker, "
        + ", ".join(sig_sql(f"count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY {c}))", f"{c}_weight") for c in ("buy", "hold", "sell"))
        + " FROM labeled",
        extra=LABEL_CTES,
    ),
)
add(
    "l7_assembled_vectors",
    lambda s, sf: datasets.assembled(asset_features(bars(s, sf)).select("date", "ticker", "natr_20", "near_52w_high"), ["natr_20", "near_52w_high"])
    .select("date", "ticker", vector_to_array("features").alias("v"))
    .select("date", "ticker", sig(F.col("v")[0], "natr_20"), sig(F.col("v")[1], "near_52w_high")),
    features_sql(f"SELECT date, ticker, {sig_sql(EXPR['natr_20'], 'natr_20')}, {sig_sql(EXPR['near_52w_high'], 'near_52w_high')} FROM k"),
)
add(
    "l8_filled_panel",
    lambda s, sf: datasets.feature_panel(asset_features(bars(s, sf)), ["mom_21d", "close_vwap20_gap", "realized_vol_126"]).select("date", "ticker", *sigs("mom_21d", "close_vwap20_gap", "realized_vol_126")),
    features_sql("SELECT date, ticker, " + ", ".join(sig_sql(f"coalesce({EXPR[c]}, 0)", c) for c in ("mom_21d", "close_vwap20_gap", "realized_vol_126")) + " FROM k"),
)
add(
    "l9_event_panel",
    lambda s, sf: datasets.event_panel(asset_features(bars(s, sf))).select("date", "ticker", F.col("feature_valid").cast("int").alias("feature_valid"), *sigs("mom_126_21d", "ema200_slope")),
    features_sql(f"SELECT date, ticker, CAST({VALID} AS INT) AS feature_valid, " + ", ".join(sig_sql(f"coalesce({EXPR[c]}, 0)", c) for c in ("mom_126_21d", "ema200_slope")) + " FROM k"),
)


def _future(h: int) -> str:
    return f"lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / close - 1"


def _future_low(h: int) -> str:
    return f"min(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1"


HORIZONS = (5, 20, 60, 120)
add(
    "l10_future_returns",
    lambda s, sf: labels.study_labels(bars(s, sf)).select("date", "ticker", *sigs(*[f"future_return_{h}d" for h in HORIZONS])),
    with_sql(BARS) + "\nSELECT date, ticker, " + ", ".join(sig_sql(_future(h), f"future_return_{h}d") for h in HORIZONS) + " FROM bars",
)
add(
    "l11_future_drawdowns",
    lambda s, sf: labels.study_labels(bars(s, sf)).select("date", "ticker", *sigs(*[f"future_max_drawdown_{h}d" for h in HORIZONS])),
    with_sql(BARS) + "\nSELECT date, ticker, " + ", ".join(sig_sql(_future_low(h), f"future_max_drawdown_{h}d") for h in HORIZONS) + " FROM bars",
)
STUDY_FEATURES = ["cmf", "mom_21d", "natr_20", "ewma50_slope"]
STUDY_LABELS = ["future_return_5d", "future_return_60d", "future_max_drawdown_20d"]
# Both engines round to nine decimals here, so that equal values tie whatever the summation order.
STUDY_CTE = f"""study AS (SELECT * FROM (SELECT date, ticker, close, {', '.join(f'round({EXPR[c]}, 9) AS x_{c}' for c in STUDY_FEATURES)},
  round({_future(5)}, 9) AS x_future_return_5d, round({_future(60)}, 9) AS x_future_return_60d, round({_future_low(20)}, 9) AS x_future_max_drawdown_20d FROM k)
  WHERE {' AND '.join(f'x_{c} IS NOT NULL' for c in [*STUDY_FEATURES, *STUDY_LABELS])})"""


def study(s, sf):
    b = bars(s, sf)
    rows = datasets.study_dataset(asset_features(b), labels.study_labels(b, (5, 60), (20,)), STUDY_FEATURES, STUDY_LABELS)
    return rows.withColumns({c: F.round(c, 9) for c in (*STUDY_FEATURES, *STUDY_LABELS)})


add(
    "l12_study_dataset",
    lambda s, sf: study(s, sf).select("date", "ticker", *sigs(*STUDY_FEATURES, *STUDY_LABELS)),
    features_sql("SELECT date, ticker, " + ", ".join(sig_sql(f"x_{c}", c) for c in [*STUDY_FEATURES, *STUDY_LABELS]) + " FROM study", extra=[STUDY_CTE]),
)
