"""Research desk, ranking and feature-efficacy statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate.base import BARS, add, bars, sig, sig_sql, sigs, sigs_sql, with_sql
from gate.features import EXPR, _lag, _roll, expressions, features_sql
from gate.transform import STUDY_CTE, STUDY_FEATURES, STUDY_LABELS, study
from tapeweave.config import DeskConfig, study_features
from tapeweave.operators import desk, efficacy, reporting
from tapeweave.operators.asset_features import asset_features
from tapeweave.plans.desk_scan import ranked_scan, scan_bars
from tapeweave.plans.efficacy_study import study_feature_table
from tapeweave.session import cut_lineage

CFG = DeskConfig()
P = "PARTITION BY ticker ORDER BY date"


def features(s, sf):
    return desk.desk_features(bars(s, sf), CFG)


def _z(x: str, n: int) -> str:
    w = f"OVER ({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {w} = {n} THEN ({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0) END"


def _carry(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING)"


def _pivot(x: str, over: str, keep: str) -> str:
    return " AND ".join([f"{x} {over} {_lag(x, k)}" for k in (1, 2, 3)] + [f"{x} {keep} {_lag(x, -k)}" for k in (1, 2, 3)])


DESK = [
    f"""b1 AS (SELECT *, close / pc - 1 AS r, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close * volume AS dv, (high + low + close) / 3 * volume AS tv
  FROM (SELECT *, row_number() OVER ({P}) - 1 AS pos, {_lag('close')} AS pc FROM bars))""",
    """ew AS (SELECT ticker, pos, tr AS xa, close AS x20, close AS x50, close AS x200 FROM b1 WHERE pos = 0
  UNION ALL SELECT b1.ticker, b1.pos, tr / 20 + xa * 0.95e0, 2e0/21 * close + (1 - 2e0/21) * x20, 2e0/51 * close + (1 - 2e0/51) * x50, 2e0/201 * close + (1 - 2e0/201) * x200
  FROM ew JOIN b1 ON b1.ticker = ew.ticker AND b1.pos = ew.pos + 1)""",
    f"""b2 AS (SELECT b1.*, CASE WHEN pos >= 19 THEN xa END AS atr, CASE WHEN pos >= 19 THEN x20 END AS ema_fast, CASE WHEN pos >= 49 THEN x50 END AS ema_mid, CASE WHEN pos >= 199 THEN x200 END AS ema_slow,
  CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END AS l2, abs(r) / nullif(dv, 0) AS imp, tr / pc AS rs, {_pivot('high', '>', '>=')} AS ph, {_pivot('low', '<', '<=')} AS pl,
  sum(tv) OVER ({P}) AS ctv, sum(volume) OVER ({P}) AS cv FROM b1 JOIN ew USING (ticker, pos))""",
    f"""b3 AS (SELECT *, {_roll('stddev_samp', 'r', 20, 20)} * sqrt(252e0) AS realized_vol_20, sqrt({_roll('avg', 'l2', 60, 60)} * 252) AS downside_vol_60,
  close / ({_roll('max', 'close', 126, 126)}) - 1 AS max_drawdown_126, close / {_lag('close', 21)} - 1 AS momentum_21d, {_lag('close', 21)} / {_lag('close', 126)} - 1 AS momentum_126_21d,
  close / ({_roll('max', 'close', 252, 252)}) - 1 AS near_52w_high, ln({_roll('avg', 'dv', 20, 20)}) AS log_adv_20, {_z('volume', 20)} AS volume_z_20, {_roll('avg', 'imp', 20, 20)} AS amihud_20,
  ((close - low) - (high - close)) / nullif(high - low, 0) AS close_location, CASE WHEN {_lag('ph', 3)} THEN {_lag('high', 3)} END AS high_event, CASE WHEN {_lag('pl', 3)} THEN {_lag('low', 3)} END AS low_event,
  {_z('r', 20)} AS rz, {_z('rs', 20)} AS xz FROM b2)""",
    f"""b4 AS (SELECT *, {_carry('CASE WHEN high_event IS NOT NULL THEN pos END')} AS hpos, {_carry('CASE WHEN low_event IS NOT NULL THEN pos END')} AS lpos,
  list(high_event) FILTER (high_event IS NOT NULL) OVER ({P} ROWS UNBOUNDED PRECEDING) AS hs, list(low_event) FILTER (low_event IS NOT NULL) OVER ({P} ROWS UNBOUNDED PRECEDING) AS ls,
  list(high_event) FILTER (high_event IS NOT NULL) OVER ({P} ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS h60, list(low_event) FILTER (low_event IS NOT NULL) OVER ({P} ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS l60,
  max(high) OVER ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS prior_high, min(low) OVER ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS prior_low,
  coalesce(CASE WHEN rz < 0 THEN -rz ELSE 0 END, 0) + coalesce(greatest(volume_z_20, 0), 0) + coalesce(greatest(xz, 0), 0) AS stress_score FROM b3)""",
    f"""b5 AS (SELECT *, CASE WHEN len(hs) < 2 OR len(ls) < 2 OR hs IS NULL OR ls IS NULL THEN 'insufficient confirmed structure'
  WHEN hs[-1] > hs[-2] AND ls[-1] > ls[-2] THEN 'higher highs and higher lows' WHEN hs[-1] < hs[-2] AND ls[-1] < ls[-2] THEN 'lower highs and lower lows'
  WHEN hs[-1] > hs[-2] AND ls[-1] < ls[-2] THEN 'expanding range' ELSE 'compression / balance' END AS market_structure,
  coalesce(list_min(list_filter(h60, lambda x: x > close)), prior_high) AS resistance, coalesce(list_max(list_filter(l60, lambda x: x < close)), prior_low) AS support,
  -(max(CASE WHEN r < 0 AND stress_score >= 2 THEN {{'s': stress_score, 'p': -pos}} END) OVER ({P} ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)).p AS anchor FROM b4)""",
    """b6 AS (SELECT b5.*, (b5.ctv - (z.ctv - z.tv)) / nullif(b5.cv - (z.cv - z.volume), 0) AS swing_avwap, (b5.ctv - (y.ctv - y.tv)) / nullif(b5.cv - (y.cv - y.volume), 0) AS stress_avwap
  FROM b5 LEFT JOIN b1c z ON z.ticker = b5.ticker AND z.pos = b5.lpos - 3 LEFT JOIN b1c y ON y.ticker = b5.ticker AND y.pos = b5.anchor)""",
]
DESK.insert(-1, "b1c AS (SELECT ticker, pos, tv, volume, ctv, cv FROM b2)")
LAST = """lastrow AS (SELECT * FROM b6 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)"""


def desk_sql(select: str, *extra: str) -> str:
    return with_sql(BARS, *DESK, *extra, recursive=True) + "\n" + select


def desk_case(name: str, numbers: list[str], texts: list[str] = (), sql: dict[str, str] | None = None) -> None:
    sql = sql or {}
    add(
        name,
        lambda s, sf: features(s, sf).select("date", "ticker", *texts, *sigs(*numbers)),
        desk_sql(
            "SELECT date, ticker, " + ", ".join([*texts, *[sig_sql(sql.get(n, n), n) for n in numbers]]) + " FROM b6"
        ),
    )


add(
    "r1_returns_and_atr",
    lambda s, sf: features(s, sf).select("date", "ticker", sig("return", "ret"), *sigs("log_return", "true_range", "atr")),
    desk_sql(f"SELECT date, ticker, {sig_sql('r', 'ret')}, {sig_sql('ln(close / pc)', 'log_return')}, {sig_sql('tr', 'true_range')}, {sig_sql('atr')} FROM b6"),
)
desk_case("r2_averages", ["ema_fast", "ema_mid", "ema_slow"])
desk_case("r3_risk_momentum_liquidity", ["realized_vol_20", "downside_vol_60", "max_drawdown_126", "momentum_21d", "momentum_126_21d", "near_52w_high", "log_adv_20", "amihud_20", "close_location"])
desk_case("r4_lagged_volume_zscore", ["volume_z_20"])
desk_case("r5_confirmed_pivots", ["high_event", "low_event"])
add(
    "r6_market_structure",
    lambda s, sf: features(s, sf).select("date", "ticker", "market_structure"),
    desk_sql("SELECT date, ticker, market_structure FROM b6"),
)
desk_case("r7_bars_since_pivots", ["bars_since_swing_high", "bars_since_swing_low"], sql={"bars_since_swing_high": "pos - hpos", "bars_since_swing_low": "pos - lpos"})
desk_case("r8_support_resistance", ["support", "resistance"])
desk_case("r9_swing_avwap", ["swing_avwap", "swing_avwap_distance_atr"], sql={"swing_avwap_distance_atr": "(close - swing_avwap) / nullif(atr, 0)"})
desk_case("r10_stress_avwap", ["stress_score", "stress_anchor_position", "stress_avwap"], sql={"stress_anchor_position": "anchor"})
add(
    "r11_trend",
    lambda s, sf: features(s, sf).select("date", "ticker", desk.trend().alias("primary_trend")),
    desk_sql("SELECT date, ticker, CASE WHEN close > ema_fast AND ema_fast > ema_mid AND ema_mid > ema_slow THEN 'bullish' WHEN close < ema_fast AND ema_fast < ema_mid AND ema_mid < ema_slow THEN 'bearish' ELSE 'transitional' END AS primary_trend FROM b6"),
)
ZONES = [
    f"""tail AS (SELECT *, avg(volume) FILTER (r > 0) OVER ({P} ROWS 19 PRECEDING) AS uv, avg(volume) FILTER (r < 0) OVER ({P} ROWS 19 PRECEDING) AS dn,
  list(low_event) FILTER (low_event IS NOT NULL) OVER ({P} ROWS 119 PRECEDING) AS l120, list(high_event) FILTER (high_event IS NOT NULL) OVER ({P} ROWS 119 PRECEDING) AS h120 FROM b6),
latest AS (SELECT *, coalesce(list_filter(l120, lambda x: x < close), []) AS below, coalesce(list_filter(h120, lambda x: x > close), []) AS above FROM tail
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
lv AS (SELECT *, row_number() OVER (PARTITION BY ticker, side ORDER BY x) AS k FROM (
  SELECT ticker, 'demand' AS side, unnest(CASE WHEN len(below) > 0 THEN below ELSE [support] END) AS x, 0.75 * atr AS tol FROM latest
  UNION ALL SELECT ticker, 'supply', unnest(CASE WHEN len(above) > 0 THEN above ELSE [resistance] END), 0.75 * atr FROM latest))""",
    """gr AS (SELECT ticker, side, k, x, x AS total, 1 AS n, 1 AS g FROM lv WHERE k = 1
  UNION ALL SELECT lv.ticker, lv.side, lv.k, lv.x, CASE WHEN abs(lv.x - total / n) <= tol THEN total ELSE 0 END + lv.x, CASE WHEN abs(lv.x - total / n) <= tol THEN n ELSE 0 END + 1,
    CASE WHEN abs(lv.x - total / n) <= tol THEN g ELSE g + 1 END FROM gr JOIN lv ON lv.ticker = gr.ticker AND lv.side = gr.side AND lv.k = gr.k + 1)""",
    """mid AS (SELECT ticker, side, median(x) AS m, count(*) AS touches FROM gr JOIN (SELECT ticker, side, max(g) AS top FROM gr GROUP BY 1, 2) USING (ticker, side)
  WHERE g = CASE side WHEN 'demand' THEN top ELSE 1 END GROUP BY 1, 2),
zn AS (SELECT ticker, side, touches, m - greatest(0.35 * atr, m * 0.0025) AS low, m + greatest(0.35 * atr, m * 0.0025) AS high FROM mid JOIN latest USING (ticker)),
zoned AS (SELECT t.* EXCLUDE (low, high), d.low AS demand_low, d.high AS demand_high, d.touches AS demand_touches, u.low AS supply_low, u.high AS supply_high, u.touches AS supply_touches
  FROM latest t JOIN zn d ON d.ticker = t.ticker AND d.side = 'demand' JOIN zn u ON u.ticker = t.ticker AND u.side = 'supply')""",
]
EDGES = ["demand_low", "demand_high", "supply_low", "supply_high"]
add(
    "r12_zones",
    lambda s, sf: desk.latest_state(features(s, sf)).select(
        "ticker", *[sig("__" + e.replace("_", "."), e) for e in EDGES], F.col("__demand.touches").alias("demand_touches"), F.col("__supply.touches").alias("supply_touches")
    ),
    desk_sql(f"SELECT ticker, {sigs_sql(*EDGES)}, demand_touches, supply_touches FROM zoned", *ZONES),
)
STATES = """CASE WHEN greatest(swing_avwap, stress_avwap) IS NULL THEN 'AVWAP reference unavailable' WHEN close > greatest(swing_avwap, stress_avwap) THEN 'above all available AVWAP references'
  WHEN close < least(swing_avwap, stress_avwap) THEN 'below all available AVWAP references' ELSE 'between AVWAP references' END"""
add(
    "r13_price_and_volume_states",
    lambda s, sf: desk.with_recent_windows(features(s, sf), CFG).select("date", "ticker", desk.avwap_state().alias("avwap_state"), desk.volume_state().alias("volume_state")),
    desk_sql(
        f"""SELECT date, ticker, {STATES} AS avwap_state, CASE WHEN uv IS NULL OR dn IS NULL THEN 'mixed' WHEN uv > dn * 1.10 THEN 'up-day volume dominant' WHEN dn > uv * 1.10 THEN 'down-day volume dominant' ELSE 'balanced' END AS volume_state FROM
  (SELECT *, avg(volume) FILTER (r > 0) OVER ({P} ROWS 19 PRECEDING) AS uv, avg(volume) FILTER (r < 0) OVER ({P} ROWS 19 PRECEDING) AS dn FROM b6)"""
    ),
)


def _scenario_sql(direction: str) -> str:
    long = direction == "long"
    sign, far, near = ("1", "greatest", "least") if long else ("-1", "least", "greatest")
    level, outer, inner = ("resistance", "supply_high", "supply_low") if long else ("support", "demand_low", "demand_high")
    return f"""SELECT ticker, '{direction}' AS direction, {sign} AS sg, close, atr, {far}({level}, {outer}, coalesce({far}(swing_avwap, stress_avwap), close)) + {sign} * 0.10 * atr AS trig,
  {near}({level}, {inner}) - {sign} * 0.25 * atr AS loose FROM zoned"""


SCENARIOS = f"""s1 AS ({_scenario_sql('long')} UNION ALL {_scenario_sql('bearish')}),
s2 AS (SELECT *, CASE direction WHEN 'long' THEN greatest(loose, trig - 2 * atr) ELSE least(loose, trig + 2 * atr) END AS stop_, sg * (trig - close) / atr AS dist FROM s1),
s3 AS (SELECT *, sg * (trig - stop_) AS risk, CASE WHEN trig > 0 THEN sg * (trig - stop_) / trig ELSE 'Infinity'::DOUBLE END AS frac FROM s2)"""
add(
    "r14_scenarios",
    lambda s, sf: desk.scenario_table(desk.snapshots(desk.latest_state(features(s, sf)))).drop("thesis", "invalidation").withColumn("eligible", F.col("eligible").cast("int")),
    desk_sql(
        """SELECT ticker, direction, CASE WHEN dist <= 0 THEN 'triggered' WHEN dist <= 2.5 THEN 'watch' ELSE 'distant' END AS status,
  (trig > 0 AND risk > 0 AND frac <= 0.08 AND dist <= 2.5)::INT AS eligible, round_even(trig, 2) AS "trigger", round_even(stop_, 2) AS stop, round_even(trig + sg * 2 * risk, 2) AS target_1,
  round_even(trig + sg * 3 * risk, 2) AS target_2, round_even(risk, 2) AS risk_per_share, CASE WHEN trig > 0 THEN round_even(frac, 4) ELSE frac END AS risk_fraction,
  2e0 AS reward_risk_1, 3e0 AS reward_risk_2, round_even(dist, 2) AS trigger_distance_atr FROM s3""",
        *ZONES, SCENARIOS,
    ),
)
TREND = """CASE WHEN close > ema_fast AND ema_fast > ema_mid AND ema_mid > ema_slow THEN 'bullish' WHEN close < ema_fast AND ema_fast < ema_mid AND ema_mid < ema_slow THEN 'bearish' ELSE 'transitional' END"""
VOLUMES = """CASE WHEN uv IS NULL OR dn IS NULL THEN 'mixed' WHEN uv > dn * 1.10 THEN 'up-day volume dominant' WHEN dn > uv * 1.10 THEN 'down-day volume dominant' ELSE 'balanced' END"""
SNAP_SQL = {
    "as_of": "date", "last_close": "round_even(close, 2)", "primary_trend": TREND, "atr": "round_even(atr, 4)",
    "trend_score": f"CASE {TREND} WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END",
    "structure_score": "CASE market_structure WHEN 'higher highs and higher lows' THEN 1 WHEN 'lower highs and lower lows' THEN -1 ELSE 0 END",
    "price_volume_state": VOLUMES, "avwap_state": STATES, "bars_since_swing_high": "pos - hpos", "bars_since_swing_low": "pos - lpos",
    **{n: f"round_even({n}, 2)" for n in ("support", "resistance", "swing_avwap", "stress_avwap")},
    **{f"{side}_zone_{edge}": f"round_even({side}_{edge}, 2)" for side in ("demand", "supply") for edge in ("low", "high")},
    **{f"{side}_zone_touches": f"{side}_touches" for side in ("demand", "supply")},
}
AS_IS = ("ticker", "as_of", "primary_trend", "market_structure", "price_volume_state", "avwap_state")
add(
    "r15_latest_snapshot",
    lambda s, sf: desk.snapshots(desk.latest_state(features(s, sf))).select(
        *AS_IS, *[sig(n) for n in desk.SNAPSHOT if n not in AS_IS], F.col("error").isNull().cast("int").alias("ok")
    ),
    desk_sql(
        "SELECT " + ", ".join(f"{SNAP_SQL.get(n, n)} AS {n}" if n in AS_IS else sig_sql(SNAP_SQL.get(n, n), n) for n in desk.SNAPSHOT) + ", 1 AS ok FROM zoned",
        *ZONES,
    ),
)
LABELLED = ("primary_trend", "market_structure", "avwap_state")
add(
    "r16_factor_table",
    lambda s, sf: desk.factor_table(desk.snapshots(desk.latest_state(features(s, sf)))).select("ticker", "sleeve", "metric", sig("value"), "label", "units_or_definition"),
    desk_sql(
        " UNION ALL ".join(
            f"SELECT ticker, '{sleeve}' AS sleeve, '{metric}' AS metric, {sig_sql('NULL' if c in LABELLED else c, 'value')}, {SNAP_SQL.get(c, c) if c in LABELLED else 'NULL'} AS label, '{unit}' AS units_or_definition FROM zoned"
            for sleeve, metric, c, unit in desk.FACTORS
        ),
        *ZONES,
    ),
)
add(
    "r17_scan_with_errors",
    lambda s, sf: scan_bars(bars(s, sf).filter("NOT (ticker = 'Brand#7' AND year(date) > 1995)").withColumn("low", F.when((F.col("ticker") == "Brand#9") & (F.year("date") == 1999), -1.0).otherwise(F.col("low")))).select("ticker", sig("momentum_21d"), "error"),
    desk_sql(
        f"""SELECT ticker, CASE WHEN ticker NOT IN ('Brand#7', 'Brand#9') THEN {sig_sql('momentum_21d', 'm').rsplit(' AS ', 1)[0]} END AS momentum_21d, CASE WHEN ticker = 'Brand#9' THEN 'A price is zero or less.'
  WHEN ticker = 'Brand#7' THEN (SELECT count(*) FROM bars WHERE ticker = 'Brand#7' AND year(date) = 1995) || ' bars are complete, 256 are needed.' END AS error FROM lastrow""",
        LAST,
    ),
)


def _pct(x: str, up: bool = True) -> str:
    o = "ASC" if up else "DESC"
    return f"(rank() OVER (ORDER BY {x} {o} NULLS LAST) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count({x}) OVER ()"


RANK = f"""tr2 AS (SELECT *, CASE WHEN close > ema_fast AND ema_fast > ema_mid AND ema_mid > ema_slow THEN 1 WHEN close < ema_fast AND ema_fast < ema_mid AND ema_mid < ema_slow THEN -1 ELSE 0 END AS ts,
  CASE market_structure WHEN 'higher highs and higher lows' THEN 1 WHEN 'lower highs and lower lows' THEN -1 ELSE 0 END AS ss FROM lastrow),
rk AS (SELECT ticker, ({_pct('momentum_21d')} + {_pct('momentum_126_21d')} + {_pct('near_52w_high')}) / 3 AS momentum_rank, ({_pct('ts')} + {_pct('ss')}) / 2 AS structure_rank,
  ({_pct('realized_vol_20', False)} + {_pct('max_drawdown_126')}) / 2 AS risk_rank, ({_pct('log_adv_20')} + {_pct('amihud_20', False)}) / 2 AS liquidity_rank FROM tr2)"""
RANKS = ["momentum_rank", "structure_rank", "risk_rank", "liquidity_rank"]
add(
    "r18_ranked_universe",
    lambda s, sf: ranked_scan(bars(s, sf)).select("ticker", *sigs(*RANKS, "research_priority")),
    desk_sql(f"SELECT ticker, {sigs_sql(*RANKS)}, {sig_sql('(momentum_rank + structure_rank + risk_rank + liquidity_rank) / 4', 'research_priority')} FROM rk", LAST, RANK),
)
add(
    "r19_latest_ranking",
    lambda s, sf: reporting.latest_ranking(asset_features(bars(s, sf)), "mom_21d").select("ticker", "date", sig("mom_21d")),
    features_sql(f"SELECT ticker, date, {sig_sql('v', 'mom_21d')} FROM (SELECT *, {EXPR['mom_21d']} AS v FROM k) WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"),
)

# Efficacy ------------------------------------------------------------------
COLS = [*STUDY_FEATURES, *STUDY_LABELS]


def data(s, sf):
    """The study table is ranked once per column: written once."""
    return cut_lineage(study(s, sf))


def ranks_cte(keys: str = "", source: str = "study", out: str = "rks") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    also = f"{keys}, " if keys else ""
    cells = ", ".join(f"rank() OVER ({part}ORDER BY x_{c}) + (count(*) OVER (PARTITION BY {also}x_{c}) - 1) / 2.0 AS r_{c}" for c in COLS)
    return f"{out} AS (SELECT *, {cells} FROM {source})"


def corr_cte(keys: str = "", source: str = "rks", prefix: str = "r_", out: str = "cor", rows=None, cols=None) -> str:
    lead = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    parts = [
        f"SELECT {lead}'{f}' AS feature, '{l}' AS label, CASE WHEN count(*) >= 3 AND min(x_{f}) < max(x_{f}) AND min(x_{l}) < max(x_{l}) THEN corr({prefix}{f}, {prefix}{l}) END AS correlation FROM {source}{group}"
        for f in (rows or STUDY_FEATURES)
        for l in (cols or STUDY_LABELS)
    ]
    return f"{out} AS ({' UNION ALL '.join(parts)})"


add(
    "y1_pearson",
    lambda s, sf: efficacy.feature_label_correlations(data(s, sf), STUDY_FEATURES, STUDY_LABELS, "pearson").select("feature", "label", sig("correlation")),
    features_sql(f"SELECT feature, label, {sig_sql('correlation')} FROM cor", extra=[STUDY_CTE, corr_cte(source="study", prefix="x_")]),
)
add(
    "y2_feature_label_spearman",
    lambda s, sf: efficacy.feature_label_correlations(data(s, sf), STUDY_FEATURES, STUDY_LABELS).select("feature", "label", *sigs("correlation", "abs_correlation")),
    features_sql(f"SELECT feature, label, {sig_sql('correlation')}, {sig_sql('abs(correlation)', 'abs_correlation')} FROM cor", extra=[STUDY_CTE, ranks_cte(), corr_cte()]),
)
add(
    "y3_correlation_matrix",
    lambda s, sf: efficacy.correlation_matrix(data(s, sf), STUDY_FEATURES).select(F.col("left").alias("a"), F.col("right").alias("b"), sig("correlation")),
    features_sql(f"SELECT feature AS a, label AS b, {sig_sql('correlation')} FROM cor", extra=[STUDY_CTE, ranks_cte(), corr_cte(cols=STUDY_FEATURES)]),
)


def gappy(s, sf):
    """The study table with holes: features on every seventh, labels on every fifth day of the month."""
    day = F.dayofmonth("date")
    holes = {c: F.when(day % 7 != i, F.col(c)) for i, c in enumerate(STUDY_FEATURES)}
    holes |= {c: F.when(day % 5 != i, F.col(c)) for i, c in enumerate(STUDY_LABELS)}
    return data(s, sf).withColumns(holes)


def _hole(c: str) -> str:
    names = STUDY_FEATURES if c in STUDY_FEATURES else STUDY_LABELS
    return f"(CASE WHEN day(date) % {7 if c in STUDY_FEATURES else 5} <> {names.index(c)} THEN x_{c} END)"


def _gap_pair(f: str, l: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"""SELECT '{f}' AS feature, '{l}' AS label, corr(rx, ry) AS correlation FROM (
  SELECT {rank('x')} AS rx, {rank('y')} AS ry FROM (SELECT {_hole(f)} AS x, {_hole(l)} AS y FROM study) WHERE x IS NOT NULL AND y IS NOT NULL)"""


add(
    "y2_spearman_with_gaps",
    lambda s, sf: efficacy.feature_label_correlations(gappy(s, sf), STUDY_FEATURES, STUDY_LABELS).select("feature", "label", sig("correlation")),
    features_sql(
        f"SELECT feature, label, {sig_sql('correlation')} FROM cor",
        extra=[STUDY_CTE, f"cor AS ({' UNION ALL '.join(_gap_pair(f, l) for f in STUDY_FEATURES for l in STUDY_LABELS)})"],
    ),
)
YEARLY = ["yst AS (SELECT *, year(date)::INT AS yr FROM study)", ranks_cte("yr", "yst"), corr_cte("yr")]
add(
    "y4_by_year",
    lambda s, sf: efficacy.by_year(data(s, sf), STUDY_FEATURES, STUDY_LABELS).select(F.col("year").alias("yr"), "feature", "label", sig("correlation")),
    features_sql(f"SELECT yr, feature, label, {sig_sql('correlation')} FROM cor", extra=[STUDY_CTE, *YEARLY]),
)


def stable_cte(keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return f"""stab AS (SELECT {lead}feature, label, median(correlation) AS m, avg(correlation) AS a, count(*) AS n,
  count(*) FILTER (correlation > 0) AS up, count(*) FILTER (correlation < 0) AS dn FROM cor WHERE correlation IS NOT NULL GROUP BY {lead}feature, label),
sta AS (SELECT *, CASE WHEN m > 0 THEN up / n WHEN m < 0 THEN dn / n END AS sg FROM stab)"""


add(
    "y5_stability",
    lambda s, sf: efficacy.stability(efficacy.by_year(data(s, sf), STUDY_FEATURES, STUDY_LABELS)).select("feature", "label", *sigs("median_corr", "mean_corr", "abs_median_corr", "sign_stability"), F.col("years").alias("n")),
    features_sql(f"SELECT feature, label, {sig_sql('m', 'median_corr')}, {sig_sql('a', 'mean_corr')}, {sig_sql('abs(m)', 'abs_median_corr')}, {sig_sql('sg', 'sign_stability')}, n FROM sta", extra=[STUDY_CTE, *YEARLY, stable_cte()]),
)
PF, PL, PC = ["mom_21d", "natr_20", "ewma50_slope"], "future_return_60d", "cmf"
RESID = f"""rm AS (SELECT avg(r_{PC}) AS mc, {', '.join(f'avg(r_{c}) AS m_{c}, covar_pop(r_{c}, r_{PC}) / var_pop(r_{PC}) AS b_{c}' for c in [*PF, PL])} FROM rks),
rz AS (SELECT {', '.join(f'r_{c} - m_{c} - b_{c} * (r_{PC} - mc) AS x_{c}' for c in [*PF, PL])} FROM rks, rm),
rr AS (SELECT *, {', '.join(f'rank() OVER (ORDER BY x_{c}) + (count(*) OVER (PARTITION BY x_{c}) - 1) / 2.0 AS r_{c}' for c in [*PF, PL])} FROM rz)"""
PARTIAL = [STUDY_CTE, ranks_cte(), corr_cte(rows=PF, cols=[PL]), RESID, corr_cte(source="rr", out="par", rows=PF, cols=[PL])]
add(
    "y6_partial_spearman",
    lambda s, sf: efficacy.partial_spearman(data(s, sf), PF, PL, [PC]).select("feature", "label", F.round("partial_spearman", 5).alias("partial_spearman")),
    features_sql("SELECT feature, label, round(correlation, 5) AS partial_spearman FROM par", extra=PARTIAL),
)
add(
    "y7_raw_versus_partial",
    lambda s, sf: efficacy.raw_versus_partial(data(s, sf), PF, PL, [PC]).select("feature", *[F.round(c, 5).alias(c) for c in ("raw_spearman", "partial_spearman", "abs_drop")]),
    features_sql("SELECT feature, round(c.correlation, 5) AS raw_spearman, round(p.correlation, 5) AS partial_spearman, round(abs(c.correlation) - abs(p.correlation), 5) AS abs_drop FROM cor c JOIN par p USING (feature)", extra=PARTIAL),
)
TICKERS = [
    ranks_cte("ticker", out="rkt"), corr_cte("ticker", "rkt", out="cot", cols=["future_return_60d"]),
    "yst AS (SELECT *, year(date)::INT AS yr FROM study)", ranks_cte("ticker, yr", "yst", "rks"), corr_cte("ticker, yr"), stable_cte("ticker"),
]
add(
    "y8_ticker_summary",
    lambda s, sf: efficacy.ticker_summary(data(s, sf), STUDY_FEATURES, STUDY_LABELS, "future_return_60d").select("ticker", F.col("rows").alias("n"), "top_feature", "stable_feature", "stable_label", *sigs("top_correlation", "stable_median", "stable_sign")),
    features_sql(
        f"""SELECT ticker, n, top_feature, stable_feature, stable_label, {sig_sql('tc', 'top_correlation')}, {sig_sql('sm', 'stable_median')}, {sig_sql('ssg', 'stable_sign')} FROM
  (SELECT ticker, count(*) AS n FROM study GROUP BY 1)
  JOIN (SELECT ticker, feature AS top_feature, correlation AS tc FROM cot QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY abs(correlation) DESC, feature DESC) = 1) USING (ticker)
  JOIN (SELECT ticker, feature AS stable_feature, label AS stable_label, m AS sm, sg AS ssg FROM sta QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY abs(m) DESC, sg DESC, feature DESC, label DESC) = 1) USING (ticker)""",
        extra=[STUDY_CTE, *TICKERS],
    ),
)
FAMILY = ["cmf", "cmf_slope", "frog_in_the_pan"]
add(
    "b4_family_columns",
    lambda s, sf: study_feature_table(bars(s, sf), ("cmf", "frog_in_the_pan"), FAMILY, study_features()).select("date", "ticker", *sigs(*FAMILY)),
    features_sql("SELECT date, ticker, " + ", ".join(sig_sql(expressions(True)[c], c) for c in FAMILY) + " FROM k", study=True),
)
