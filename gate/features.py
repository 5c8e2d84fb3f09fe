"""Asset, market-relative, rank and macro feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate.base import BARS, BENCH, MACRO, add, bars, bench, case, macro, sig, sig_sql, sigs, sigs_sql, with_sql
from tapeweave.config import study_features
from tapeweave.operators.asset_features import asset_features
from tapeweave.operators.cross_section import percentile_rank
from tapeweave.operators.macro import macro_features, macro_features_long
from tapeweave.operators.market_relative import market_relative_features


def _roll(agg: str, x: str, n: int, least: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {agg}({x}) {w} END"


def _lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY ticker ORDER BY date)"


def _slope(x: str, d: str, n: int) -> str:
    return f"(({x} - {_lag(x, n - 1)}) / {n - 1}.0) / ({_roll('stddev_samp', d, n, 2)} + 1e-9)"


def _carry(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"


def _ewm(span: int, new: str, old: str) -> str:
    return f"(2e0/{span + 1}) * ({new}) + (1 - 2e0/{span + 1}) * ({old})"


def feature_ctes(study: bool = False) -> list[str]:
    place = "((close - low) - (high - close)) / ((high - low) + 1e-9)"
    if not study:
        place = f"(CASE WHEN abs(high - low) > 1e-9 THEN {place} ELSE 0 END)"
    fip = 20 if study else 40
    spans = {"m12": 12, "m26": 26, "a50": 50, "a20": 20, "a200": 200}
    macd = f"({_ewm(12, 'd.close', 'e.m12')}) - ({_ewm(26, 'd.close', 'e.m26')})"
    kling = f"({_ewm(34, 'd.sv', 'e.k34')}) - ({_ewm(55, 'd.sv', 'e.k55')})"
    step = ", ".join(_ewm(s, "d.close", f"e.{n}") for n, s in spans.items())
    d = f"""d AS (SELECT *, close / pc - 1 AS r, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  close * volume AS dv, (high + low + close) / 3 * volume AS tv, {place} * volume AS mf,
  volume * (CASE WHEN close - pc > 0 THEN 1e0 WHEN close - pc < 0 THEN -1e0 ELSE 0e0 END) AS sv
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, {_lag('close')} AS pc FROM bars))"""
    e = f"""e AS (SELECT ticker, pos, close AS m12, close AS m26, close AS a50, close AS a20, close AS a200,
   sv AS k34, sv AS k55, 0e0 AS ms, 0e0 AS ks FROM d WHERE pos = 0
  UNION ALL SELECT d.ticker, d.pos, {step}, {_ewm(34, 'd.sv', 'e.k34')}, {_ewm(55, 'd.sv', 'e.k55')},
   {_ewm(9, macd, 'e.ms')}, {_ewm(13, kling, 'e.ks')}
  FROM e JOIN d ON d.ticker = e.ticker AND d.pos = e.pos + 1)"""
    g = "g AS (SELECT d.*, e.* EXCLUDE (ticker, pos), ln(a50 + 1e-9) AS la FROM d JOIN e USING (ticker, pos))"
    h = f"""h AS (SELECT *, {_roll('sum', 'mf', 20, 2)} / ({_roll('sum', 'volume', 20, 2)} + 1e-9) AS cmf,
  la - {_lag('la')} AS d_la, ms - {_lag('ms')} AS d_ms, ks - {_lag('ks')} AS d_ks,
  coalesce(sign(r), 0) AS sr, CASE WHEN r < 0 THEN r * r ELSE 0 END AS loss2,
  CASE WHEN dv > 0 THEN abs(r) / dv END AS impact, {_roll('avg', 'dv', 20, 1)} AS adv, {_roll('avg', 'tr', 20, 1)} AS atr,
  sum(tv) OVER (PARTITION BY ticker ORDER BY date) AS ctv, sum(volume) OVER (PARTITION BY ticker ORDER BY date) AS cv,
  {' AND '.join([f"high > {_lag('high', k)} " for k in (1, 2, 3)] + [f"high >= {_lag('high', -k)}" for k in (1, 2, 3)])} AS ph,
  {' AND '.join([f"low < {_lag('low', k)} " for k in (1, 2, 3)] + [f"low <= {_lag('low', -k)}" for k in (1, 2, 3)])} AS pl
  FROM g)"""
    i = f"""i AS (SELECT *, cmf - {_lag('cmf')} AS d_cmf,
  CASE WHEN {_lag('cmf')} <= 0 AND cmf > 0 THEN 1e0 WHEN {_lag('cmf')} >= 0 AND cmf < 0 THEN -1e0 ELSE 0e0 END AS cross_,
  CASE WHEN {_lag('ph', 3)} THEN {_lag('high', 3)} END AS hl, CASE WHEN {_lag('pl', 3)} THEN {_lag('low', 3)} END AS ll
  FROM h)"""
    j = f"""j AS (SELECT *, {_carry('CASE WHEN cross_ <> 0 THEN pos END')} AS xpos,
  sum((ll IS NOT NULL)::INT) OVER (PARTITION BY ticker ORDER BY date) AS grp, {_carry('hl')} AS res, {_carry('ll')} AS sup FROM i)"""
    k = """k AS (SELECT *, sum(tv) OVER (PARTITION BY ticker, grp ORDER BY date) / sum(volume) OVER (PARTITION BY ticker, grp ORDER BY date) AS vwap,
  row_number() OVER (PARTITION BY ticker, grp ORDER BY date) - 1 AS since FROM j)"""
    return [d, e, g, h, i, j, k]


BASE = "close + 1e-9"


def expressions(study: bool = False) -> dict[str, str]:
    fip = 20 if study else 40
    base = "(close + 1e-9)" if study else "close"
    frog = f"({_roll('sum', 'sr', fip, 2)}) / sqrt({fip}e0)"
    band = f"(4e0 * ({_roll('stddev_samp', 'close', 20, 2)}) / (abs({_roll('avg', 'close', 20, 2)}) + 1e-9))"
    ann = "* sqrt(252e0)"
    out = {
        "mr_ewma50_vol_gap": f"((a50 - close) / {base}) / ({_roll('stddev_samp', 'r', 50, 2)} + 1e-9)",
        "ewma50_slope": _slope("la", "d_la", 40),
        "acc_macd_signal": "ms",
        "acc_klinger_signal": "ks",
        "macd_signal_strength": f"ms * ({_slope('ms', 'd_ms', 40)})",
        "klinger_signal_strength": f"ks * ({_slope('ks', 'd_ks', 40)})",
        "acc_momentum_quality": f"(close / {_lag('close', 40)} - 1) / ({_roll('var_samp', 'r', 40, 2)} + 1e-9)",
        "cmf": "cmf",
        "cmf_slope": _slope("cmf", "d_cmf", 40),
        "cmf_cross_signal": "cross_",
        "cmf_days_since_cross": "pos - xpos",
        "frog_in_the_pan": frog,
        "bollinger_bandwidth": band,
        "fip_over_bollinger_bandwidth": f"({frog}) / ({band} + 1e-9)",
        "mom_21d": f"close / {_lag('close', 21)} - 1",
        "mom_126_21d": f"{_lag('close', 21)} / {_lag('close', 126)} - 1",
        "near_52w_high": f"close / ({_roll('max', 'close', 252, 1)}) - 1",
        "log_adv_20": "CASE WHEN adv > 0 THEN ln(adv) END",
        "volume_z_20": f"(volume - ({_roll('avg', 'volume', 20, 2)})) / (({_roll('stddev_samp', 'volume', 20, 2)}) + 1e-9)",
        "close_vwap20_gap": f"close - ({_roll('sum', 'tv', 20, 20)}) / nullif({_roll('sum', 'volume', 20, 20)}, 0)",
        "amihud_20": _roll("avg", "impact", 20, 1),
        "confirmed_structure_score": "(ll IS NOT NULL)::INT - (hl IS NOT NULL)::INT",
        "support_distance_atr": "CASE WHEN atr > 0 THEN (close - sup) / atr END",
        "resistance_distance_atr": "CASE WHEN atr > 0 THEN (res - close) / atr END",
        "swing_avwap_distance_atr": "CASE WHEN atr > 0 AND grp > 0 THEN (close - vwap) / atr END",
        "bars_since_swing_low": "CASE WHEN grp > 0 THEN since END",
        "natr_20": "atr / (abs(close) + 1e-9)",
        "realized_vol_20": f"({_roll('stddev_samp', 'r', 20, 2)}) {ann}",
        "realized_vol_126": f"({_roll('stddev_samp', 'r', 126, 126)}) {ann}",
        "downside_vol_60": f"sqrt({_roll('avg', 'loss2', 60, 2)}) {ann}",
        "max_drawdown_126": f"close / ({_roll('max', 'close', 126, 1)}) - 1",
        "close_ema20_gap": "close - a20",
        "close_ema50_gap": "close - a50",
        "close_ema200_gap": "close - a200",
        "ema20_ema50_distance": "a20 - a50",
        "ema50_ema200_distance": "a50 - a200",
        "ema20_ema200_distance": "a20 - a200",
    }
    for n in (20, 50, 200):
        out[f"ema{n}_slope"] = f"(a{n} - {_lag(f'a{n}', 10)}) / 10"
    return out


RELATIVE_CTES = [
    f"""mk AS (SELECT date, close AS mc, close / lag(close) OVER (ORDER BY date) - 1 AS mr FROM bench)""",
    f"""ra AS (SELECT b.*, mc, mr, close / {_lag('close')} - 1 AS rs FROM bars b LEFT JOIN mk USING (date))""",
    f"""rb AS (SELECT *, rs * mr AS p, mr * mr AS q FROM ra)""",
    f"""rc AS (SELECT *, {_roll('avg', 'rs', 252, 2)} AS es, {_roll('avg', 'mr', 252, 2)} AS em,
  {_roll('avg', 'p', 252, 2)} AS ep, {_roll('avg', 'q', 252, 2)} AS eq FROM rb)""",
    f"""rd AS (SELECT *, (ep - es * em) / (eq - em * em + 1e-9) AS beta FROM rc)""",
    f"""re AS (SELECT *, rs - beta * mr AS resid FROM rd)""",
]
RELATIVE = {
    "relative_strength_63": f"close / {_lag('close', 63)} - mc / {_lag('mc', 63)}",
    "beta_252": "beta",
    "residual_mom_126_21": f"{_lag('close', 21)} / {_lag('close', 126)} - beta * ({_lag('mc', 21)} / {_lag('mc', 126)} - 1)",
    "idio_vol_60": _roll("stddev_samp", "resid", 60, 2),
}


def features_sql(select: str, study: bool = False, extra: list[str] = ()) -> str:
    return with_sql(BARS, *feature_ctes(study), *extra, recursive=True) + "\n" + select


def all_features_cte(study: bool = False) -> str:
    cols = ", ".join(f"{x} AS f_{n}" for n, x in expressions(study).items())
    return f"feats AS (SELECT date, ticker, close, {cols} FROM k)"


def _number(name: str, start: int, names) -> dict[str, int]:
    return {n: start + i for i, n in enumerate(names)}


ORDER = [
    "mr_ewma50_vol_gap", "ewma50_slope", "acc_macd_signal", "acc_klinger_signal", "macd_signal_strength",
    "klinger_signal_strength", "acc_momentum_quality", "cmf", "cmf_slope", "cmf_cross_signal",
    "cmf_days_since_cross", "frog_in_the_pan", "bollinger_bandwidth", "fip_over_bollinger_bandwidth",
    "mom_21d", "mom_126_21d", "near_52w_high", "log_adv_20", "volume_z_20", "close_vwap20_gap", "amihud_20",
    "confirmed_structure_score", "support_distance_atr", "resistance_distance_atr", "swing_avwap_distance_atr",
    "bars_since_swing_low", "natr_20", "realized_vol_20", "realized_vol_126", "downside_vol_60",
    "max_drawdown_126", "close_ema20_gap", "close_ema50_gap", "close_ema200_gap", "ema20_ema50_distance",
    "ema50_ema200_distance", "ema20_ema200_distance", "ema20_slope", "ema50_slope", "ema200_slope",
]
EXPR = expressions()
for number, column in enumerate(ORDER, start=1):
    add(
        f"f{number:02d}_{column}",
        lambda spark, sf, c=column: asset_features(bars(spark, sf)).select("date", "ticker", sig(c)),
        features_sql(f"SELECT date, ticker, {sig_sql(EXPR[column], column)} FROM k"),
    )
for number, column in enumerate(RELATIVE, start=41):
    add(
        f"f{number}_{column}",
        lambda spark, sf, c=column: market_relative_features(bars(spark, sf), bench(spark, sf)).select(
            "date", "ticker", sig(c)
        ),
        with_sql(BARS, BENCH, *RELATIVE_CTES) + f"\nSELECT date, ticker, {sig_sql(RELATIVE[column], column)} FROM re",
    )
RANKED = ["mom_21d", "mom_126_21d", "near_52w_high", "log_adv_20", "volume_z_20", "amihud_20"]


def rank_sql(value: str, of: str) -> str:
    return f"""CASE WHEN count(*) OVER (PARTITION BY date) <= 1 THEN 1e0 WHEN {value} IS NOT NULL THEN
  (rank() OVER (PARTITION BY date ORDER BY {value} NULLS LAST) + (count(*) OVER (PARTITION BY date, {value}) - 1) / 2.0 - 1)
  / (count(*) OVER (PARTITION BY date) - 1) END"""


for number, column in enumerate(RANKED, start=45):
    add(
        f"f{number}_{column}_percentile_rank",
        lambda spark, sf, c=column: percentile_rank(asset_features(bars(spark, sf)).select("date", "ticker", c), c).select(
            "date", "ticker", sig(f"{c}_percentile_rank")
        ),
        features_sql(
            f"SELECT date, ticker, {sig_sql(rank_sql('v', column), column + '_percentile_rank')} FROM v",
            extra=[f"v AS (SELECT date, ticker, {EXPR[column]} AS v FROM k)"],
        ),
    )

STUDY = ["mr_ewma50_vol_gap", "cmf", "cmf_slope", "frog_in_the_pan", "fip_over_bollinger_bandwidth"]
add(
    "f_study_variant",
    lambda spark, sf: asset_features(bars(spark, sf), study_features()).select("date", "ticker", *sigs(*STUDY)),
    features_sql(
        "SELECT date, ticker, " + ", ".join(sig_sql(expressions(True)[c], c) for c in STUDY) + " FROM k", study=True
    ),
)

# Macro ---------------------------------------------------------------------
MACRO_CTES = [
    MACRO,
    "grid AS (SELECT d.date, t.ticker, m.value FROM (SELECT DISTINCT date FROM macro) d CROSS JOIN (SELECT DISTINCT ticker FROM macro) t LEFT JOIN macro m ON m.date = d.date AND m.ticker = t.ticker)",
    f"""mz AS (SELECT date, 'macro_' || ticker AS series, value AS level, value - {_lag('value')} AS diff,
  value / nullif({_lag('value')}, 0) - 1 AS pct_change,
  CASE WHEN value > 0 AND {_lag('value')} > 0 THEN ln(value / {_lag('value')}) END AS log_return,
  (value - ({_roll('avg', 'value', 20, 2)})) / nullif({_roll('stddev_samp', 'value', 20, 2)}, 0) AS zscore FROM grid)""",
]
for name, column in (("m3", "diff"), ("m4", "pct_change"), ("m5", "log_return"), ("m6", "zscore"), ("m7", "level")):
    add(
        f"{name}_macro_{column}",
        lambda spark, sf, c=column: macro_features_long(macro(spark, sf)).select("date", "series", sig(c)),
        with_sql(*MACRO_CTES) + f"\nSELECT date, series, {sig_sql(column)} FROM mz WHERE level IS NOT NULL",
    )
SYMBOLS = ["click", "error", "purchase", "signup", "view"]
MACRO_PARTS = ("level", "diff", "pct_change", "log_return", "zscore")


@case(
    "m2_macro_wide",
    with_sql(*MACRO_CTES)
    + "\nSELECT date, "
    + ", ".join(
        sig_sql(f"max(CASE WHEN series = 'macro_{s}' THEN {p} END)", f"macro_{s}" + ("" if p == "level" else f"_{p}"))
        for p in MACRO_PARTS
        for s in SYMBOLS
    )
    + " FROM mz GROUP BY date",
)
def _macro_wide(spark, sf):
    wide = macro_features(macro(spark, sf), SYMBOLS, levels=True)
    return wide.select("date", *sigs(*(c for c in wide.columns if c != "date")))
