"""Weights, ledger, metrics, robustness, policy and reporting tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate.base import BARS, BENCH, MACRO, RETURNS, WEEKLY, add, bars, macro, sig, sig_sql, sigs, sigs_sql, with_sql
from gate.market import MARKET_RETURNS, market_returns, returns, weekly
from gate.transform import split_table, splits_sql
from tapeweave.config import LedgerConfig, PolicyConfig, RewardConfig
from tapeweave.operators import covariance, ledger, metrics, policy, policy_sweep, reporting, splits, weights

RAW_SCORE = "(open - floor(open / 97) * 97) / 97"
BASE = [BARS, BENCH, WEEKLY, RETURNS, MARKET_RETURNS]


def score_column():
    return (F.col("open") - F.floor(F.col("open") / 97) * 97) / 97


def scores(s, sf):
    """A score per decision date and ticker, one row in nine not tradable."""
    return returns(s, sf).select(
        F.lit("scored").alias("portfolio_id"), "decision_date", "ticker", (score_column() / 50 - 0.01).alias("score"),
        (F.floor("open") % 9 != 0).alias("tradable"),
    )


SCORES = f"""scores AS (SELECT decision_date, ticker, {RAW_SCORE} / 50 - 0.01 AS score, CAST(floor(open) AS BIGINT) % 9 <> 0 AS tradable FROM returns)"""


def targets(s, sf):
    """Raw targets with negatives, a cash row, and dates on which nothing is usable."""
    day = F.dayofmonth("decision_date")
    rows = returns(s, sf).select(
        F.lit("raw").alias("portfolio_id"), "decision_date", "ticker",
        F.when(day == 13, float("nan")).when(day == 27, -1.0).otherwise(score_column() - 0.3).alias("weight"),
    )
    return weights.with_cash(rows, cash=F.when(day == 27, 0.0).otherwise(0.1))


TARGETS = f"""targets AS (SELECT decision_date, ticker, CASE WHEN day(decision_date) = 13 THEN NULL WHEN day(decision_date) = 27 THEN -1 ELSE {RAW_SCORE} - 0.3 END AS w FROM returns
  UNION ALL SELECT DISTINCT decision_date, 'CASH', CASE WHEN day(decision_date) = 27 THEN 0.0 ELSE 0.1 END FROM returns)"""


def _norm(source: str, out: str, w: str = "w") -> str:
    return f"""{out} AS (SELECT decision_date, ticker, CASE WHEN count({w}) OVER g = count(*) OVER g AND sum(greatest({w}, 0)) OVER g > 0
  THEN greatest({w}, 0) / sum(greatest({w}, 0)) OVER g WHEN ticker = 'CASH' THEN 1 ELSE 0 END AS w FROM {source} WINDOW g AS (PARTITION BY decision_date))"""


def shown(df):
    return df.select("decision_date", "ticker", sig("weight"))


SHOW = f"\nSELECT decision_date, ticker, {sig_sql('w', 'weight')} FROM "

SOFT = """soft AS (SELECT decision_date, ticker, exp(greatest(least(score / 0.01, 20), -20)) AS e, tradable FROM scores)"""
add(
    "k1_softmax_weights",
    lambda s, sf: shown(weights.softmax_weights(scores(s, sf))),
    with_sql(*BASE, SCORES, SOFT) + SHOW + "(SELECT decision_date, ticker, e / sum(e) OVER (PARTITION BY decision_date) AS w FROM soft UNION ALL SELECT DISTINCT decision_date, 'CASH', 0 FROM soft)",
)
SPARSE = """sp1 AS (SELECT decision_date, ticker, score * 150 AS z FROM scores),
sp2 AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY z DESC, ticker) AS k, sum(z) OVER (PARTITION BY decision_date ORDER BY z DESC, ticker ROWS UNBOUNDED PRECEDING) AS c FROM sp1),
sp3 AS (SELECT decision_date, max_by(c, k) AS c, max(k) AS k FROM sp2 WHERE 1 + k * z > c GROUP BY 1)"""
add(
    "k2_sparsemax_weights",
    lambda s, sf: shown(weights.sparsemax_weights(scores(s, sf).withColumn("score", F.col("score") * 150))),
    with_sql(*BASE, SCORES, SPARSE) + SHOW + "(SELECT decision_date, ticker, greatest(z - (sp3.c - 1) / sp3.k, 0) AS w FROM sp1 JOIN sp3 USING (decision_date) UNION ALL SELECT DISTINCT decision_date, 'CASH', 0 FROM sp1)",
)
add(
    "k3_tradable_softmax",
    lambda s, sf: shown(weights.softmax_weights(scores(s, sf), tradable="tradable")),
    with_sql(*BASE, SCORES, SOFT)
    + SHOW
    + "(SELECT decision_date, ticker, CASE WHEN tradable THEN e / sum(e) FILTER (tradable) OVER (PARTITION BY decision_date) ELSE 0 END AS w FROM soft UNION ALL SELECT decision_date, 'CASH', CASE WHEN bool_or(tradable) THEN 0 ELSE 1 END FROM soft GROUP BY 1)",
)
add("k4_normalized_weights", lambda s, sf: shown(weights.normalize(targets(s, sf))), with_sql(*BASE, TARGETS, _norm("targets", "n")) + SHOW + "n")
TOP = """top AS (SELECT decision_date, ticker, CASE WHEN ticker = 'CASH' OR rk <= 6 THEN w ELSE 0 END AS w FROM
  (SELECT *, row_number() OVER (PARTITION BY decision_date, ticker = 'CASH' ORDER BY w DESC, ticker) AS rk FROM n))"""
add(
    "k5_top_n_weights",
    lambda s, sf: shown(weights.keep_top_n(weights.normalize(targets(s, sf)), 6)),
    with_sql(*BASE, TARGETS, _norm("targets", "n"), TOP, _norm("top", "t2")) + SHOW + "t2",
)
CAP = """cap1 AS (SELECT decision_date, ticker, CASE WHEN ticker = 'CASH' THEN w ELSE least(w, 0.15) END AS w FROM n),
cap2 AS (SELECT decision_date, ticker, w + CASE WHEN ticker = 'CASH' THEN greatest(1 - sum(w) OVER (PARTITION BY decision_date), 0) ELSE 0 END AS w FROM cap1)"""
add(
    "k6_cap_to_cash",
    lambda s, sf: shown(weights.cap_to_cash(weights.normalize(targets(s, sf)), 0.15)),
    with_sql(*BASE, TARGETS, _norm("targets", "n"), CAP, _norm("cap2", "c3")) + SHOW + "c3",
)
REDIST = """rd1 AS (SELECT decision_date, ticker, CASE WHEN ticker = 'CASH' THEN w ELSE least(w, 0.12) END AS w FROM n),
rd2 AS (SELECT *, 1 - sum(w) OVER g AS x, ticker <> 'CASH' AND w < 0.12 - 1e-12 AS el, count(*) FILTER (ticker <> 'CASH' AND w < 0.12 - 1e-12) OVER g AS ne FROM rd1 WINDOW g AS (PARTITION BY decision_date)),
rd3 AS (SELECT decision_date, ticker, w + CASE WHEN x > 0 AND el THEN x / ne WHEN x > 0 AND ticker = 'CASH' AND ne = 0 THEN x ELSE 0 END AS w FROM rd2),
rd4 AS (SELECT decision_date, ticker, w / sum(w) OVER (PARTITION BY decision_date) AS w FROM rd3)"""
add(
    "k7_cap_and_redistribute",
    lambda s, sf: shown(weights.cap_and_redistribute(weights.normalize(targets(s, sf)), 0.12)),
    with_sql(*BASE, TARGETS, _norm("targets", "n"), REDIST) + SHOW + "rd4",
)
EQUAL = """eq AS (SELECT decision_date, ticker, 1.0 / count(*) OVER (PARTITION BY decision_date) AS w FROM returns UNION ALL SELECT DISTINCT decision_date, 'CASH', 0 FROM returns)"""
add(
    "k8_blended_weights",
    lambda s, sf: shown(
        weights.blend(
            weights.benchmark_weights(returns(s, sf), "equal_weight").withColumn("portfolio_id", F.lit("raw")),
            weights.normalize(targets(s, sf)),
            0.4,
        )
    ),
    with_sql(*BASE, TARGETS, _norm("targets", "n"), EQUAL)
    + SHOW
    + "(SELECT decision_date, ticker, (0.6 * eq.w + 0.4 * n.w) / sum(0.6 * eq.w + 0.4 * n.w) OVER (PARTITION BY decision_date) AS w FROM eq JOIN n USING (decision_date, ticker))",
)


def portfolios(s, sf, held=None):
    return weights.policy_portfolios(held or returns(s, sf))


PW = """cnt AS (SELECT decision_date, count(*) AS n FROM returns GROUP BY 1),
pw AS (SELECT 'equal_weight' AS p, decision_date, ticker, 1.0 / n AS w FROM returns JOIN cnt USING (decision_date)
  UNION ALL SELECT 'equal_weight_cash', decision_date, ticker, 1.0 / (n + 1) FROM returns JOIN cnt USING (decision_date)
  UNION ALL SELECT 'cash', decision_date, ticker, 0 FROM returns
  UNION ALL SELECT 'equal_weight', decision_date, 'CASH', 0 FROM cnt
  UNION ALL SELECT 'equal_weight_cash', decision_date, 'CASH', 1.0 / (n + 1) FROM cnt
  UNION ALL SELECT 'cash', decision_date, 'CASH', 1 FROM cnt)"""
add(
    "k9_benchmark_weights",
    lambda s, sf: portfolios(s, sf).select("portfolio_id", "decision_date", "ticker", sig("weight")),
    with_sql(*BASE, PW) + f"\nSELECT p AS portfolio_id, decision_date, ticker, {sig_sql('w', 'weight')} FROM pw",
)
SERIES = ["click", "error", "purchase", "signup", "view"]
add(
    "k10_shrunk_covariance",
    lambda s, sf: covariance.shrunk_covariance(macro(s, sf), SERIES, 0.25, "value", "date").select(F.col("left").alias("a"), F.col("right").alias("b"), sig("covariance")),
    with_sql(MACRO)
    + f""", full_ AS (SELECT * FROM macro WHERE date IN (SELECT date FROM macro GROUP BY 1 HAVING count(*) = 5))
SELECT x.ticker AS a, y.ticker AS b, {sig_sql("covar_samp(x.value, y.value) * (CASE WHEN x.ticker = y.ticker THEN 1 ELSE 0.75 END)", 'covariance')}
FROM full_ x JOIN full_ y USING (date) GROUP BY x.ticker, y.ticker""",
)

# Policy --------------------------------------------------------------------
GATE = PolicyConfig(entry_weight=0.07, max_positions=8, max_position_weight=0.1, buy_threshold=0.5, sell_threshold=0.8, hold_threshold=0.25)


def probabilities(s, sf):
    frac = lambda x: x - F.floor(x)
    return returns(s, sf).select(
        F.lit("gate").alias("portfolio_id"), "decision_date", "ticker", frac(F.col("open") / 37).alias("p_buy"),
        frac(F.col("open") / 41).alias("p_hold"), frac(F.col("open") / 43).alias("p_sell"),
        (F.floor("open") % 9 != 0).alias("tradable"), "return",
    )


PROBS = """probs AS (SELECT decision_date, ticker, open/37 - floor(open/37) AS p_buy, open/41 - floor(open/41) AS p_hold, open/43 - floor(open/43) AS p_sell,
  CAST(floor(open) AS BIGINT) % 9 <> 0 AS tradable FROM returns)"""


def holdings(s, sf):
    return weights.keep_top_n(weights.normalize(targets(s, sf).withColumn("portfolio_id", F.lit("gate"))), 6)


DECIDED = """decided AS (SELECT p.decision_date, p.ticker, p_buy, coalesce(t2.w, 0) AS w, CASE
  WHEN coalesce(t2.w, 0) > 1e-8 AND tradable AND (p_sell >= 0.8 OR p_hold < 0.25) THEN 'SELL' WHEN coalesce(t2.w, 0) > 1e-8 THEN 'HOLD'
  WHEN tradable AND p_buy >= 0.5 THEN 'BUY' ELSE 'FLAT' END AS action FROM probs p LEFT JOIN t2 ON t2.decision_date = p.decision_date AND t2.ticker = p.ticker)"""
HELD = [*BASE, TARGETS, _norm("targets", "n"), TOP, _norm("top", "t2"), PROBS, DECIDED]
add(
    "k11_action_gate",
    lambda s, sf: policy.decide(holdings(s, sf), probabilities(s, sf), GATE).filter("ticker <> 'CASH'").select("decision_date", "ticker", "action"),
    with_sql(*HELD) + "\nSELECT decision_date, ticker, action FROM decided",
)
FUND = """books AS (SELECT decision_date, c.w + freed AS funds, kept FROM (SELECT decision_date, sum(CASE WHEN action = 'SELL' THEN w ELSE 0 END) AS freed,
  count(*) FILTER (action <> 'SELL' AND w > 1e-8) AS kept FROM decided GROUP BY 1) JOIN (SELECT decision_date, w FROM t2 WHERE ticker = 'CASH') c USING (decision_date)),
rb AS (SELECT decision_date, ticker, row_number() OVER (PARTITION BY decision_date ORDER BY p_buy DESC, ticker) AS rk FROM decided WHERE action = 'BUY'),
adm AS (SELECT decision_date, ticker FROM rb JOIN books USING (decision_date) WHERE rk <= least(8 - kept, floor((funds + 1e-12) / 0.07))),
fin AS (SELECT d.decision_date, d.ticker, a.ticker IS NOT NULL AS admitted, CASE WHEN action = 'SELL' THEN 0 WHEN a.ticker IS NOT NULL THEN 0.07 ELSE w END AS w
  FROM decided d LEFT JOIN adm a ON a.decision_date = d.decision_date AND a.ticker = d.ticker
  UNION ALL SELECT decision_date, 'CASH', false, greatest(funds - 0.07 * (SELECT count(*) FROM adm a WHERE a.decision_date = books.decision_date), 0) FROM books)"""


def funded(s, sf):
    return policy.fund(policy.decide(holdings(s, sf), probabilities(s, sf), GATE), GATE)


add(
    "k12_funded_buys",
    lambda s, sf: funded(s, sf).select("decision_date", "ticker", F.col("admitted").cast("int").alias("admitted"), sig("target_weight")),
    with_sql(*HELD, FUND) + f"\nSELECT decision_date, ticker, admitted::INT AS admitted, {sig_sql('w', 'target_weight')} FROM fin",
)


def replayed(s, sf):
    """The same probabilities under several thresholds, each a portfolio of its own."""
    rows = probabilities(s, sf).drop("portfolio_id")
    sweep = F.explode(F.array(*[F.lit(f"shift_{k}") for k in range(4)])).alias("portfolio_id")
    shifted = rows.select(sweep, "*").withColumn(
        "p_buy", F.greatest(F.col("p_buy") - F.substring("portfolio_id", 7, 1).cast("int") * 0.05, F.lit(0.0))
    )
    return policy.replay(shifted, GATE)


GATED = """gd AS (SELECT decision_date, row_number() OVER (ORDER BY decision_date) AS i FROM (SELECT DISTINCT decision_date FROM probs)),
gk AS (SELECT unnest(range(4)) AS k),
gp AS (SELECT 'shift_' || k AS p, i, pb.ticker, greatest(p_buy - k * 0.05, 0) AS p_buy, p_hold, p_sell, tradable, ret AS r
    FROM probs pb JOIN gd USING (decision_date) JOIN returns r ON r.decision_date = pb.decision_date AND r.ticker = pb.ticker, gk
  UNION ALL SELECT 'shift_' || k, i, 'CASH', NULL, NULL, NULL, NULL, 0 FROM gd, gk)"""
REPLAYED = """rp AS (SELECT 'shift_' || k AS p, 0::BIGINT AS i, 'CASH' AS ticker, NULL::VARCHAR AS action, 1e0 AS w, 0e0 AS r FROM gk UNION ALL SELECT * FROM (
  WITH h AS (SELECT p, i + 1 AS i, ticker, w * (1 + r) / sum(w * (1 + r)) OVER (PARTITION BY p) AS w FROM rp
    WHERE (w > 0 OR ticker = 'CASH') AND i < (SELECT max(i) FROM gd)),
  b AS (SELECT coalesce(h.p, x.p) AS p, coalesce(h.i, x.i) AS i, coalesce(h.ticker, x.ticker) AS ticker, coalesce(w, 0) AS w, coalesce(r, 0) AS r, p_buy,
      CASE WHEN coalesce(h.ticker, x.ticker) = 'CASH' THEN NULL WHEN w > 1e-8 AND tradable AND (p_sell >= 0.8 OR p_hold < 0.25) THEN 'SELL' WHEN w > 1e-8 THEN 'HOLD'
        WHEN tradable AND p_buy >= 0.5 THEN 'BUY' ELSE 'FLAT' END AS action
    FROM (SELECT gp.* FROM gp JOIN (SELECT DISTINCT i FROM h) USING (i)) x FULL JOIN h ON h.p = x.p AND h.ticker = x.ticker),
  f AS (SELECT *, row_number() OVER (PARTITION BY p, action ORDER BY p_buy DESC, ticker) AS rk, count(*) FILTER (action = 'HOLD') OVER (PARTITION BY p) AS kept,
      sum(CASE WHEN action = 'SELL' OR ticker = 'CASH' THEN w ELSE 0 END) OVER (PARTITION BY p) AS funds FROM b),
  a AS (SELECT *, coalesce(action = 'BUY' AND rk <= least(8 - kept, floor((funds + 1e-12) / 0.07)), false) AS got FROM f)
  SELECT p, i, ticker, action, CASE WHEN ticker = 'CASH' THEN funds - 0.07 * count(*) FILTER (got) OVER (PARTITION BY p)
    WHEN action = 'HOLD' THEN w WHEN got THEN 0.07 ELSE 0 END AS w, r FROM a))"""
add(
    "k13_policy_replay",
    lambda s, sf: replayed(s, sf).select("portfolio_id", "decision_date", "ticker", "action", sig("weight")),
    with_sql(*BASE, PROBS, GATED, REPLAYED, recursive=True) + f"\nSELECT p AS portfolio_id, decision_date, ticker, action, {sig_sql('w', 'weight')} FROM rp JOIN gd USING (i)",
)


#: Settings of the sweep: buy, hold and sell threshold, entry weight, positions.
SETTINGS = {
    f"{buy}-{sell}-{slots}": PolicyConfig(
        buy_threshold=buy, hold_threshold=0.25, sell_threshold=sell, entry_weight=entry, max_positions=slots, max_position_weight=0.2
    )
    for buy in (0.4, 0.55, 0.7)
    for sell, slots, entry in ((0.8, 8, 0.07), (0.9, 4, 0.15))
}


def swept(s, sf):
    """Every week's actions and book under every setting, in two blocks of settings."""
    rows = probabilities(s, sf).withColumn("portfolio_id", F.lit("one"))
    return policy_sweep.sweep(rows, SETTINGS, block=4)


def _for_every_setting(sql: str) -> str:
    """The statement of the replay, with thresholds from the table of settings."""
    for fixed, column in (("p_sell >= 0.8", "p_sell >= sell_at"), ("p_hold < 0.25", "p_hold < hold_at"), ("p_buy >= 0.5", "p_buy >= buy_at"), ("0.07", "entry"), ("8 - kept", "slots - kept")):
        assert fixed in sql
        sql = sql.replace(fixed, column)
    sql = sql.replace("FROM gk UNION ALL", "FROM st UNION ALL").replace("'shift_' || k AS p", "p")
    sql = sql.replace("x FULL JOIN h ON h.p = x.p AND h.ticker = x.ticker)", "x FULL JOIN h ON h.p = x.p AND h.ticker = x.ticker JOIN st ON st.p = coalesce(h.p, x.p))")
    sql = sql.replace("coalesce(r, 0) AS r, p_buy,", "coalesce(r, 0) AS r, p_buy, entry, slots,")
    return sql.replace("entry * count(*) FILTER (got) OVER (PARTITION BY p)", "any_value(entry) OVER (PARTITION BY p) * count(*) FILTER (got) OVER (PARTITION BY p)")


SWEPT_DAYS = """gd AS (SELECT decision_date, row_number() OVER (ORDER BY decision_date) AS i FROM (SELECT DISTINCT decision_date FROM probs)),
st AS (SELECT * FROM (VALUES {}) AS t(p, buy_at, hold_at, sell_at, entry, slots)),
gp AS (SELECT p, i, pb.ticker, p_buy, p_hold, p_sell, tradable, ret AS r
    FROM probs pb JOIN gd USING (decision_date) JOIN returns r ON r.decision_date = pb.decision_date AND r.ticker = pb.ticker, st
  UNION ALL SELECT p, i, 'CASH', NULL, NULL, NULL, NULL, 0 FROM gd, st)""".format(
    ", ".join(f"('{n}', {c.buy_threshold}::DOUBLE, {c.hold_threshold}::DOUBLE, {c.sell_threshold}::DOUBLE, {c.entry_weight}::DOUBLE, {c.max_positions})" for n, c in SETTINGS.items())
)
add(
    "k13_policy_sweep",
    lambda s, sf: swept(s, sf).select("setting", "decision_date", "ticker", "action", sig("weight")),
    with_sql(*BASE, PROBS, SWEPT_DAYS, _for_every_setting(REPLAYED), recursive=True)
    + f"\nSELECT p AS setting, decision_date, ticker, action, {sig_sql('w', 'weight')} FROM rp JOIN gd USING (i)",
)


def action_rows(s, sf):
    return policy.decide(holdings(s, sf), probabilities(s, sf), GATE).filter("ticker <> 'CASH'").select("decision_date", "ticker", "action")


PERIODS = """ev AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY decision_date) AS n FROM decided),
bs AS (SELECT * FROM ev WHERE action IN ('BUY', 'SELL')),
isl AS (SELECT *, coalesce(sum((action = 'SELL')::INT) OVER (PARTITION BY ticker ORDER BY decision_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM bs),
hp AS (SELECT ticker, g, min(decision_date) FILTER (action = 'BUY') AS entry_date, max(decision_date) FILTER (action = 'SELL') AS exit_date,
  max(n) FILTER (action = 'SELL') - min(n) FILTER (action = 'BUY') + 1 AS holding_periods FROM isl GROUP BY ticker, g
  HAVING bool_or(action = 'BUY') AND bool_or(action = 'SELL'))"""
add(
    "k14_holding_periods",
    lambda s, sf: policy.holding_periods(action_rows(s, sf)),
    with_sql(*HELD, PERIODS) + "\nSELECT ticker, entry_date, exit_date, holding_periods FROM hp",
)
add(
    "x12_action_counts",
    lambda s, sf: policy.action_counts(action_rows(s, sf)),
    with_sql(*HELD) + "\nSELECT action, count(*) AS n FROM decided GROUP BY 1",
)
add(
    "x12_holding_summary",
    lambda s, sf: policy.holding_summary(policy.holding_periods(action_rows(s, sf))).select("n", *sigs("mean", "std", "min", "q25", "median", "q75", "max")),
    with_sql(*HELD, PERIODS)
    + "\nSELECT count(*) AS n, "
    + ", ".join(sig_sql(x, a) for x, a in (("avg(h)", "mean"), ("stddev_samp(h)", "std"), ("min(h)", '"min"'), ("quantile_cont(h, 0.25)", "q25"), ("quantile_cont(h, 0.5)", '"median"'), ("quantile_cont(h, 0.75)", "q75"), ("max(h)", '"max"')))
    + " FROM (SELECT CAST(holding_periods AS DOUBLE) AS h FROM hp)",
)

# Ledger --------------------------------------------------------------------
COST = LedgerConfig(cost_rate=0.001, reward=RewardConfig(drawdown_limit=0.1, drawdown_penalty=1.0, turnover_penalty=0.01, active_risk_penalty=0.5))
LEDGER = """pr AS (SELECT pw.*, coalesce(r.ret, 0) AS r FROM pw LEFT JOIN returns r ON r.decision_date = pw.decision_date AND r.ticker = pw.ticker),
tt AS (SELECT p, decision_date, sum(w * r) AS gross, sum(w * (1 + r)) AS worth, lead(decision_date) OVER (PARTITION BY p ORDER BY decision_date) AS nxt FROM pr GROUP BY 1, 2),
dr AS (SELECT pr.p, nxt AS decision_date, ticker, w * (1 + r) / worth AS d FROM pr JOIN tt ON tt.p = pr.p AND tt.decision_date = pr.decision_date WHERE nxt IS NOT NULL
  UNION ALL SELECT p, min(decision_date), 'CASH', 1.0 FROM pr GROUP BY p),
tv AS (SELECT coalesce(a.p, b.p) AS p, coalesce(a.decision_date, b.decision_date) AS decision_date, sum(abs(coalesce(w, 0) - coalesce(d, 0))) AS turnover
  FROM pr a FULL JOIN dr b ON a.p = b.p AND a.decision_date = b.decision_date AND a.ticker = b.ticker GROUP BY 1, 2),
pe AS (SELECT tt.p, tt.decision_date, gross, turnover, 0.001 * turnover AS cost, gross - 0.001 * turnover AS net FROM tt JOIN tv ON tv.p = tt.p AND tv.decision_date = tt.decision_date),
va AS (SELECT *, product(1 + net) OVER (PARTITION BY p ORDER BY decision_date) AS val FROM pe),
lg AS (SELECT v.*, pk, 1 - val / pk AS dd, m.ret AS b FROM (SELECT *, greatest(1, max(val) OVER (PARTITION BY p ORDER BY decision_date)) AS pk FROM va) v LEFT JOIN mreturns m USING (decision_date))"""


def book(s, sf, cfg=COST):
    calendar = weekly(s, sf)
    held = returns(s, sf, calendar)
    market = market_returns(s, sf, calendar).select("decision_date", F.col("return").alias("benchmark_return"))
    return ledger.ledger(portfolios(s, sf, held), held, cfg, market, checked=True)


def _rows(s, sf):
    held = returns(s, sf)
    return ledger.with_returns(portfolios(s, sf, held), held)


add(
    "e1_drifted_weights",
    lambda s, sf: ledger.with_worth(_rows(s, sf)).select("portfolio_id", "decision_date", "ticker", sig("drifted_weight")),
    with_sql(*BASE, PW, LEDGER) + f"\nSELECT pr.p AS portfolio_id, pr.decision_date, ticker, {sig_sql('w * (1 + r) / worth', 'drifted_weight')} FROM pr JOIN tt ON tt.p = pr.p AND tt.decision_date = pr.decision_date",
)
for name, mine, theirs in (
    ("e2_turnover", "turnover", "turnover"),
    ("e3_transaction_cost", "transaction_cost", "cost"),
    ("e6_gross_return", "gross_return", "gross"),
    ("e6_net_return", "net_return", "net"),
    ("e7_portfolio_value", "portfolio_value", "val"),
    ("e7_drawdown", "drawdown", "dd"),
):
    add(
        name,
        lambda s, sf, m=mine: book(s, sf).select("portfolio_id", "decision_date", sig(m)),
        with_sql(*BASE, PW, LEDGER) + f"\nSELECT p AS portfolio_id, decision_date, {sig_sql(theirs, mine)} FROM lg",
    )
ENTER = """st AS (SELECT pr.p, pr.decision_date, ticker, 1.0 / count(*) OVER (PARTITION BY pr.p, pr.decision_date) AS d FROM pr WHERE decision_date = (SELECT min(decision_date) FROM pr)),
tf AS (SELECT a.p, a.decision_date, sum(abs(w - d)) AS turnover FROM pr a JOIN st USING (p, decision_date, ticker) GROUP BY 1, 2)"""
add(
    "e2_first_turnover_from_equal_weight",
    lambda s, sf: book(s, sf, LedgerConfig(cost_rate=0.001, initial="equal_weight")).groupBy("portfolio_id").agg(
        F.min("decision_date").alias("decision_date"), F.min_by("turnover", "decision_date").alias("t")
    ).select("portfolio_id", "decision_date", sig("t", "turnover")),
    with_sql(*BASE, PW, LEDGER, ENTER) + f"\nSELECT p AS portfolio_id, decision_date, {sig_sql('turnover')} FROM tf",
)
add(
    "e5_liquidity_cost",
    lambda s, sf: bars(s, sf).select("date", "ticker", sig(weights.liquidity_cost(F.col("volume") / 1000.0, (F.col("high") - F.col("low")) / F.col("close") * 100.0), "cost")),
    with_sql(BARS) + f"\nSELECT date, ticker, {sig_sql('(high - low) / close * 100 / 10000 + 10.0 / 10000 * sqrt(volume / 1000.0)', 'cost')} FROM bars",
)
SOFTPLUS = "0.01 * (greatest((dd - 0.1) / 0.01, 0) + ln(1 + exp(-abs((dd - 0.1) / 0.01))))"
REWARD = f"ln(greatest(1 + net, 1e-8)) - {SOFTPLUS} - 0.05 * pow(greatest(-net, 0), 2) - 0.01 * turnover - 0.5 * pow(net - b, 2)"
add(
    "e8_reward",
    lambda s, sf: book(s, sf).select("portfolio_id", "decision_date", sig("reward")),
    with_sql(*BASE, PW, LEDGER) + f"\nSELECT p AS portfolio_id, decision_date, {sig_sql(REWARD, 'reward')} FROM lg",
)
E9 = LedgerConfig(cost_rate=0.001, top_n=6, max_position_weight=0.15)
GOOD_PW = """pw AS (SELECT 'raw' AS p, decision_date, ticker, w FROM c3)"""
E9_CTES = [*BASE, TARGETS.replace("targets AS", "raw_targets AS"), "targets AS (SELECT decision_date, ticker, coalesce(CASE WHEN day(decision_date) IN (13, 27) THEN (ticker = 'CASH')::INT END, w) AS w FROM raw_targets)",
           _norm("targets", "n0"), TOP.replace("FROM n)", "FROM n0)"), _norm("top", "n"), CAP, _norm("cap2", "c3"), GOOD_PW, LEDGER]


def usable_targets(s, sf):
    t = targets(s, sf)
    bad = F.dayofmonth("decision_date").isin(13, 27)
    return t.withColumn("weight", F.when(bad, F.when(F.col("ticker") == "CASH", 1.0).otherwise(0.0)).otherwise(F.col("weight")))


add(
    "e9_constrained_ledger",
    lambda s, sf: ledger.ledger(usable_targets(s, sf), returns(s, sf), E9).select("portfolio_id", "decision_date", *sigs("turnover", "net_return", "portfolio_value", "drawdown")),
    with_sql(*E9_CTES) + f"\nSELECT p AS portfolio_id, decision_date, {sig_sql('turnover')}, {sig_sql('net', 'net_return')}, {sig_sql('val', 'portfolio_value')}, {sig_sql('dd', 'drawdown')} FROM lg",
)
def _fallback_sql(rule: str) -> list[str]:
    """The targets' dates one after the other; ``rule`` turns the weights ``q`` of a date into the executed ones."""
    return [
        """fd AS (SELECT decision_date, row_number() OVER (ORDER BY decision_date) AS i, count(w) = count(*) AND sum(greatest(w, 0)) > 0 AS ok FROM targets GROUP BY 1),
ft AS (SELECT i, ok, t.decision_date, t.ticker, t.w AS t, coalesce(r.ret, 0) AS r FROM targets t JOIN fd USING (decision_date)
  LEFT JOIN returns r ON r.decision_date = t.decision_date AND r.ticker = t.ticker)""",
        f"""fb AS (SELECT 0::BIGINT AS i, NULL::DATE AS decision_date, 'CASH' AS ticker, 1e0 AS w, 0e0 AS r UNION ALL SELECT * FROM (
  WITH m AS (SELECT ft.i, ft.decision_date, ft.ticker, ft.r, CASE WHEN ok THEN greatest(t, 0) ELSE greatest(coalesce(p.w * (1 + p.r), 0), 0) END AS m
    FROM ft JOIN (SELECT DISTINCT i + 1 AS i FROM fb) s ON s.i = ft.i LEFT JOIN fb p ON p.ticker = ft.ticker),
  q AS (SELECT *, CASE WHEN sum(m) OVER () > 0 THEN m / sum(m) OVER () WHEN ticker = 'CASH' THEN 1 ELSE 0 END AS q FROM m),
  {rule}))""",
    ]


FALLBACK = _fallback_sql("z AS (SELECT *, q AS w FROM q) SELECT i, decision_date, ticker, w, r FROM z")
FALLBACK_E9 = _fallback_sql(
    """top6 AS (SELECT * REPLACE (CASE WHEN ticker = 'CASH' OR row_number() OVER (PARTITION BY ticker = 'CASH' ORDER BY q DESC, ticker) <= 6 THEN q ELSE 0 END AS q) FROM q),
  full6 AS (SELECT * REPLACE (CASE WHEN sum(q) OVER () > 0 THEN q / sum(q) OVER () WHEN ticker = 'CASH' THEN 1 ELSE 0 END AS q) FROM top6),
  low AS (SELECT * REPLACE (CASE WHEN ticker = 'CASH' THEN q ELSE least(q, 0.15) END AS q) FROM full6),
  z AS (SELECT *, q + CASE WHEN ticker = 'CASH' THEN greatest(1 - sum(q) OVER (), 0) ELSE 0 END AS w FROM low)
  SELECT i, decision_date, ticker, w / sum(w) OVER () AS w, r FROM z"""
)
for name, cfg, ctes in (("e9_fallback_to_holdings", LedgerConfig(), FALLBACK), ("e9_fallback_capped", E9, FALLBACK_E9)):
    add(
        name,
        lambda s, sf, c=cfg: ledger.executed_weights(targets(s, sf), returns(s, sf), c).select("portfolio_id", "decision_date", "ticker", sig("weight")),
        with_sql(*BASE, TARGETS, *ctes, recursive=True) + f"\nSELECT 'raw' AS portfolio_id, decision_date, ticker, {sig_sql('w', 'weight')} FROM fb WHERE i > 0",
    )
LIQUID_COST = "turnover * (0.001 + (5e0 + 2e1 * sqrt(greatest(turnover * val / 5e6, 0))) / 1e4)"
LIQUID = f"""st_ AS (SELECT p, decision_date, gross, turnover, row_number() OVER (PARTITION BY p ORDER BY decision_date) AS i FROM pe),
liq AS (SELECT DISTINCT p, NULL::DATE AS decision_date, 0::BIGINT AS i, 0e0 AS cost, 1e0 AS val FROM st_
  UNION ALL SELECT s.p, s.decision_date, s.i, {LIQUID_COST}, val * (1 + gross - {LIQUID_COST}) FROM liq JOIN st_ s ON s.p = liq.p AND s.i = liq.i + 1)"""
add(
    "e4_liquidity_ledger",
    lambda s, sf: book(s, sf, LedgerConfig(cost_rate=0.001, average_dollar_volume=5e6, spread_bps=5.0, impact_bps=20.0)).select("portfolio_id", "decision_date", *sigs("transaction_cost", "portfolio_value")),
    with_sql(*BASE, PW, LEDGER, LIQUID, recursive=True) + f"\nSELECT p AS portfolio_id, decision_date, {sig_sql('cost', 'transaction_cost')}, {sig_sql('val', 'portfolio_value')} FROM liq WHERE i > 0",
)


def by_split(s, sf):
    out = splits.assign_splits(book(s, sf), split_table(s, sf), "decision_date").filter(F.col("role") == "test")
    return out.drop("role")


PERIOD_SQL = """lt AS (SELECT lg.*, split_index, test_start, test_end FROM lg JOIN splits ON decision_date BETWEEN test_start AND test_end)"""
add(
    "e10_continuous_test_path",
    lambda s, sf: by_split(s, sf).select("portfolio_id", "split_index", "decision_date", sig("portfolio_value")),
    with_sql(*BASE, PW, LEDGER, splits_sql(), PERIOD_SQL) + f"\nSELECT p AS portfolio_id, split_index, decision_date, {sig_sql('val', 'portfolio_value')} FROM lt",
)
add(
    "e11_objective",
    lambda s, sf: ledger.objective(book(s, sf)).select("portfolio_id", *sigs("loss", "mean_net_return", "mean_drawdown_excess", "mean_turnover", "final_equity")),
    with_sql(*BASE, PW, LEDGER)
    + "\nSELECT p AS portfolio_id, "
    + ", ".join(
        sig_sql(x, a)
        for x, a in (
            ("-avg(net) / (stddev_pop(net) + 1e-8) + avg(greatest(1 - val / (pk + 1e-8) - 0.2, 0))", "loss"), ("avg(net)", "mean_net_return"),
            ("avg(greatest(1 - val / (pk + 1e-8) - 0.2, 0))", "mean_drawdown_excess"), ("avg(turnover)", "mean_turnover"), ("max_by(val, decision_date)", "final_equity"),
        )
    )
    + " FROM lg GROUP BY p",
)
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
add(
    "e12_allocation_export",
    lambda s, sf: ledger.allocation_export(portfolios(s, sf), BRANDS).select("portfolio_id", "decision_date", *[sig(F.col(f"`{b}`"), "w" + b[6:]) for b in BRANDS], sig("CASH")),
    with_sql(*BASE, PW)
    + "\nSELECT p AS portfolio_id, decision_date, "
    + ", ".join([sig_sql(f"max(CASE WHEN ticker = '{b}' THEN w END)", "w" + b[6:]) for b in BRANDS] + [sig_sql("max(CASE WHEN ticker = 'CASH' THEN w END)", "CASH")])
    + " FROM pw GROUP BY 1, 2",
)

# Metrics -------------------------------------------------------------------
def metrics_sql(source: str, keys: str, n: str = "net", t: str = "turnover", c: str = "cost", p: int = 52) -> str:
    return f"""eqv AS (SELECT *, product(1 + {n}) OVER (PARTITION BY {keys} ORDER BY decision_date) AS eq FROM {source}),
ddv AS (SELECT *, 1 - eq / max(eq) OVER (PARTITION BY {keys} ORDER BY decision_date) AS mdd FROM eqv),
agg AS (SELECT {keys}, count(*) AS k, max_by(eq, decision_date) AS grown, product(1 + b) AS bg, avg({n}) AS mu, stddev_pop({n}) AS sd, avg(b) AS bm, var_pop(b) AS bv,
  covar_pop({n}, b) AS cv, sqrt(avg(pow(least({n}, 0), 2))) AS dn, avg({n} - b) AS am, stddev_pop({n} - b) AS asd, max(mdd) AS mdd, avg({t}) AS mt, sum({c}) AS tc FROM ddv GROUP BY {keys}),
met AS (SELECT {keys}, bg - 1 AS bench_return, grown - 1 AS cumulative_return, pow(grown, {p}.0 / k) - 1 AS annualized_return, sd * sqrt({p}) AS volatility, mdd AS max_drawdown, mt AS mean_turnover,
  tc AS total_transaction_cost, grown - bg AS relative_alpha, CASE WHEN sd > 0 THEN mu / sd * sqrt({p}) ELSE 0 END AS sharpe_ratio,
  CASE WHEN dn > 0 THEN mu * {p} / (dn * sqrt({p})) ELSE 0 END AS sortino_ratio, CASE WHEN mdd > 0 THEN (pow(grown, {p}.0 / k) - 1) / mdd ELSE 0 END AS calmar_ratio,
  asd * sqrt({p}) AS tracking_error, CASE WHEN asd > 0 THEN am * {p} / (asd * sqrt({p})) ELSE 0 END AS information_ratio,
  CASE WHEN bv > 0 THEN cv / bv ELSE 0 END AS beta, (mu - (CASE WHEN bv > 0 THEN cv / bv ELSE 0 END) * bm) * {p} AS regression_alpha FROM agg)"""


M = metrics.METRICS
add(
    "x1_equity_curve",
    lambda s, sf: metrics.equity_curve(book(s, sf)).select("portfolio_id", "decision_date", sig("equity")),
    with_sql(*BASE, PW, LEDGER) + f"\nSELECT p AS portfolio_id, decision_date, {sig_sql('val', 'equity')} FROM lg",
)
add(
    "x2_max_drawdown",
    lambda s, sf: metrics.drawdown_curve(metrics.equity_curve(book(s, sf))).groupBy("portfolio_id").agg(F.max("drawdown").alias("m")).select("portfolio_id", sig("m", "max_drawdown")),
    with_sql(*BASE, PW, LEDGER, metrics_sql("lg", "p")) + f"\nSELECT p AS portfolio_id, {sig_sql('max_drawdown')} FROM met",
)
add(
    "x3_metrics_by_year",
    lambda s, sf: metrics.performance(book(s, sf).withColumn("year", F.year("decision_date")), 52, ("portfolio_id", "year")).select("portfolio_id", "year", *sigs(*M)),
    with_sql(*BASE, PW, LEDGER, "ly AS (SELECT *, year(decision_date)::INT AS y FROM lg)", metrics_sql("ly", "p, y")) + f"\nSELECT p AS portfolio_id, y AS year, {sigs_sql(*M)} FROM met",
)
add(
    "x3_metrics_total",
    lambda s, sf: metrics.performance(book(s, sf), 52).select("portfolio_id", *sigs(*M)),
    with_sql(*BASE, PW, LEDGER, metrics_sql("lg", "p")) + f"\nSELECT p AS portfolio_id, {sigs_sql(*M)} FROM met",
)
add(
    "x4_benchmark_against_itself",
    lambda s, sf: metrics.performance(
        metrics.with_benchmark_portfolio(by_split(s, sf).select("portfolio_id", "split_index", "decision_date", "net_return", "benchmark_return", "turnover", "transaction_cost")), 52, ("portfolio_id", "split_index")
    ).filter(F.col("portfolio_id") == "BENCHMARK").select("split_index", *sigs(*M)),
    with_sql(*BASE, PW, LEDGER, splits_sql(), PERIOD_SQL, "bo AS (SELECT DISTINCT split_index, decision_date, b, b AS net, 0 AS turnover, 0 AS cost FROM lt)", metrics_sql("bo", "split_index")) + f"\nSELECT split_index, {sigs_sql(*M)} FROM met",
)
add(
    "x5_cost_stress",
    lambda s, sf: metrics.cost_stress(book(s, sf), 52).select("portfolio_id", "multiplier", *sigs(*M)),
    with_sql(*BASE, PW, LEDGER, "ls AS (SELECT p, decision_date, turnover, b, mult, net + cost * (1 - mult) AS net, cost * mult AS cost FROM lg, (SELECT unnest([0.5, 1.0, 2.0, 3.0])::DOUBLE AS mult))", metrics_sql("ls", "p, mult")) + f"\nSELECT p AS portfolio_id, mult AS multiplier, {sigs_sql(*M)} FROM met",
)
add(
    "x6_execution_delay",
    lambda s, sf: metrics.delayed_returns(book(s, sf), 2).select("portfolio_id", "decision_date", sig("delayed_return")),
    with_sql(*BASE, PW, LEDGER) + f"\nSELECT p AS portfolio_id, decision_date, {sig_sql('lag(net, 2, 0) OVER (PARTITION BY p ORDER BY decision_date)', 'delayed_return')} FROM lg",
)
add(
    "x7_capacity",
    lambda s, sf: metrics.capacity(bars(s, sf).withColumn("dollar_volume", F.col("close") * F.col("volume")), 0.1, ("ticker",)).select("ticker", *sigs("average_dollar_volume", "estimated_capacity")),
    with_sql(BARS) + f"\nSELECT ticker, {sig_sql('avg(close * volume)', 'average_dollar_volume')}, {sig_sql('avg(close * volume) * 0.1', 'estimated_capacity')} FROM bars GROUP BY 1",
)
add(
    "x8_block_metrics",
    lambda s, sf: metrics.block_metrics(book(s, sf), 52, 26).select("portfolio_id", "block", *sigs(*M)),
    with_sql(*BASE, PW, LEDGER, "lb1 AS (SELECT *, (row_number() OVER (PARTITION BY p ORDER BY decision_date) - 1) // 26 AS block FROM lg)", "lb2 AS (SELECT p, decision_date, net, b, block, 0 AS turnover, 0 AS cost FROM (SELECT *, count(*) OVER (PARTITION BY p, block) AS c FROM lb1) WHERE c = 26)", metrics_sql("lb2", "p, block")) + f"\nSELECT p AS portfolio_id, block, {sigs_sql(*M)} FROM met",
)
add(
    "x9_release_validation",
    lambda s, sf: metrics.release_validation(book(s, sf), 52, 0.6, -1.0).select("portfolio_id", F.col("base_passed").cast("int").alias("base_passed"), F.col("passed").cast("int").alias("passed")),
    with_sql(*BASE, PW, LEDGER, "ls AS (SELECT p, decision_date, turnover, b, mult, net + cost * (1 - mult) AS net, cost * mult AS cost FROM lg, (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS mult))", metrics_sql("ls", "p, mult"))
    + "\nSELECT p AS portfolio_id, max(CASE WHEN mult = 1 THEN (max_drawdown <= 0.6 AND information_ratio >= -1)::INT END) AS base_passed, min((max_drawdown <= 0.6 AND information_ratio >= -1)::INT) AS passed FROM met GROUP BY 1",
)
AGAINST = ("relative_alpha", "tracking_error", "information_ratio", "beta", "regression_alpha")
SHOWN = {"bench_return": "benchmark_cumulative_return"} | {m: m if m in AGAINST else "portfolio_" + m for m in M if m not in ("annualized_return", "volatility")}
add(
    "x11_split_metrics",
    lambda s, sf: metrics.split_metrics_table(by_split(s, sf), split_table(s, sf), 52).select("portfolio_id", "split_index", "test_start", "test_end", *sigs(*SHOWN.values())),
    with_sql(*BASE, PW, LEDGER, splits_sql(), PERIOD_SQL, metrics_sql("lt", "p, split_index, test_start, test_end"))
    + "\nSELECT p AS portfolio_id, split_index, test_start, test_end, "
    + ", ".join(sig_sql(x, a) for x, a in SHOWN.items())
    + " FROM met",
)

# Reporting -----------------------------------------------------------------
add(
    "z1_drawdown_series",
    lambda s, sf: metrics.drawdown_curve(metrics.equity_curve(book(s, sf))).select("portfolio_id", "decision_date", sig("drawdown")),
    with_sql(*BASE, PW, LEDGER) + f"\nSELECT p AS portfolio_id, decision_date, {sig_sql('1 - val / max(val) OVER (PARTITION BY p ORDER BY decision_date)', 'drawdown')} FROM lg",
)
add(
    "z2_top_names_by_mean_weight",
    lambda s, sf: reporting.top_names(weights.normalize(targets(s, sf)), 5, include_cash=False).select("ticker", sig("mean_weight")),
    with_sql(*BASE, TARGETS, _norm("targets", "n")) + f"\nSELECT ticker, {sig_sql('m', 'mean_weight')} FROM (SELECT ticker, avg(w) AS m FROM n WHERE ticker <> 'CASH' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)",
)
add(
    "z3_monthly_weights",
    lambda s, sf: reporting.resampled(weights.normalize(targets(s, sf)), "M").select("ticker", "period", sig("weight")),
    with_sql(*BASE, TARGETS, _norm("targets", "n")) + f"\nSELECT ticker, CAST(date_trunc('month', decision_date) AS DATE) AS period, {sig_sql('max_by(w, decision_date)', 'weight')} FROM n GROUP BY 1, 2",
)
add(
    "z4_active_names",
    lambda s, sf: reporting.active_names(weights.keep_top_n(weights.normalize(targets(s, sf)), 6), 0.1, 10).select("ticker", sig("usage")),
    with_sql(*BASE, TARGETS, _norm("targets", "n"), TOP, _norm("top", "t2")) + f"\nSELECT ticker, {sig_sql('u', 'usage')} FROM (SELECT ticker, sum(abs(w)) AS u FROM t2 WHERE ticker <> 'CASH' GROUP BY 1 HAVING max(abs(w)) > 0.1 ORDER BY 2 DESC, 1 LIMIT 10)",
)


def regimes(s, sf):
    frac = lambda n: score_column() * n - F.floor(score_column() * n)
    return returns(s, sf).groupBy("decision_date").agg(F.avg(frac(1)).alias("calm"), F.avg(frac(3)).alias("trend"), F.avg(frac(7)).alias("panic"))


add(
    "z5_dominant_regime",
    lambda s, sf: reporting.dominant_regime(book(s, sf).select("portfolio_id", "decision_date", "portfolio_value"), regimes(s, sf), ["calm", "trend", "panic"]).select("portfolio_id", "decision_date", "dominant_regime"),
    with_sql(*BASE, PW, LEDGER, f"sc AS (SELECT decision_date, {RAW_SCORE} AS q FROM returns)", "rg AS (SELECT decision_date, avg(q - floor(q)) AS a, avg(3*q - floor(3*q)) AS b3, avg(7*q - floor(7*q)) AS c FROM sc GROUP BY 1)")
    + "\nSELECT p AS portfolio_id, decision_date, CASE WHEN a >= b3 AND a >= c THEN 'calm' WHEN b3 >= c THEN 'trend' ELSE 'panic' END AS dominant_regime FROM lg JOIN rg USING (decision_date)",
)
add(
    "z6_long_form",
    lambda s, sf: reporting.long_form(regimes(s, sf), ["calm", "panic"]).select("decision_date", "feature", sig("value")),
    with_sql(*BASE, f"sc AS (SELECT decision_date, {RAW_SCORE} AS q FROM returns)")
    + f"\nSELECT decision_date, 'calm' AS feature, {sig_sql('avg(q - floor(q))', 'value')} FROM sc GROUP BY 1 UNION ALL SELECT decision_date, 'panic', {sig_sql('avg(7*q - floor(7*q))', 'value')} FROM sc GROUP BY 1",
)
