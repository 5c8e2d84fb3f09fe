"""Sources, ingest cleaning, routing, joins, calendars and returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate.base import (
    BARS,
    BENCH,
    RETURNS,
    WEEKLY,
    add,
    bars,
    bench,
    case,
    macro,
    sig,
    sig_sql,
    sigs,
    sigs_sql,
    table,
    with_sql,
)
from gate.features import EXPR, RELATIVE, RELATIVE_CTES, features_sql, rank_sql
from tapeweave.config import DeskConfig
from tapeweave.operators import calendar as cal
from tapeweave.operators import datasets, lineage, routing
from tapeweave.operators.asset_features import asset_features
from tapeweave.operators.cross_section import percentile_ranks
from tapeweave.operators.macro import series_name_column
from tapeweave.operators.market_relative import market_relative_features, with_benchmark
from tapeweave.sources import desk, universe, validation, vendor
from tapeweave.sources.bars import benchmark_subset, trading_calendar
from tapeweave.session import cut_lineage
from tapeweave.sources.schema import enforce_ohlcv, enforce_returns

PRICES = ["open", "high", "low", "close"]


def market(spark, sf):
    """Asset bars and the benchmark's bars in one table, as a cache would hold them."""
    return bars(spark, sf).unionByName(bench(spark, sf))


def weekly(spark, sf):
    """The calendar is a few rows used many times: it is written once."""
    return cut_lineage(cal.weekly_calendar(bars(spark, sf)))


def returns(spark, sf, calendar=None):
    """Holding returns, read by several steps of most queries: written once."""
    return cut_lineage(cal.open_to_open_returns(bars(spark, sf), calendar or weekly(spark, sf)))


def market_returns(spark, sf, calendar=None):
    return cal.open_to_open_returns(bench(spark, sf), calendar or weekly(spark, sf))


MARKET_RETURNS = """mreturns AS (SELECT w.*, z.open / a.open - 1 AS ret FROM weekly w
  JOIN bench a ON a.date = w.execution_date JOIN bench z ON z.date = w.next_execution_date)"""

add(
    "a1_bars",
    lambda s, sf: enforce_ohlcv(bars(s, sf)).select("date", "ticker", *sigs(*PRICES, "adj_close"), "volume"),
    with_sql(BARS) + f"\nSELECT date, ticker, {sigs_sql(*PRICES)}, {sig_sql('close', 'adj_close')}, volume FROM bars",
)
add(
    "a5_returns_schema",
    lambda s, sf: enforce_returns(returns(s, sf)).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("decision_date").alias("first_date"), sig(F.avg("return"), "mean_return")
    ),
    with_sql(BARS, WEEKLY, RETURNS)
    + f"\nSELECT ticker, count(*) AS n, min(decision_date) AS first_date, {sig_sql('avg(ret)', 'mean_return')} FROM returns GROUP BY ticker",
)


@case(
    "a6_null_counts",
    """SELECT * FROM (SELECT 'l_extendedprice' AS column_name, count(*) FILTER (l_extendedprice IS NULL OR l_quantity < 2) AS nulls FROM lineitem)
WHERE nulls > 0""",
)
def _nulls(s, sf):
    """Prints of a single share carry no price here, so the check has something to find."""
    line = table(s, sf, "lineitem")
    price = F.when(F.col("l_quantity") >= 2, F.col("l_extendedprice"))
    rows = line.select(
        F.col("l_shipdate").alias("date"), F.col("l_partkey").alias("ticker"), price.alias("open"),
        F.lit(1).alias("high"), F.lit(1).alias("low"), F.lit(1).alias("close"), F.lit(1).alias("adj_close"),
        F.lit(1).alias("volume"),
    )
    return validation.null_counts(rows).select(F.lit("l_extendedprice").alias("column_name"), "nulls")


add(
    "a6_missing_tickers",
    lambda s, sf: validation.missing_tickers(
        table(s, sf, "lineitem").select(F.concat(F.lit("P"), "l_suppkey").alias("ticker")),
        table(s, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("ticker")),
    ),
    "SELECT 'P' || p_partkey AS ticker FROM part WHERE p_partkey NOT IN (SELECT l_suppkey FROM lineitem)",
)
add(
    "a6_duplicate_bars",
    lambda s, sf: validation.duplicate_bars(
        table(s, sf, "lineitem").select(
            F.col("l_shipdate").cast("date").alias("date"), F.col("l_partkey").cast("string").alias("ticker")
        )
    ),
    """SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS ticker, count(*) AS copies
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
add(
    "a8_universe_first_positions",
    lambda s, sf: universe.first_positions(
        table(s, sf, "part").select(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("ticker"), F.col("p_partkey").alias("position"))
    ),
    "SELECT upper(p_brand) AS ticker, min(p_partkey) AS position FROM part GROUP BY 1",
)
add(
    "a8_universe_duplicates",
    lambda s, sf: universe.duplicate_symbols(table(s, sf, "part").select(F.lower("p_type").alias("ticker"))),
    "SELECT upper(p_type) AS ticker, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1",
)
add(
    "a8_universe_selected",
    lambda s, sf: universe.select_universe(
        table(s, sf, "part").select(F.col("p_brand").alias("ticker"), F.col("p_partkey").alias("position")), max_stocks=10
    ),
    "SELECT upper(p_brand) AS ticker, min(p_partkey) AS position FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 10",
)
STATUS = ["F", "O", "P"]


def _vendor_wide(s, sf):
    """Daily order book per status, one column per status and field, as a vendor would land it."""
    orders = table(s, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    cells = []
    for k in STATUS:
        price = F.when(F.col("o_orderstatus") == k, F.col("o_totalprice"))
        cells += [
            F.max(price).alias(f"{k}|High"), F.min(price).alias(f"{k}|Low"), F.avg(price).alias(f"{k}|Open"),
            F.avg(price).alias(f"{k}|Close"), F.count(price).alias(f"{k}|Volume"),
        ]
        if k != "P":
            cells.append((F.avg(price) / 2).alias(f"{k}|Adj Close"))
    return orders.groupBy(F.col("d").alias("Date")).agg(*cells)


VENDOR_SQL = """w AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS ticker, max(o_totalprice) AS high, min(o_totalprice) AS low,
  avg(o_totalprice) AS open, avg(o_totalprice) AS close, avg(o_totalprice) / (CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END) AS adj_close,
  count(*) AS volume FROM orders GROUP BY 1, 2),
v AS (SELECT d.date, t.ticker, open, high, low, close, adj_close, coalesce(volume, 0) AS volume FROM (SELECT DISTINCT date FROM w) d
  CROSS JOIN (SELECT DISTINCT ticker FROM w) t LEFT JOIN w ON w.date = d.date AND w.ticker = t.ticker)"""
add(
    "a9_vendor_wide_to_long",
    lambda s, sf: vendor.wide_to_long(_vendor_wide(s, sf), STATUS).select("date", "ticker", *sigs(*PRICES, "adj_close"), "volume"),
    with_sql(VENDOR_SQL) + f"\nSELECT date, ticker, {sigs_sql(*PRICES, 'adj_close')}, volume FROM v",
)
add(
    "a10_back_adjusted",
    lambda s, sf: vendor.back_adjust(vendor.wide_to_long(_vendor_wide(s, sf), STATUS)).select("date", "ticker", *sigs(*PRICES)),
    with_sql(VENDOR_SQL)
    + "\nSELECT date, ticker, "
    + ", ".join(sig_sql(f"CASE WHEN close > 0 AND adj_close > 0 THEN {c} * (adj_close / close) END", c) for c in PRICES)
    + " FROM v",
)
add(
    "a11_vendor_macro",
    lambda s, sf: vendor.wide_to_macro(_vendor_wide(s, sf), STATUS).select("date", "ticker", sig("value")),
    with_sql(VENDOR_SQL) + f"\nSELECT date, ticker, {sig_sql('adj_close', 'value')} FROM v",
)
add(
    "a12_benchmark_subset",
    lambda s, sf: benchmark_subset(market(s, sf), "MKT").select("date", "ticker", *sigs(*PRICES), "volume"),
    with_sql(BARS, BENCH) + f"\nSELECT date, 'MKT' AS ticker, {sigs_sql(*PRICES)}, volume FROM bench",
)
add("a13_trading_calendar", lambda s, sf: trading_calendar(bars(s, sf)), with_sql(BARS) + "\nSELECT DISTINCT date FROM bars")


def _raw_desk(s, sf):
    """One raw row per print, several per day: the desk keeps the last, as text numbers."""
    line, part = table(s, sf, "lineitem"), table(s, sf, "part").select("p_partkey", "p_brand")
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("string")
    shown = F.when(F.col("l_discount") > 0.09, F.lit("n/a")).otherwise(price)
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias(" Ticker"), F.col("l_shipdate").alias("Date"),
        *[shown.alias(n.title()) for n in PRICES],
        F.col("l_quantity").alias("Volume"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount").alias("sequence"),
    )


LAST_SQL = """t AS (SELECT upper(p_brand) AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity AS volume,
  CASE WHEN l_discount > 0.09 THEN NULL ELSE l_extendedprice / l_quantity END AS px,
  row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
add(
    "a14_desk_cleaned",
    lambda s, sf: desk.cleaned(_raw_desk(s, sf), "sequence").select("date", "ticker", *sigs(*PRICES, "volume")),
    with_sql(LAST_SQL) + f"\nSELECT date, ticker, {', '.join(sig_sql('px', c) for c in PRICES)}, {sig_sql('volume')} FROM t WHERE n = 1 AND px IS NOT NULL",
)


@case(
    "a14_desk_errors",
    """SELECT o_custkey::VARCHAR AS ticker, CASE WHEN count(*) < 20 THEN count(*) || ' bars are complete, 20 are needed.'
  WHEN min(o_totalprice) - 2000 <= 0 THEN 'A price is zero or less.'
  WHEN bool_or(o_orderkey % 5 = 0) THEN 'A bar''s low and high don''t enclose its open and close.' END AS error
FROM orders GROUP BY 1 HAVING error IS NOT NULL""",
)
def _desk_errors(s, sf):
    price = F.col("o_totalprice") - 2000
    rows = table(s, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("ticker"), price.alias("open"), price.alias("close"), price.alias("low"),
        F.when(F.col("o_orderkey") % 5 == 0, price - 1).otherwise(price).alias("high"), F.lit(1.0).alias("volume"),
    )
    cfg = DeskConfig(
        ema_fast_span=2, ema_mid_span=3, ema_slow_span=4, high_lookback=4, momentum_medium_window=16,
        momentum_skip_window=2, drawdown_window=4, zone_lookback=4, swing_right=3,
    )
    return desk.history_errors(rows, cfg=cfg)


HEALTH = ["close", "mom_126_21d", "realized_vol_126", "close_vwap20_gap"]
add(
    "a15_data_health",
    lambda s, sf: desk.data_health(asset_features(bars(s, sf)), HEALTH).select(
        "ticker", "column_name", sig("missing_pct"), F.col("latest_is_finite").cast("int").alias("latest_is_finite"), sig("latest_value")
    ),
    features_sql(
        " UNION ALL ".join(
            f"SELECT ticker, '{c}' AS column_name, {sig_sql('100.0 * count(*) FILTER (v_' + c + ' IS NULL) / count(*)', 'missing_pct')}, "
            f"CAST(last(v_{c} ORDER BY date) IS NOT NULL AS INT) AS latest_is_finite, {sig_sql(f'last(v_{c} ORDER BY date)', 'latest_value')} FROM hv GROUP BY ticker"
            for c in HEALTH
        ),
        extra=["hv AS (SELECT date, ticker, " + ", ".join(f"{EXPR.get(c, c)} AS v_{c}" for c in HEALTH) + " FROM k)"],
    ),
)
add(
    "a16_missing_mask",
    lambda s, sf: desk.missing_mask(asset_features(bars(s, sf)), HEALTH[1:]).select(
        "date", "ticker", *[F.col(f"{c}__missing").cast("int").alias(f"{c}__missing") for c in HEALTH[1:]]
    ),
    features_sql("SELECT date, ticker, " + ", ".join(f"CAST(({EXPR[c]}) IS NULL AS INT) AS {c}__missing" for c in HEALTH[1:]) + " FROM k"),
)
add(
    "a19_fingerprint",
    lambda s, sf: lineage.table_fingerprint(table(s, sf, "lineitem")),
    """WITH d AS (SELECT sha256(concat_ws('|', """
    + ", ".join(f"l_{c}::VARCHAR" for c in sorted("orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus shipdate".split()))
    + """)) AS h FROM lineitem),
s AS (SELECT count(*) AS rows, """
    + " || '-' || ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))
    + " AS x FROM d) SELECT rows, sha256(rows::VARCHAR || '-' || x) AS digest FROM s",
)

# Routing -------------------------------------------------------------------


def routed(spark, sf, name: str):
    """Every column of a set in its order, ranks and market-relative ones included."""
    columns = routing.feature_set(name)
    df = asset_features(bars(spark, sf))
    if any(c in RELATIVE for c in columns):
        df = df.join(market_relative_features(bars(spark, sf), bench(spark, sf)), ["date", "ticker"], "left")
    raw = [c.removesuffix(routing.RANK_SUFFIX) for c in columns if c.endswith(routing.RANK_SUFFIX)]
    return routing.route(percentile_ranks(df, raw) if raw else df, name)


def routed_sql(name: str, rows: str = "TRUE", extra: tuple[str, ...] = ()) -> str:
    """The same, for the bars that meet ``rows``."""
    columns = routing.feature_set(name)
    raw = list(dict.fromkeys(c.removesuffix(routing.RANK_SUFFIX) for c in columns))
    own = [c for c in raw if c not in RELATIVE]
    ctes = ["ow AS (SELECT date, ticker, " + ", ".join(f"{EXPR[c]} AS v_{c}" for c in own) + " FROM k)"]
    relative = [c for c in raw if c in RELATIVE]
    if relative:
        ctes += [BENCH, *RELATIVE_CTES, "rv AS (SELECT date, ticker, " + ", ".join(f"{RELATIVE[c]} AS v_{c}" for c in relative) + " FROM re)"]
    ctes.append(f"wd AS (SELECT * FROM ow {'JOIN rv USING (date, ticker)' if relative else ''} WHERE {rows})")
    cell = lambda c: rank_sql("v_" + c.removesuffix(routing.RANK_SUFFIX), c) if c.endswith(routing.RANK_SUFFIX) else "v_" + c
    return features_sql("SELECT date, ticker, " + ", ".join(sig_sql(cell(c), c) for c in columns) + " FROM wd", extra=[*extra, *ctes])


for name in routing.FEATURE_SETS:
    add(
        f"b1_{name}",
        lambda s, sf, n=name: routed(s, sf, n).select("date", "ticker", *sigs(*routing.feature_set(n))),
        routed_sql(name),
    )
add(
    "b3_event_model_route",
    lambda s, sf: routing.route_event_model(asset_features(bars(s, sf))).select("date", "ticker", *sigs(*routing.EVENT_MODEL)),
    features_sql("SELECT date, ticker, " + ", ".join(sig_sql(EXPR[c], c) for c in routing.EVENT_MODEL) + " FROM k"),
)
add(
    "b5_decision_date_rows",
    lambda s, sf: cal.keep_dates(asset_features(bars(s, sf)).select("date", "ticker", "mom_21d"), cal.decision_dates(weekly(s, sf))).select("date", "ticker", sig("mom_21d")),
    features_sql(
        f"SELECT date, ticker, {sig_sql('v', 'mom_21d')} FROM v WHERE date IN (SELECT decision_date FROM weekly)",
        extra=[WEEKLY, f"v AS (SELECT date, ticker, {EXPR['mom_21d']} AS v FROM k)"],
    ),
)
add("b6_decision_dates_from_bars", lambda s, sf: cal.decision_dates(bars(s, sf)), with_sql(BARS, WEEKLY) + "\nSELECT decision_date AS date FROM weekly")
add(
    "b6_fridays",
    lambda s, sf: cal.decision_dates(bars(s, sf).select("date")),
    with_sql(BARS) + "\nSELECT DISTINCT date FROM bars WHERE isodow(date) = 5",
)
add(
    "b7_valid_opens",
    lambda s, sf: cal.valid_opens(
        bars(s, sf).withColumn("open", F.when(F.col("volume") % 7 == 0, 0.0).when(F.col("volume") % 11 == 0, float("nan")).otherwise(F.col("open")))
    ).select("date", "ticker", sig("open")),
    with_sql(BARS) + f"\nSELECT date, ticker, {sig_sql('open')} FROM bars WHERE volume % 7 <> 0 AND volume % 11 <> 0",
)
add(
    "b8_filter_by_dates",
    lambda s, sf: cal.keep_dates(bars(s, sf), weekly(s, sf), "date", "execution_date").select("date", "ticker", "volume"),
    with_sql(BARS, WEEKLY) + "\nSELECT date, ticker, volume FROM bars WHERE date IN (SELECT execution_date FROM weekly)",
)
add(
    "b9_complete_cross_sections",
    lambda s, sf: cal.complete_cross_sections(weekly(s, sf), returns(s, sf), market_returns(s, sf), bars(s, sf), 12).select("decision_date", "execution_date"),
    with_sql(BARS, BENCH, WEEKLY, RETURNS, MARKET_RETURNS)
    + """
SELECT decision_date, execution_date FROM weekly
WHERE decision_date IN (SELECT decision_date FROM returns GROUP BY 1 HAVING count(DISTINCT ticker) >= 12)
  AND decision_date IN (SELECT decision_date FROM mreturns)
  AND decision_date IN (SELECT date FROM bars WHERE close > 0 GROUP BY 1 HAVING count(DISTINCT ticker) >= 12)""",
)
add(
    "b10_feature_validity",
    lambda s, sf: asset_features(bars(s, sf)).select("date", "ticker", datasets.all_finite(routing.EVENT_MODEL).cast("int").alias("feature_valid")),
    features_sql("SELECT date, ticker, CAST(" + " AND ".join(f"({EXPR[c]}) IS NOT NULL" for c in routing.EVENT_MODEL) + " AS INT) AS feature_valid FROM k"),
)

# Joins and calendars -------------------------------------------------------
add(
    "c1_calendar_semi_join",
    lambda s, sf: cal.align_to_calendar(bars(s, sf), weekly(s, sf).select(F.col("decision_date").alias("date"))).select("date", "ticker", sig("close")),
    with_sql(BARS, WEEKLY) + f"\nSELECT date, ticker, {sig_sql('close')} FROM bars WHERE date IN (SELECT decision_date FROM weekly)",
)
add(
    "c2_execution_prices",
    lambda s, sf: cal.execution_prices(bars(s, sf), weekly(s, sf)).select("decision_date", "execution_date", "ticker", sig("open")),
    with_sql(BARS, WEEKLY) + f"\nSELECT decision_date, execution_date, ticker, {sig_sql('open')} FROM weekly JOIN bars ON date = execution_date",
)
add(
    "c4_benchmark_join",
    lambda s, sf: with_benchmark(bars(s, sf), bench(s, sf).filter(F.weekday("date") != 2)).select(
        "date", "ticker", sig("__market", "market_close"), sig("__market_return", "market_return")
    ),
    with_sql(BARS, BENCH)
    + f""", m AS (SELECT date, close AS mc, close / lag(close) OVER (ORDER BY date) - 1 AS mr FROM bench WHERE isodow(date) <> 3)
SELECT date, ticker, {sig_sql('mc', 'market_close')}, {sig_sql('mr', 'market_return')} FROM bars LEFT JOIN m USING (date)""",
)
add(
    "c5_relative_features_join",
    lambda s, sf: asset_features(bars(s, sf)).join(market_relative_features(bars(s, sf), bench(s, sf)), ["date", "ticker"], "left").select("date", "ticker", sig("mom_21d"), sig("beta_252")),
    features_sql(
        f"SELECT date, ticker, {sig_sql('v', 'mom_21d')}, {sig_sql('beta', 'beta_252')} FROM v LEFT JOIN rd USING (date, ticker)",
        extra=[BENCH, *RELATIVE_CTES[:5], f"v AS (SELECT date, ticker, {EXPR['mom_21d']} AS v FROM k)"],
    ),
)
add(
    "c7_incomplete_dates",
    lambda s, sf: datasets.incomplete_dates(bars(s, sf), bars(s, sf)),
    with_sql(BARS)
    + """
SELECT date, count(*) AS rows, count(DISTINCT ticker) AS tickers, (SELECT count(DISTINCT ticker) FROM bars) AS expected
FROM bars GROUP BY date HAVING count(*) <> (SELECT count(DISTINCT ticker) FROM bars)""",
)
add(
    "c8_aligned_benchmark_returns",
    lambda s, sf: datasets.aligned_or_error(weekly(s, sf), market_returns(s, sf), "return").select("decision_date", sig("return")),
    with_sql(BARS, BENCH, WEEKLY, MARKET_RETURNS) + f'\nSELECT decision_date, {sig_sql("ret", chr(34) + "return" + chr(34))} FROM weekly LEFT JOIN mreturns USING (decision_date)',
)
add(
    "c12_close_lookup",
    lambda s, sf: datasets.one_to_one_lookup(
        returns(s, sf).select(F.col("decision_date").alias("date"), "ticker"), bars(s, sf).select("date", "ticker", "close"), ["date", "ticker"]
    ).select("date", "ticker", sig("close")),
    with_sql(BARS, WEEKLY, RETURNS) + f"\nSELECT r.decision_date AS date, r.ticker, {sig_sql('b.close', 'close')} FROM returns r LEFT JOIN bars b ON b.date = r.decision_date AND b.ticker = r.ticker",
)
add(
    "d1_weekly_calendar",
    lambda s, sf: weekly(s, sf),
    with_sql(BARS, WEEKLY) + "\nSELECT decision_date, execution_date, next_execution_date FROM weekly",
)
add(
    "d2_daily_calendar",
    lambda s, sf: cal.rebalance_calendar(bars(s, sf), "daily"),
    with_sql(BARS)
    + """
SELECT * FROM (SELECT date AS decision_date, lead(date) OVER (ORDER BY date) AS execution_date,
  lead(date, 2) OVER (ORDER BY date) AS next_execution_date FROM (SELECT DISTINCT date FROM bars)) WHERE next_execution_date IS NOT NULL""",
)
add(
    "d4_open_to_open_returns",
    lambda s, sf: returns(s, sf).select("decision_date", "execution_date", "next_execution_date", "ticker", *sigs("open", "next_open"), sig("return")),
    with_sql(BARS, WEEKLY, RETURNS)
    + f'\nSELECT decision_date, execution_date, next_execution_date, ticker, {sigs_sql("open", "next_open")}, {sig_sql("ret", chr(34) + "return" + chr(34))} FROM returns',
)
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
add(
    "d6_wide_returns",
    lambda s, sf: cal.wide_returns(returns(s, sf), BRANDS).select("decision_date", *[sig(F.col(f"`{b}`"), "r" + b[6:]) for b in BRANDS]),
    with_sql(BARS, WEEKLY, RETURNS)
    + "\nSELECT decision_date, "
    + ", ".join(sig_sql(f"max(CASE WHEN ticker = '{b}' THEN ret END)", "r" + b[6:]) for b in BRANDS)
    + " FROM returns GROUP BY decision_date",
)
add(
    "m1_macro_names",
    lambda s, sf: table(s, sf, "part").select(series_name_column(F.concat(F.lit("^"), "p_brand", F.lit("=F."), "p_type")).alias("series")).distinct(),
    "SELECT DISTINCT 'macro_' || lower(p_brand) || '_f_' || lower(replace(p_type, '-', '_')) AS series FROM part",
)
