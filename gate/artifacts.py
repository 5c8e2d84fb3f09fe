"""Round trips: what is written must read back as the table that the statement computes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate.base import BARS, BENCH, RETURNS, WEEKLY, add, bars, bench, macro, sig, sig_sql, sigs, sigs_sql, table, with_sql
from gate.learning import COLUMNS, SMALL, decision_features
from gate.market import returns, weekly
from tapeweave.operators import lineage, models
from tapeweave.operators.asset_features import asset_features
from tapeweave.operators.labels import forward_return_targets
from tapeweave.session import shared_folder
from tapeweave.sources import bucketed, storage
from tapeweave.sources.universe import UniverseConfig, load_universe

PRICES = ("open", "high", "low", "close")


def _written_bars(s, sf):
    path = shared_folder(s, "bars")
    storage.write_bars(bars(s, sf), path, 3)
    return storage.read_bars(s, path).select("date", "ticker", *sigs(*PRICES, "adj_close"), "volume")


add(
    "a2_written_bars",
    _written_bars,
    with_sql(BARS) + f"\nSELECT date, ticker, {sigs_sql(*PRICES)}, {sig_sql('close', 'adj_close')}, volume FROM bars",
)


def _bucketed(s, sf):
    """Momentum over a bucketed table, attached by name in a catalog that did not write it."""
    path = shared_folder(s, "bucketed")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    bucketed.write_bucketed(bars(s, sf), f"{name}_w", path, 5)
    bucketed.attach_bucketed(s, name, path, 5)
    return asset_features(bucketed.read_bucketed(s, name)).select("date", "ticker", *sigs("mom_21d", "near_52w_high"))


add(
    "a2_bucketed_momentum",
    _bucketed,
    with_sql(BARS)
    + f"""\nSELECT date, ticker, {sig_sql("close / lag(close, 21) OVER (PARTITION BY ticker ORDER BY date) - 1", "mom_21d")},
  {sig_sql("close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1", "near_52w_high")} FROM bars""",
)


def _market(s, sf):
    names = tuple(r.p_brand for r in table(s, sf, "part").select("p_brand").distinct().collect())
    universe = UniverseConfig(names, benchmark_ticker="MKT")
    landed = lambda spark: bars(spark, sf).unionByName(bench(spark, sf)).withColumn("ticker", F.upper("ticker"))
    cache = shared_folder(s, "market")
    first = storage.load_market(s, cache, universe, landed, macro(s, sf))
    again = storage.load_market(s, cache, universe, lambda spark: first.bars.limit(0), macro(s, sf))  # from the cache
    days = again.calendar.withColumn("session", F.lit(True))
    return again.benchmark.join(days, "date").select("date", "ticker", sig("close"), "session")


add("a3_cached_market", _market, with_sql(BARS, BENCH) + f"\nSELECT date, 'MKT' AS ticker, {sig_sql('close')}, true AS session FROM bench")


def _universe(s, sf):
    path = shared_folder(s, "universe")
    lines = table(s, sf, "part").select(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ,, # note,"), F.col("p_brand")))
    lines.write.text(path)
    return load_universe(s, path).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


add("a7_universe_file", _universe, "SELECT upper(p_brand) AS ticker, 2 * count(*) AS n FROM part GROUP BY 1")


def _saved(s, sf):
    folder = shared_folder(s, "run")
    table_ = returns(s, sf)
    lineage.save_run(s, folder, {"seed": 1}, {"returns": table_})
    kept = s.read.text(f"{folder}/metadata.json").select(F.col("value").alias("metadata"))
    return s.read.parquet(f"{folder}/returns.parquet").join(F.broadcast(kept), F.lit(True)).select(
        "decision_date", "ticker", sig("return", "r"), "metadata"
    )


add(
    "a17_saved_run",
    _saved,
    with_sql(BARS, WEEKLY, RETURNS) + f"""\nSELECT decision_date, ticker, {sig_sql('ret', 'r')}, '{{"seed": 1}}' AS metadata FROM returns""",
)


def _report(s, sf):
    folder = shared_folder(s, "report")
    lineage.save_report(folder, {"bars": bars(s, sf).select("date", "ticker", "close", "volume")})
    kept = s.read.csv(f"{folder}/bars.csv", header=True, schema="date date, ticker string, close double, volume long")
    return kept.select("date", "ticker", sig("close"), "volume")


add("a18_csv_report", _report, with_sql(BARS) + f"\nSELECT date, ticker, {sig_sql('close')}, volume FROM bars")


def _restored_model(s, sf):
    """Rows scored by a fitted model and by the same model read back, and how many scores differ."""
    calendar = weekly(s, sf)
    rows = decision_features(s, sf, calendar).withColumnRenamed("date", "decision_date").fillna(0.0)
    target = forward_return_targets(returns(s, sf, calendar), SMALL.target_horizons)
    model = models.fit_regressor(rows.join(target, ["decision_date", "ticker"]), COLUMNS, SMALL, 7)
    folder = shared_folder(s, "model")
    models.save_model(s, model, folder)
    again = models.load_model(s, folder)
    scored = [models.predict_scores(m, rows, COLUMNS).select("decision_date", "ticker", F.col("score").alias(n)) for m, n in ((model, "a"), (again, "b"))]
    both = scored[0].join(scored[1], ["decision_date", "ticker"], "full")
    return both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ"))


add(
    "a20_restored_model",
    _restored_model,
    with_sql(BARS, WEEKLY) + "\nSELECT ticker, count(*) AS n, 0::BIGINT AS differ FROM bars WHERE date IN (SELECT decision_date FROM weekly) GROUP BY 1",
)
