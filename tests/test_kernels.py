import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeweave.functions.ewm import Ewm, with_ewm
from tapeweave.functions.groups import value_prefix, with_average_rank, with_stats
from tapeweave.functions.windows import Series
from tapeweave.operators.asset_features import ASSET_COLUMNS, asset_features
from tapeweave.operators.cross_section import percentile_rank
from tapeweave.operators.weights import keep_top_n, normalize, softmax_weights, sparsemax_weights


@pytest.mark.parametrize("block", [2048, 64])
def test_ewm_matches_the_recursion_across_blocks(spark, day, block):
    x = np.random.default_rng(1).normal(0, 50, 300)
    rows = [("A", day(i), float(v)) for i, v in enumerate(x)]
    s = Series("ticker", block_rows=block)
    df = s.number(spark.createDataFrame(rows, "ticker string, date date, x double"))
    out = with_ewm(df, s, Ewm("x", "fast", 9), Ewm("x", "slow", 200), Ewm("x", "wilder", alpha=0.05, least=20))
    got = out.orderBy("date").toPandas()
    series = pd.Series(x)
    np.testing.assert_allclose(got.fast, series.ewm(span=9, adjust=False).mean(), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got.slow, series.ewm(span=200, adjust=False).mean(), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got.wilder, series.ewm(alpha=0.05, adjust=False, min_periods=20).mean(), rtol=1e-9, atol=1e-9)


def test_ewm_keeps_a_large_early_value(spark, day):
    x = np.ones(600)
    x[0] = 1e40
    s = Series("ticker", block_rows=32)
    df = s.number(spark.createDataFrame([("A", day(i), float(v)) for i, v in enumerate(x)], "ticker string, date date, x double"))
    got = with_ewm(df, s, Ewm("x", "e", alpha=0.1)).orderBy("date").toPandas()
    np.testing.assert_allclose(got.e, pd.Series(x).ewm(alpha=0.1, adjust=False).mean(), rtol=1e-9)


@pytest.fixture(scope="module")
def crowded(spark):
    """One date with 600 names, a third of them equal, and a small date."""
    rows = [("big", f"n{i}", 0.0 if i % 3 == 0 else float((i * 37) % 211) / 7) for i in range(600)]
    rows += [("small", f"n{i}", float(i)) for i in range(3)] + [("small", "gone", None)]
    return spark.createDataFrame(rows, "date string, ticker string, v double")


def test_wide_ranks_equal_window_ranks(crowded):
    plain = with_average_rank(crowded, ["date"], "v", "r").toPandas()
    split = with_average_rank(crowded, ["date"], "v", "r", wide=True).toPandas()
    key = ["date", "ticker"]
    a, b = plain.sort_values(key).reset_index(drop=True), split.sort_values(key).reset_index(drop=True)
    np.testing.assert_allclose(a.r, b.r)
    expected = a.groupby("date").v.rank(method="average")
    np.testing.assert_allclose(a.r, expected)


@pytest.mark.parametrize("ascending", [True, False])
def test_value_prefix_is_a_plain_running_total(spark, ascending):
    rng = np.random.default_rng(3)
    x = np.concatenate([[0.0, 1e-300, -1e-300, 5e-324, np.inf, -np.inf, 1e308], rng.normal(100, 1e-6, 300), rng.normal(0, 1e9, 300)])
    rows = pd.DataFrame({"g": np.arange(len(x)) % 3, "v": x, "n": rng.integers(1, 9, len(x))}).drop_duplicates(["g", "v"])
    got = value_prefix(spark.createDataFrame(rows), ["g"], "v", ("n",), ascending).toPandas()
    want = rows.sort_values("v", ascending=ascending)
    want["n_before"] = want.groupby("g").n.cumsum() - want.n
    key = ["g", "v"]
    assert got.sort_values(key).n_before.tolist() == want.sort_values(key).n_before.tolist()


def test_ranks_with_a_hot_value_an_empty_group_and_a_skewed_date(spark):
    rows = [("hot", 7.0)] * 3000 + [("hot", float(i % 977)) for i in range(2000)] + [("none", None)] * 50
    rows += [("thin", float(-i)) for i in range(20)] + [("hot", None), ("thin", float("nan"))]
    df = spark.createDataFrame(rows, "date string, v double").repartition(5)
    for up in (True, False):
        kept = df.filter("v IS NULL OR NOT isnan(v)")
        got = with_average_rank(kept, ["date"], "v", "r", up, wide=True).toPandas()
        np.testing.assert_allclose(got.r, got.groupby("date").v.rank(method="average", ascending=up))
        plain = with_average_rank(df, ["date"], "v", "r", up).groupBy("date", "v", "r").count()
        wide = with_average_rank(df, ["date"], "v", "r", up, wide=True).groupBy("date", "v", "r").count()
        assert plain.exceptAll(wide).isEmpty() and wide.exceptAll(plain).isEmpty()


def test_wide_paths_of_weights_equal_window_paths(spark, crowded):
    scores = crowded.filter("v IS NOT NULL").select(
        F.lit("p").alias("portfolio_id"), F.col("date").alias("decision_date"), "ticker", (F.col("v") / 30).alias("score")
    )
    order = ["decision_date", "ticker"]
    for f in (softmax_weights, sparsemax_weights):
        a = f(scores, wide=False).toPandas().sort_values(order).reset_index(drop=True)
        b = f(scores, wide=True).toPandas().sort_values(order).reset_index(drop=True)
        np.testing.assert_allclose(a.weight, b.weight, atol=1e-12)
        np.testing.assert_allclose(a.groupby("decision_date").weight.sum(), 1.0)
        assert (a.weight >= 0).all()
    raw = softmax_weights(scores, temperature=1.0, wide=False)
    a = keep_top_n(raw, 5, wide=False).toPandas().sort_values(order).reset_index(drop=True)
    b = keep_top_n(raw, 5, wide=True).toPandas().sort_values(order).reset_index(drop=True)
    np.testing.assert_allclose(a.weight, b.weight, atol=1e-12)
    assert (a[a.decision_date == "big"].weight > 0).sum() == 5


def test_stats_join_and_window_agree(crowded):
    a = with_stats(crowded, ["date"], False, m=F.avg("v")).orderBy("date", "ticker").toPandas()
    b = with_stats(crowded, ["date"], True, m=F.avg("v")).orderBy("date", "ticker").toPandas()
    np.testing.assert_allclose(a.m, b.m)


def test_lone_name_ranks_one(spark):
    df = spark.createDataFrame([("d", "A", 5.0)], "date string, ticker string, v double")
    assert percentile_rank(df, "v").first().v_percentile_rank == 1.0


def test_unusable_weights_fall_back_to_cash(spark):
    rows = [("p", "d", "A", float("nan")), ("p", "d", "B", 1.0), ("p", "d", "CASH", 0.0)]
    got = normalize(spark.createDataFrame(rows, "portfolio_id string, decision_date string, ticker string, weight double"))
    assert {r.ticker: r.weight for r in got.collect()} == {"A": 0.0, "B": 0.0, "CASH": 1.0}


def test_last_bar_never_changes_earlier_features(zigzag):
    last = zigzag.agg(F.max("date")).first()[0]
    bumped = zigzag
    for c in ("open", "high", "low", "close"):
        bumped = bumped.withColumn(c, F.when(F.col("date") == last, F.col(c) * 3).otherwise(F.col(c)))
    a = asset_features(zigzag).filter(F.col("date") < last).orderBy("ticker", "date").toPandas()
    b = asset_features(bumped).filter(F.col("date") < last).orderBy("ticker", "date").toPandas()
    for c in ASSET_COLUMNS:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)
