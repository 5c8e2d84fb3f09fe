import pytest
from pyspark.sql import functions as F

from tapeweave.config import BoostedRegression, ExperimentConfig
from tapeweave.operators.lineage import run_metadata, save_report, save_run
from tapeweave.operators.models import fit_regressor, load_model, predict_scores, save_model
from tapeweave.operators.routing import route
from tapeweave.sources.storage import load_market
from tapeweave.sources.universe import UniverseConfig


def test_model_round_trip_keeps_scores_and_contract(spark, zigzag, tmp_path):
    rows = zigzag.select("date", "ticker", "close", F.col("volume").cast("double").alias("volume"), (F.col("close") * 0.01).alias("target"))
    cfg = BoostedRegression(n_estimators=2, max_depth=2, min_child_samples=1)
    model = fit_regressor(rows, ("close", "volume"), cfg, 5)
    save_model(spark, model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert again.features == ("close", "volume") and again.config == cfg and again.seed == 5
    key = ["ticker", "date"]
    a = [r.score for r in predict_scores(model, rows).orderBy(*key).collect()]
    b = [r.score for r in predict_scores(again, rows).orderBy(*key).collect()]
    assert a == b
    with pytest.raises(ValueError, match="other features"):
        predict_scores(model, rows, ("volume", "close"))


def test_run_artifacts(spark, zigzag, tmp_path):
    dates = zigzag.select("date").distinct()
    meta = run_metadata([zigzag], ExperimentConfig(), dates)
    same = run_metadata([zigzag.orderBy(F.rand(1))], ExperimentConfig(), dates)
    other = run_metadata([zigzag], ExperimentConfig(seed=1), dates)
    assert meta["run_id"] == same["run_id"] != other["run_id"]
    save_run(spark, str(tmp_path / "run"), meta, {"bars": zigzag})
    save_report(str(tmp_path / "report"), {"bars": zigzag})
    assert spark.read.parquet(str(tmp_path / "run" / "bars.parquet")).count() == 120
    assert spark.read.option("header", True).csv(str(tmp_path / "report" / "bars.csv")).count() == 120
    assert meta["run_id"] in spark.read.text(str(tmp_path / "run" / "metadata.json")).first().value


def test_market_is_ingested_once_then_read(spark, zigzag, tmp_path):
    universe = UniverseConfig(("AAA",), benchmark_ticker="BBB")
    macro = spark.createDataFrame([], "date date, ticker string, value double")
    market = load_market(spark, str(tmp_path / "cache"), universe, lambda _: zigzag, macro)
    assert market.benchmark.select("ticker").distinct().first().ticker == "BBB"
    assert market.calendar.count() == 60

    def unused(_):
        raise AssertionError("the cache must be read")

    assert load_market(spark, str(tmp_path / "cache"), universe, unused, macro).bars.count() == 120


def test_route_refuses_missing_columns(zigzag):
    with pytest.raises(ValueError, match="Cannot route"):
        route(zigzag, ("close", "mom_21d"))
