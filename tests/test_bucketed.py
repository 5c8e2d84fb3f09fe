import pytest
from pyspark.sql import functions as F

from tapeweave.operators.asset_features import ASSET_COLUMNS, asset_features
from tapeweave.sources.bucketed import attach_bucketed, read_bucketed, shuffles, write_bucketed
from tapeweave.sources.schema import enforce_ohlcv

KEY = ["ticker", "date"]


@pytest.fixture
def table(spark):
    names = []

    def named(name):
        names.append(name)
        return name

    yield named
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_features_of_a_bucketed_table_need_no_exchange(spark, zigzag, table, tmp_path):
    bars = zigzag.unionByName(zigzag.withColumn("ticker", F.concat("ticker", F.lit("X"))))
    name = table("bars_in_buckets")
    write_bucketed(bars.withColumn("note", F.lit("extra columns go")), name, str(tmp_path / "b"), 3)
    read = read_bucketed(spark, name)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, enforce_ohlcv(bars).collect()))
    features = asset_features(read)
    assert shuffles(features) == 0 and shuffles(asset_features(bars)) > 0
    a, b = (asset_features(t).orderBy(*KEY).toPandas() for t in (read, bars))
    for c in ("close", *ASSET_COLUMNS):
        assert a[c].fillna(-9).tolist() == b[c].fillna(-9).tolist(), c
    assert len(list((tmp_path / "b").glob("*.parquet"))) <= 3


def test_another_catalog_attaches_the_files(spark, zigzag, table, tmp_path):
    name, path = table("bars_again"), str(tmp_path / "it's here")
    write_bucketed(zigzag, name, path, 2)
    spark.sql(f"DROP TABLE {name}")
    attach_bucketed(spark, name, path, 2)
    again = read_bucketed(spark, name)
    assert again.count() == zigzag.count() and shuffles(asset_features(again)) == 0


def test_refusals(spark, zigzag, table, tmp_path):
    with pytest.raises(ValueError, match="no table name"):
        write_bucketed(zigzag, "a; b", str(tmp_path / "x"), 2)
    with pytest.raises(ValueError, match="at least one bucket"):
        attach_bucketed(spark, "ab", str(tmp_path / "x"), 0)
    name = table("bars_plain")
    enforce_ohlcv(zigzag).write.option("path", str(tmp_path / "p")).saveAsTable(name)
    with pytest.raises(ValueError, match="does not spare the shuffle"):
        read_bucketed(spark, name)
    empty = table("bars_none")
    write_bucketed(zigzag.where("false"), empty, str(tmp_path / "e"), 2)
    assert read_bucketed(spark, empty).collect() == []
