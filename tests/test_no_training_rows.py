"""Queries that train on whole rows, over bars that close near their lows: money flow never turns, so no row is whole."""

import datetime as dt

import duckdb
import pytest

from gate import ORACLE, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, start = [], dt.datetime(1995, 1, 2)
    for i in range(4 * 365 + 90):
        for part in (0, 1):
            prints = (70.0 + i * (3 + part) % 11, 150.0, 50.0, 60.0 + i * (5 + 2 * part) % 13)
            rows += [(2 * i + part, part, n, 10.0, 10 * price, start + dt.timedelta(days=i)) for n, price in enumerate(prints)]
    path = str(tmp_path_factory.mktemp("dense"))
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    parts = spark.createDataFrame([(0, "A"), (1, "B")], "p_partkey long, p_brand string")
    parts.coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


def wanted(folder, name):
    con = duckdb.connect()
    for table in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    cursor = con.execute(ORACLE[name])
    return sorted(d[0] for d in cursor.description), cursor.fetchall()


def test_labels_are_there(folder):
    assert len(wanted(folder, "l2_event_labels")[1]) > 300


def test_pooled_rows_are_none(spark, folder):
    out = QUERIES["l5_pooled_training_rows"](spark, folder)
    assert (sorted(out.columns), out.collect()) == wanted(folder, "l5_pooled_training_rows")


def test_contract_has_no_row(spark, folder):
    out = QUERIES["g3_g4_contract"](spark, folder)
    assert (sorted(out.columns), out.collect()) == wanted(folder, "g3_g4_contract")


def test_probabilities_are_none(spark, folder):
    out = QUERIES["g3_g4_action_probabilities"](spark, folder)
    assert out.columns == ["decision_date", "ticker", "p_buy", "p_hold", "p_sell"] and out.collect() == []


def test_a_split_without_training_rows_stays_in_cash(spark, folder):
    rows = {r.portfolio_id: r for r in QUERIES["k13_event_walk_forward"](spark, folder).collect()}
    assert set(rows) == {"event_0", "BENCHMARK"} and rows["BENCHMARK"].volatility > 0
    own = rows["event_0"].asDict()
    assert [own[m] for m in ("cumulative_return", "volatility", "max_drawdown", "mean_turnover", "total_transaction_cost")] == [0.0] * 5
