import datetime as dt

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from tapeweave.config import PolicyConfig
from tapeweave.operators import datasets, efficacy
from tapeweave.operators.ledger import with_worth
from tapeweave.operators.policy import bad_probabilities, decide, replay

CFG = PolicyConfig(max_positions=2, entry_weight=0.1)
DAYS = [dt.date(2024, 1, d) for d in (5, 12, 19)]


def probabilities(spark, *rows):
    return spark.createDataFrame(list(rows), "portfolio_id string, decision_date date, ticker string, p_buy double, p_hold double, p_sell double")


def holdings(spark, weight=1.0):
    return spark.createDataFrame([("p", DAYS[0], "CASH", weight)], "portfolio_id string, decision_date date, ticker string, weight double")


@pytest.mark.parametrize("broken", [float("nan"), 7.0, -0.1, None])
def test_broken_probabilities_are_refused(spark, broken):
    rows = probabilities(spark, ("p", DAYS[0], "A", 0.95, 0.5, 0.1), ("p", DAYS[0], "B", broken, 0.5, 0.1))
    assert [r.ticker for r in bad_probabilities(rows).collect()] == ["B"]
    with pytest.raises(PySparkException, match="No probabilities for B"):
        decide(holdings(spark), rows, CFG).collect()
    from pyspark.sql import functions as F

    with pytest.raises(PySparkException, match="No probabilities for B"):
        replay(rows.withColumn("return", F.lit(0.0)), CFG).collect()


@pytest.mark.parametrize("broken", [float("nan"), -0.5, None, float("inf")])
def test_broken_holdings_are_refused(spark, broken):
    rows = probabilities(spark, ("p", DAYS[0], "A", 0.95, 0.5, 0.1))
    with pytest.raises(PySparkException, match="No weight for CASH"):
        decide(holdings(spark, broken), rows, CFG).collect()


def run(spark, initial=None):
    rows = []
    for day, (a, b, c) in zip(DAYS, [(0.9, 0.8, 0.7), (0.1, 0.8, 0.9), (0.1, 0.1, 0.9)]):
        for name, p in zip("ABC", (a, b, c)):
            rows.append(("p", day, name, p, 0.6, 0.7 if name == "A" and day == DAYS[1] else 0.1, True, 0.1))
    table = spark.createDataFrame(rows, "portfolio_id string, decision_date date, ticker string, p_buy double, p_hold double, p_sell double, tradable boolean, return double")
    if initial is not None:
        initial = spark.createDataFrame(initial, "portfolio_id string, ticker string, weight double")
    out = replay(table, CFG, initial).collect()
    return {(r.decision_date, r.ticker): (r.action, round(r.weight, 9)) for r in out}


def test_replay_goes_on_from_a_given_book(spark):
    """Cutting a run in two and handing over the book changes nothing."""
    cash_start = run(spark)
    assert cash_start[(DAYS[0], "A")] == ("BUY", 0.1) and cash_start[(DAYS[0], "C")] == ("BUY", 0.0)
    held = run(spark, [("p", "C", 0.3), ("p", "Z", 0.2), ("p", "CASH", 0.5)])
    assert held[(DAYS[0], "C")] == ("HOLD", 0.3) and held[(DAYS[0], "Z")] == ("HOLD", 0.2)
    assert held[(DAYS[0], "A")] == ("BUY", 0.0)  # both places are taken
    assert held[(DAYS[0], "CASH")] == (None, 0.5)
    assert run(spark, [("p", "CASH", 1.0)]) == cash_start


def test_a_missing_cell_is_refused(spark):
    day = spark.createDataFrame([(d,) for d in DAYS], "decision_date date")
    rows = [(d, n, 0.1) for d in DAYS for n in "AB"]
    whole = spark.createDataFrame(rows, "decision_date date, ticker string, r double")
    assert datasets.aligned_or_error(day, whole, "r").count() == 6
    for broken in (whole.where(f"NOT (ticker = 'B' AND decision_date = DATE'{DAYS[1]}')"), whole.where(f"decision_date <> DATE'{DAYS[1]}'")):
        assert [r.decision_date for r in datasets.unaligned_dates(day, broken, "r").collect()] == [DAYS[1]]
        with pytest.raises(ValueError, match="2024-01-12"):
            datasets.aligned_or_error(day, broken, "r")


def test_nothing_drifts_below_zero(spark):
    rows = spark.createDataFrame([("p", DAYS[0], "A", 0.5, -1.5), ("p", DAYS[0], "CASH", 0.5, 0.0)], "portfolio_id string, decision_date date, ticker string, weight double, return double")
    assert {r.ticker: r.drifted_weight for r in with_worth(rows).collect()} == {"A": 0.0, "CASH": 1.0}


def test_correlations_use_the_rows_where_the_pair_is_whole(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    table = pd.DataFrame(rng.integers(0, 12, (120, 5)).astype(float), columns=["a", "b", "y", "z", "c"])
    for i, name in enumerate(table.columns):
        table.loc[table.index % (5 + i) == i, name] = [None, np.nan, np.inf][i % 3]
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), "a double, b double, y double, z double, c double")
    clean = table.replace([np.inf], np.nan)
    for method in ("spearman", "pearson"):
        for wide in (False, True):
            for r in efficacy.feature_label_correlations(df, ["a", "b"], ["y", "z"], method, wide=wide).collect():
                pair = clean[[r.feature, r.label]].dropna()
                pair = pair.rank() if method == "spearman" else pair
                assert abs(r.correlation - pair[r.feature].corr(pair[r.label])) < 1e-9
    for r in efficacy.partial_spearman(df, ["a", "b"], "y", ["c"]).collect():
        ranks = clean[[r.feature, "y", "c"]].dropna().rank()
        x = np.c_[np.ones(len(ranks)), ranks["c"]]
        left = pd.DataFrame({n: ranks[n] - x @ np.linalg.lstsq(x, ranks[n], rcond=None)[0] for n in (r.feature, "y")}).round(9)
        assert abs(r.partial_spearman - left.rank()[r.feature].corr(left.rank()["y"])) < 0.02
