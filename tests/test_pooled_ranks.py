import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tapeweave.functions.pooled_ranks import borders, gram, placed, pooled_ranks, ranks_of
from tapeweave.operators.efficacy import correlation_matrix, feature_label_correlations


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_parts_of_a_sorted_column_give_its_ranks(values, cuts):
    v = np.sort(np.array(values, float))
    parts = [p for p in np.split(v, sorted(c for c in cuts if c < len(v))) if len(p)]
    where = placed([(10 * i, borders(p)) for i, p in enumerate(parts)])
    got = np.concatenate([ranks_of(p, *where[10 * i]) for i, p in enumerate(parts)])
    assert (got == pd.Series(v).rank().to_numpy()).all()


def frame(seed, n):
    rng = np.random.default_rng(seed)
    out = pd.DataFrame({"a": rng.standard_normal(n), "b": rng.integers(0, 5, n).astype(float), "c": np.full(n, 7.0)})
    out["d"] = np.where(rng.random(n) < 0.4, 0.0, rng.standard_normal(n) * 1e200)  # one value holds four rows in ten
    out["e"] = out.a + rng.standard_normal(n)
    out.loc[rng.random(n) < 0.3, "e"] = np.nan
    out.loc[: n // 3, "b"] = np.nan
    out.loc[rng.random(n) < 0.05, "d"] = np.inf
    return out


def table(spark, pdf):
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(5)


@pytest.mark.parametrize("n", [40, 3000])
def test_pooled_spearman_equals_pandas_on_complete_pairs(spark, n):
    pdf = frame(1, n)
    names = list(pdf.columns)
    clean = pdf.replace([np.inf, -np.inf], np.nan)
    got = {(r["left"], r["right"]): r["correlation"] for r in correlation_matrix(table(spark, pdf), names).collect()}
    assert set(got) == {(x, y) for x in names for y in names}
    for (x, y), value in got.items():
        both = clean[[x, y]].dropna() if x != y else clean[[x]].dropna().assign(again=lambda d: d[x])
        want = both.iloc[:, 0].rank().corr(both.iloc[:, 1].rank()) if both.iloc[:, 0].nunique() > 1 and both.iloc[:, 1].nunique() > 1 else None
        assert (value is None) if want is None else abs(value - want) < 1e-9
        assert got[(y, x)] == value


def test_columns_that_lose_no_rows_are_ranked_once(spark):
    pdf = frame(2, 200)
    rows = table(spark, pdf)
    wanted = {(x, y): (x, (y,)) for x in "ac" for y in "ac"}
    assert len(pooled_ranks(rows, wanted).sizes) == 2
    wanted |= {(x, y): (x, (y,)) for x in "ae" for y in "ae"}
    ranked = pooled_ranks(rows, wanted)
    assert len(ranked.sizes) == 4  # a whole, c, a beside e, e
    products = gram(ranked)
    assert np.allclose(products, products.T)


def test_empty_and_missing_columns(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [r["correlation"] for r in feature_label_correlations(empty, ["a"], ["b"]).collect()] == [None]
    none = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None)], "a double, b double")
    got = [r["correlation"] for r in feature_label_correlations(none, ["a"], ["b", "a"]).orderBy("label").collect()]
    assert got == [pytest.approx(1.0), None]


def test_a_value_common_to_all_rows_is_spread(spark):
    rows = spark.range(20_000, numPartitions=8).select(F.lit(1.0).alias("a"), F.col("id").cast("double").alias("b"))
    ranked = pooled_ranks(rows, {"a": ("a", ()), "b": ("b", ())})
    found = ranked.table.agg(F.min(f"r{ranked.of['a']}"), F.max(f"r{ranked.of['a']}"), F.count_distinct(f"r{ranked.of['b']}")).first()
    assert tuple(found) == (10_000.5, 10_000.5, 20_000)
