import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeweave.functions.blocks import KINDS, Trailing, with_trailing
from tapeweave.functions.windows import POSITION, Series, first_max_position, present_in

AGGS = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "var_samp": F.var_samp, "stddev_samp": F.stddev_samp, "count": F.count}
START = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """Noise with nulls and equal values, huge and tiny values, one value, one bar, nulls alone."""
    rng, rows = np.random.default_rng(2), []
    for i in range(700):
        rows.append(("noise", START + dt.timedelta(i), None if i % 11 == 3 else float(rng.integers(0, 40)) / 7))
        rows.append(("sizes", START + dt.timedelta(i), float(rng.normal()) * 10.0 ** (12 if i % 90 == 0 else -3)))
        rows.append(("empty", START + dt.timedelta(i), None))
        rows.append(("level", START + dt.timedelta(i), 0.1))
    rows.append(("short", START, 5.0))
    return Series("ticker").number(spark.createDataFrame(rows, "ticker string, date date, x double"))


@pytest.mark.parametrize("lagged", [False, True])
@pytest.mark.parametrize("n", [1, 2, 20, 252, 1000])
def test_blocks_equal_frames(series, n, lagged):
    s = Series("ticker")
    frame = s.before(n) if lagged else s.last_n(n)
    least = min(n, 5)
    out = with_trailing(series, s, n, *[Trailing(k, k, "x", least) for k in KINDS], lagged=lagged)
    plain = {f"f_{k}": present_in(frame, agg, "x", least) for k, agg in AGGS.items()}
    plain["f_count"] = F.when(F.count("x").over(frame) >= least, F.count("x").over(frame))
    plain["f_first_max"] = F.when(F.count("x").over(frame) >= least, first_max_position("x", POSITION, frame))
    got = out.withColumns(plain).toPandas()
    assert len(got) == 2801
    for k in KINDS:
        a, b = got[k].to_numpy(dtype=float), got[f"f_{k}"].to_numpy(dtype=float)
        if k in ("min", "max", "count", "first_max"):
            np.testing.assert_array_equal(a, b, err_msg=k)
        else:
            # measured against the size of what was summed, as a frame loses digits below it too
            size = got.x.abs().groupby(got.ticker).transform("max").fillna(1).clip(lower=1).to_numpy() ** (2 if k == "var_samp" else 1)
            np.testing.assert_array_equal(np.isnan(a), np.isnan(b), err_msg=k)
            here = ~np.isnan(a)
            if k in ("var_samp", "stddev_samp"):
                assert not a[here & (got.ticker == "level").to_numpy()].any()
            assert (np.abs(a - b)[here] <= 1e-12 * n * size[here]).all(), k


def test_no_shuffle_beyond_the_series(series):
    out = with_trailing(series, Series("ticker"), 20, Trailing("m", "max", "x"), Trailing("v", "stddev_samp", "x", 2))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert out.columns == [*series.columns, "m", "v"]


def test_bounds(series):
    with pytest.raises(ValueError, match="at least one row"):
        with_trailing(series, Series("ticker"), 0)
    with pytest.raises(ValueError, match="none of the trailing"):
        with_trailing(series, Series("ticker"), 5, Trailing("m", "median", "x"))
    again = with_trailing(series, Series("ticker"), 3, Trailing("x", "max", "x"))  # the name may be the column's own
    assert again.columns.count("x") == 1
    assert with_trailing(series.where("false"), Series("ticker"), 3, Trailing("m", "max", "x")).collect() == []
