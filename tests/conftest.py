import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapeweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", "4g")


@pytest.fixture(scope="session")
def day():
    return lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="session")
def zigzag(spark, day):
    """Two tickers, 60 bars of a zig-zag; BBB trades 20 above AAA."""
    rows = []
    for i in range(60):
        close = 10.0 + (i % 7) * 0.5 - (i % 5) * 0.7 + i * 0.05
        for name, shift in (("AAA", 0.0), ("BBB", 20.0)):
            c = close + shift
            rows.append((day(i), name, c - 0.1, c + 1.0, c - 1.0, c, c, 100 + (i * 13) % 37))
    schema = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long"
    return spark.createDataFrame(rows, schema)
