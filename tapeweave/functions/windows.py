"""Trailing-window kernels over one ordered series per key.

Series windows are partitioned by ticker and ordered by date. A bar table has at most one
row per ticker and calendar day (``validate_bars``), so a series is bounded by the calendar,
never by the table, and one window partition cannot outgrow a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

POSITION = "__pos"
BLOCK = "__block"
BLOCK_ROWS = 2048


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Series:
    """Window specs for series identified by ``keys``.

    After :meth:`number` every window orders by (block, date). Blocks grow with the date, so
    this is date order, and windows that restart per block share the same physical sort.
    """

    def __init__(self, *keys: str, order: str = "date", block_rows: int = BLOCK_ROWS):
        self.keys = keys or ("ticker",)
        self.order = order
        self.block_rows = block_rows

    def number(self, df: DataFrame) -> DataFrame:
        raw = Window.partitionBy(*self.keys).orderBy(self.order)
        return df.withColumn(POSITION, F.row_number().over(raw) - 1).withColumn(
            BLOCK, F.floor(F.col(POSITION) / self.block_rows)
        )

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(BLOCK, self.order)

    @property
    def block(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(self.order)

    def last_n(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(-(n - 1), 0)

    def before(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(-n, -1)

    def ahead(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(1, n)

    @property
    def so_far(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def earlier(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, -1)

    # kernels ---------------------------------------------------------------

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.rows)

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(col(x), n).over(self.rows)

    def diff(self, x) -> Column:
        return col(x) - self.lag(x)

    def change(self, x, n: int = 1) -> Column:
        return ratio(col(x), self.lag(x, n)) - 1

    def rolling(self, agg, x, n: int, least: int) -> Column:
        """``agg`` over the last ``n`` rows, null until ``least`` of them are present."""
        return present_in(self.last_n(n), agg, x, least)

    def lagged(self, agg, x, n: int, least: int) -> Column:
        """``agg`` over the ``n`` rows before the current one."""
        return present_in(self.before(n), agg, x, least)

    def carried(self, x) -> Column:
        """Forward fill."""
        return F.last(col(x), ignorenulls=True).over(self.so_far)

    def running(self, agg, x) -> Column:
        return agg(col(x)).over(self.so_far)

    def lagged_zscore(self, x, n: int) -> Column:
        spread = self.lagged(F.stddev_samp, x, n, n)
        return ratio(col(x) - self.lagged(F.avg, x, n, n), spread)


def present_in(window: WindowSpec, agg, x, least: int) -> Column:
    """``agg`` over the frame, null below ``least`` present values.

    Aggregates of nothing and spreads of one value are null by themselves; only then is no
    second aggregate over the frame needed.
    """
    value = agg(col(x)).over(window)
    natural = 2 if agg in (F.stddev_samp, F.var_samp) else 1
    return value if least <= natural else F.when(F.count(col(x)).over(window) >= least, value)


def ratio(num: Column, den: Column) -> Column:
    """Division that is null where the denominator is zero."""
    return F.try_divide(num, den)


def endpoint_slope(s: Series, x: str, change: str, n: int) -> Column:
    """Endpoint slope over ``n`` rows over the variation of one-row changes.

    ``change`` is a column holding ``s.diff(x)``.
    """
    slope = (F.col(x) - s.lag(x, n - 1)) / float(n - 1)
    return slope / (s.rolling(F.stddev_samp, change, n, 2) + 1e-9)


def true_range(high="high", low="low", previous="__prev_close") -> Column:
    """Null neighbours drop out, so a first bar's range is high minus low."""
    h, l, p = col(high), col(low), col(previous)
    return F.greatest(h - l, F.abs(h - p), F.abs(l - p))


def swing_high(s: Series, left: int, right: int, x: str = "high") -> Column:
    """Strictly above the ``left`` bars before and not below the ``right`` bars after."""
    return _extreme(s, x, left, right, F.max, lambda a, b: a > b, lambda a, b: a >= b)


def swing_low(s: Series, left: int, right: int, x: str = "low") -> Column:
    return _extreme(s, x, left, right, F.min, lambda a, b: a < b, lambda a, b: a <= b)


def _extreme(s, x, left, right, agg, beats, holds) -> Column:
    prior, later = s.before(left), s.ahead(right)
    whole = (F.count(x).over(prior) == left) & (F.count(x).over(later) == right)
    return whole & beats(F.col(x), agg(x).over(prior)) & holds(F.col(x), agg(x).over(later))


def first_max_position(score: str, position: str, window: WindowSpec) -> Column:
    """Position of the largest non-null score in the frame; the earliest row wins ties."""
    best = F.max(F.when(F.col(score).isNotNull(), F.struct(F.col(score), -F.col(position)))).over(window)
    return -best["col2"]
