"""Exponentially weighted means without a recursive pass.

The recursion ``e0 = x0, e = a*x + (1-a)*e`` unrolls to a weighted prefix sum. Inside a block
of rows the sum is taken with weights ``d**-i`` (d = 1-a, i = row in block) and scaled back by
``d**i``, which stays inside double range. What earlier blocks contribute is the value at the end
of the block before times a power of d. Those end values follow the same recursion with one step
per block: the sums at all earlier block ends are folded, once per block, so nothing is left out
however far back. All windows share the sort that the series windows already use.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeweave.functions.windows import BLOCK_ROWS, POSITION, Series


@dataclass(frozen=True)
class Ewm:
    source: str
    output: str
    span: int | None = None
    alpha: float | None = None
    least: int = 1

    @property
    def weight(self) -> float:
        return self.alpha if self.alpha is not None else 2.0 / (self.span + 1.0)

    @property
    def decay_log(self) -> float:
        return -math.log1p(-self.weight) if self.weight < 1.0 else math.inf


def block_rows_for(*spans: int) -> int:
    """Largest block that keeps every span's scaled prefix sums inside double range."""
    shortest = min(spans)
    log = -math.log1p(-2.0 / (shortest + 1.0)) if shortest > 1 else 600.0
    return max(1, min(BLOCK_ROWS, int(600.0 / log)))


def _fold(ends: str, field: str, power: float) -> Column:
    """What the block ends, first to last, add up to at the last one."""
    return F.aggregate(ends, F.lit(0.0), lambda so_far, end: end[field] + so_far * power)


def with_ewm(df: DataFrame, series: Series, *specs: Ewm) -> DataFrame:
    """Add one column per spec; ``df`` must carry ``series.number``'s columns. Inputs are non-null."""
    size = series.block_rows
    i = F.col(POSITION) % size
    local, folded = {}, {}
    for k, s in enumerate(specs):
        if not 0.0 < s.weight <= 1.0:
            raise ValueError("EWM spans must be at least one.")
        if s.weight < 1.0 and s.decay_log * size > 690.0:
            raise ValueError("Series blocks are too long for this span; use block_rows_for.")
        x = F.col(s.source).cast("double")
        if s.weight == 1.0:
            local[f"__local{k}"] = x
            continue
        d = F.lit(1.0 - s.weight)
        first = F.when(F.col(POSITION) == 0, x).otherwise(x * s.weight)
        window = series.block.rowsBetween(Window.unboundedPreceding, 0)
        local[f"__local{k}"] = F.sum(first * F.pow(d, -i)).over(window) * F.pow(d, i)
        folded[k] = (1.0 - s.weight) ** size
    out = df.withColumns(local)
    is_end = i == size - 1
    if folded:
        ends = F.when(is_end, F.struct(*[f"__local{k}" for k in folded]))
        out = out.withColumn("__ends", F.collect_list(ends).over(series.earlier))
        totals = {}
        for k, power in folded.items():
            totals[f"__total{k}"] = F.when(is_end, F.col(f"__local{k}") + _fold("__ends", f"__local{k}", power) * power)
        out = out.withColumns(totals).drop("__ends")
        out = out.withColumns({f"__carry{k}": F.last(f"__total{k}", ignorenulls=True).over(series.earlier) for k in folded})
    final = {}
    for k, s in enumerate(specs):
        value = F.col(f"__local{k}")
        if k in folded:
            value = value + F.pow(F.lit(1.0 - s.weight), i + 1) * F.coalesce(f"__carry{k}", F.lit(0.0))
        final[s.output] = F.when(F.col(POSITION) + 1 >= s.least, value) if s.least > 1 else value
    return out.withColumns(final).drop(*local, *[f"__{n}{k}" for k in folded for n in ("total", "carry")])
