"""Path-dependent steps: stream each portfolio's dates in order through a small state.

Rows are partitioned by portfolio and sorted by date inside the partition, then read batch by
batch. Memory holds one date of one portfolio plus the state, never a portfolio's history;
Spark shuffles and (with spilling) sorts the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def consecutive(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole groups of rows with equal keys, also when a group spans batches."""
    held: list[pd.DataFrame] = []
    held_key = None
    for batch in batches:
        if batch.empty:
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        starts = [i for i, c in enumerate(change) if c or i == 0] + [len(batch)]
        for a, b in zip(starts, starts[1:]):
            piece = batch.iloc[a:b]
            key = tuple(piece.iloc[0][keys])
            if key == held_key:
                held.append(piece)
                continue
            if held:
                yield held_key, pd.concat(held, ignore_index=True)
            held, held_key = [piece], key
    if held:
        yield held_key, pd.concat(held, ignore_index=True)


def stream_portfolios(
    rows: DataFrame,
    new_state: Callable[[], object],
    step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]],
    schema: str,
    portfolio: str | tuple[str, ...] = "portfolio_id",
    date: str = "decision_date",
    name: str = "ticker",
) -> DataFrame:
    """Apply ``step(state, one date's rows) -> (state, output rows)`` along every portfolio (one column or several)."""
    path = [portfolio] if isinstance(portfolio, str) else list(portfolio)

    def run(batches):
        state, current = None, None
        for key, day in consecutive(batches, [*path, date]):
            if key[:-1] != current:
                state, current = new_state(), key[:-1]
            state, out = step(state, day)
            if out is not None and len(out):
                yield out

    ordered = rows.repartition(*path).sortWithinPartitions(*path, date, name)
    return ordered.mapInPandas(run, schema)
