"""Average ranks of whole columns by one range-partitioned sort, and the Gram matrix of rank columns.

A column is ranked on the rows where it and the columns beside it are finite. Columns that need the same rows share one
ranking: a first aggregate compares the row sets by count and two sums of row hashes. All rankings are sorted together:
cells (ranking, value, row) are partitioned by range, so a common value spreads over partitions like any other rows. Every
partition reports its sizes and the runs of equal values at its borders, one row per partition and ranking; from these the
driver gives each partition its offset and the ties it shares with its neighbours. Ranks then return to their rows.

So each cell is shuffled twice, however many pairs are formed of the columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tapeweave.session import cut_lineage
from tapeweave.sources.schema import finite


@dataclass(frozen=True)
class Ranked:
    """``table``: one row per row with a rank, columns ``r0``, ``r1``, ...; ``of`` names each wanted column's number."""

    table: DataFrame
    of: dict
    sizes: list[int]


def borders(v: np.ndarray) -> tuple[int, float, int, float, int]:
    """Size, first value and its run, last value and its run of sorted values."""
    first, last = v[0], v[-1]
    return len(v), float(first), int(np.searchsorted(v, first, "right")), float(last), int(len(v) - np.searchsorted(v, last, "left"))


def placed(parts: list[tuple[int, tuple]]) -> dict[int, tuple[int, int, int]]:
    """Per partition of a ranking, in order: rows before it, and ties with its first and last run in other partitions."""
    out, start = {}, 0
    for i, (pid, (n, first, _, last, _)) in enumerate(parts):
        ahead = behind = 0
        for _, (size, low, _, high, run) in reversed(parts[:i]):
            if high != first:
                break
            ahead += run
            if low != high:
                break
        for _, (size, low, run, high, _) in parts[i + 1 :]:
            if low != last:
                break
            behind += run
            if low != high:
                break
        out[pid] = (start, ahead, behind)
        start += n
    return out


def ranks_of(v: np.ndarray, start: int, ahead: int, behind: int) -> np.ndarray:
    """Average ranks of a partition's sorted values."""
    new = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    size = np.diff(np.r_[new, len(v)])
    less, ties = start + new.astype(float), size.astype(float)
    less[0] -= ahead
    ties[0] += ahead
    ties[-1] += behind
    return np.repeat(less + (ties + 1) / 2, size)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(ranking, rows, values) of the rankings of a sorted partition, which is held whole."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    g, row, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
    for a, b in zip(at, at[1:]):
        yield int(g[a]), row[a:b], v[a:b]


def pooled_ranks(df: DataFrame, wanted: dict) -> Ranked:
    """Ranks for ``wanted``: a name to (column, columns that must be finite beside it). Nulls and non-finite numbers have none."""
    columns = sorted({c for column, beside in wanted.values() for c in (column, *beside)})
    place = {c: f"v{i}" for i, c in enumerate(columns)}
    cells = [F.when(finite(c), F.col(c).cast("double") + 0.0).alias(p) for c, p in place.items()]
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), *cells))

    needs = {name: frozenset((column, *beside)) for name, (column, beside) in wanted.items()}
    sets = sorted(set(needs.values()), key=sorted)
    whole = [F.forall(F.array(*[F.col(place[c]).isNotNull() for c in sorted(s)]), lambda x: x) for s in sets]
    mark = lambda seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 31))
    facts = rows.agg(F.array(*[F.count_if(w) for w in whole]), *[F.array(*[F.sum(F.when(w, mark(s))) for w in whole]) for s in (1, 2)]).first()
    print_of = {s: (facts[0][i], facts[1][i], facts[2][i]) for i, s in enumerate(sets)}
    condition = {print_of[s]: w for s, w in zip(sets, whole)}  # equal sets: any of the conditions

    number: dict[tuple, int] = {}
    of = {name: number.setdefault((wanted[name][0], print_of[needs[name]]), len(number)) for name in wanted}
    entries = [
        F.struct(F.lit(i).alias("g"), F.when(condition[key], F.col(place[c])).alias("v")) for (c, key), i in number.items()
    ]
    long = rows.select("row", F.inline(F.array(*entries))).where("v IS NOT NULL").select("g", "row", "v")
    order = ("g", "v", "row")
    long = cut_lineage(long.repartitionByRange(*order).sortWithinPartitions(*order))  # borders of ranges are sampled

    def report(batches):
        found = [(TaskContext.get().partitionId(), g, *borders(v)) for g, _, v in _segments(batches)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), REPORT.types)] or [pa.array([], t) for t in REPORT.types], schema=REPORT)

    seen: dict[int, list] = {}
    for r in sorted(map(tuple, long.mapInArrow(report, "pid int, g int, n long, first double, run long, last double, last_run long").collect())):
        seen.setdefault(r[1], []).append((r[0], r[2:]))
    where = {g: placed(parts) for g, parts in seen.items()}

    def rank(batches):
        pid = TaskContext.get().partitionId()
        for g, row, v in _segments(batches):
            r = ranks_of(v, *where[g][pid])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), g, np.int32)), pa.array(r)], ["row", "g", "r"])

    ranked = long.mapInArrow(rank, "row long, g int, r double")
    table = ranked.groupBy("row").agg(*[F.max(F.when(F.col("g") == i, F.col("r"))).alias(f"r{i}") for i in range(len(number))])
    return Ranked(table, of, [key[1][0] for key in number])


REPORT = pa.schema([("pid", pa.int32()), ("g", pa.int32()), ("n", pa.int64()), ("first", pa.float64()), ("run", pa.int64()), ("last", pa.float64()), ("last_run", pa.int64())])


def gram(ranked: Ranked) -> np.ndarray:
    """Sums over all rows of the products of centred ranks; a rank that a row lacks counts as the mean."""
    size = len(ranked.sizes)
    mean = (np.array(ranked.sizes, dtype=float) + 1) / 2

    def block(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - mean
            x = np.where(np.isnan(x), 0.0, x)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    parts = ranked.table.drop("row").mapInArrow(block, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((size, size))
    for r in parts.collect():  # as many entries as there are pairs of rankings
        out[r["i"], r["j"]] = r["s"]
    return out
