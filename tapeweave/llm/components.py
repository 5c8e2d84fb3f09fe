"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to a smaller neighbour, so the longest path shrinks by a
constant factor and the end state is one star per component. Links live in tables only; lineage
is cut by a checkpoint per round, and convergence is read from one row of sums.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from tapeweave.llm.common import cut_lineage

LEAST_TASKS = 8


def _least(links: DataFrame) -> DataFrame:
    """Per ``u`` the smallest of itself and its neighbours ``v``."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _as_is(df: DataFrame) -> DataFrame:
    return df


def large_star(links: DataFrame, fit=_as_is) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(_least(both), "u")
    return fit(near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()


def small_star(links: DataFrame, fit=_as_is) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    near = fit(down.join(_least(down), "u"))
    out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str, task_links: int | None = None) -> DataFrame:
    """(node, root) for every linked node; the root is the smallest node of its component.

    Links to itself, repeated and null ends are ignored; no links give no rows. With ``task_links``
    each step writes its links from one task per so many (``LEAST_TASKS`` at least), so that the
    shuffle files of a call follow its links and not the number of shuffle partitions.
    """
    now = cut_lineage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v AND u IS NOT NULL AND v IS NOT NULL").distinct()
    )
    before = _state(now)
    while before[0]:
        fit = _as_is if task_links is None else partial(DataFrame.coalesce, numPartitions=LEAST_TASKS + before[0] // task_links)
        now = cut_lineage(fit(small_star(fit(large_star(fit(now), fit)), fit)))
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
