"""Per-group statistics, ranks and ordered totals.

Every function is lazy and looks at no sizes. Where one exists, ``wide`` is the caller's
statement about the groups:

* ``wide=False``: the rows of any one group fit a task (a cross-section of a date). Windows
  chain over a single shuffle;
* ``wide=True``: a group may hold any share of the table (a pooled column). Statistics combine
  map-side and are joined back by key; ordered work first collapses equal values, then cuts each
  group into magnitude bands and each band into even pieces, and adds up the pieces before.

Both give the same values; sums may differ in the last digits by the order of addition. A wide call
reads its input more than once, so pass a table that is cheap to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bands per doubling of a value, and pieces per band.
BANDS, PIECES = 64, 256
#: A value is hot when it makes up one in so many rows of the table, so there are at most so many.
HOT = 1000


def with_stats(df: DataFrame, keys, wide: bool = False, **aggs: Column) -> DataFrame:
    """Add group aggregates (plain aggregate functions) to every row; keys are non-null."""
    if not wide:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), list(keys))


def with_group_row(
    df: DataFrame, keys, wide: bool, order: str, fields: dict[str, Column], needed: Column | None = None,
    **aggs: Column,
) -> DataFrame:
    """Add one row per group, where ``needed`` holds.

    ``fields`` (the new row's values) and ``needed`` refer to the keys and the named ``aggs``.
    """
    names = [c for c in df.columns if c not in keys]
    needed = F.lit(True) if needed is None else needed
    if wide:
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *[a.alias(n) for n, a in aggs.items()])
        new = [fields[c].cast(df.schema[c].dataType).alias(c) for c in names]
        return df.unionByName(groups.filter(needed).select(*keys, *new))
    w = Window.partitionBy(*keys)
    first = F.row_number().over(w.orderBy(order)) == 1
    marked = df.withColumns({"__first": first, **{n: a.over(w) for n, a in aggs.items()}})
    own = F.struct(*[F.col(c) for c in names])
    new = F.struct(*[fields[c].cast(df.schema[c].dataType).alias(c) for c in names])
    rows = F.when(F.col("__first") & needed, F.array(own, new)).otherwise(F.array(own))
    return marked.select(*keys, F.inline(rows))


def _before(frame: DataFrame, part, measures, by: Column, prefix: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumns({f"{prefix}{m}": F.coalesce(F.sum(m).over(w), F.lit(0)) for m in measures})


def value_prefix(values: DataFrame, keys, value: str, measures: tuple[str, ...], ascending: bool = True) -> DataFrame:
    """Totals of ``measures`` over all smaller (or larger) values of the same group.

    ``values`` has one row per key and distinct numeric value. Adds ``<measure>_before``. Bands are
    by sign and logarithm, pieces split a band evenly between its least and greatest value; both
    rise with the value, so totals of whole bands and pieces add up, and only the values of one
    piece are ever sorted together.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    rise = lambda c: F.col(c) if ascending else -F.col(c)
    size = F.floor(F.log2(F.abs(x)) * BANDS) + 1_000_000
    band = F.when(F.isnan(x), 2**40).when(x == 0, 0).when(F.abs(x) == float("inf"), F.signum(x) * 2**39).otherwise(F.signum(x) * size)
    placed = values.withColumn("__band", band.cast("long"))
    bands = placed.groupBy(*keys, "__band").agg(
        F.min(x).alias("__low"), F.max(x).alias("__high"), *[F.sum(m).alias(m) for m in measures]
    )
    bands = _before(bands, keys, measures, rise("__band"), "__b_").drop(*measures)
    share = F.try_divide(x - F.col("__low"), F.col("__high") - F.col("__low"))
    piece = F.when(F.col("__low") < F.col("__high"), F.floor(share * PIECES)).otherwise(0)
    cut = placed.join(bands, [*keys, "__band"]).withColumn("__piece", F.coalesce(piece, F.lit(0)).cast("long"))
    part = [*keys, "__band", "__piece"]
    pieces = cut.groupBy(*part).agg(*[F.sum(m).alias(m) for m in measures])
    pieces = _before(pieces, [*keys, "__band"], measures, rise("__piece"), "__p_").drop(*measures)
    inside = _before(cut, part, measures, rise(value), "__i_")
    totals = {f"{m}_before": F.col(f"__b_{m}") + F.col(f"__p_{m}") + F.col(f"__i_{m}") for m in measures}
    out = inside.join(pieces, part).withColumns(totals)
    return out.select(*values.columns, *totals)


def with_average_ranks(
    df: DataFrame, keys, ranks: dict[str, tuple[str, bool]], wide: bool = False
) -> DataFrame:
    """Average-tie ranks (1-based) in the group; null values get null.

    ``ranks``: output column to (value column, ascending). All of them are taken from the same
    input, so wide ranks of many columns read it once per column and once for the result.
    """
    keys = list(keys)
    if not wide:
        out = {}
        for output, (value, up) in ranks.items():
            w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last() if up else F.col(value).desc_nulls_last())
            ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
            out[output] = F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2.0)
        return df.withColumns(out)
    result = df.withColumn("__spread", F.xxhash64(*df.columns))
    for output, (value, up) in ranks.items():
        result = _joined_rank(result, df, keys, value, output, up)
    return result.select(*df.columns, *ranks)


def _joined_rank(rows: DataFrame, df: DataFrame, keys: list[str], value: str, output: str, ascending: bool) -> DataFrame:
    on = [*keys, value]
    names = [f"__k{i}" for i in range(len(on))]
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*on).agg(F.count(F.lit(1)).alias("__ties"))
    ranked = value_prefix(distinct, keys, value, ("__ties",), ascending)
    rank = F.col("__ties_before") + (F.col("__ties") + 1) / 2.0
    ranked = ranked.select(*[F.col(c).alias(n) for c, n in zip(on, names)], "__ties", rank.alias("__rank"))
    # a hot value's rows meet a broadcast rank, at most HOT of them; the other values are no hot keys
    total = distinct.agg(F.sum("__ties").alias("__total"))
    hot = ranked.join(F.broadcast(total), F.col("__ties") * HOT >= F.col("__total")).select(*names, F.col("__rank").alias("__hot"))
    same = [F.col(c) == F.col(n) for c, n in zip(on, names)]
    met = rows.join(F.broadcast(hot), same, "left").drop(*names)
    # rows that need no second join are spread instead of meeting under one key
    settled = F.col("__hot").isNotNull() | F.col(value).isNull()
    met = met.withColumn("__salt", F.when(settled, F.coalesce(F.nullif("__spread", F.lit(0)), F.lit(1))).otherwise(0))
    rest = ranked.select(*names, F.col("__rank"), F.lit(0).cast("long").alias("__zero"))
    out = met.join(rest, [*same, F.col("__salt") == F.col("__zero")], "left")
    out = out.withColumn(output, F.coalesce("__hot", "__rank"))
    return out.drop(*names, "__hot", "__rank", "__zero", "__salt")


def with_average_rank(
    df: DataFrame, keys, value: str, output: str, ascending: bool = True, wide: bool = False
) -> DataFrame:
    """Average-tie rank (1-based) of ``value`` in its group; null values get null."""
    return with_average_ranks(df, keys, {output: (value, ascending)}, wide)


def percentile_from_rank(rank: str | Column, n: Column) -> Column:
    """(rank-1)/(n-1) over all rows of the cross-section; a lone row scores 1."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(n <= 1, F.lit(1.0)).otherwise((r - 1.0) / F.nullif(n - 1.0, F.lit(0.0)))
