"""Scores to long-only weights, in long form with cash as the row ``CASH``.

A cross-section is addressed by its keys (portfolio and date). Steps chain as windows over one
shuffle by those keys. ``wide`` is the caller's word that a cross-section may not fit a task (see
``functions.groups``); such ones use combining aggregates joined back by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeweave.functions.groups import value_prefix, with_group_row, with_stats
from tapeweave.sources.schema import finite

CASH = "CASH"
KEYS = ("portfolio_id", "decision_date")


def is_cash() -> Column:
    return F.col("ticker") == CASH


def with_cash(weights: DataFrame, keys=KEYS, cash: Column | float = 0.0, wide: bool = False) -> DataFrame:
    """Add a cash row to every cross-section that has none."""
    value = cash if isinstance(cash, Column) else F.lit(float(cash))
    fields = {"ticker": F.lit(CASH), "weight": value}
    listed = weights.select(*keys, "ticker", "weight")
    return with_group_row(listed, keys, wide, "ticker", fields, ~F.col("__has"), __has=F.max(is_cash()))


def _add_cash(stocks: DataFrame, keys, wide) -> DataFrame:
    """Add a cash row per cross-section: 1 where no name has mass, else 0."""
    fields = {"ticker": F.lit(CASH), "weight": F.when(F.col("__all") > 0, 0.0).otherwise(1.0), "__mass": F.lit(0.0)}
    return with_group_row(stocks, keys, wide, "ticker", fields, __all=F.sum("__mass")).drop("__mass")


def softmax_weights(
    scores: DataFrame, temperature: float = 0.01, clip: float = 20.0, keys=KEYS, score: str = "score",
    tradable: str | None = None, wide: bool = False,
) -> DataFrame:
    """Softmax of clipped scores and a zero cash row; with nothing tradable, all cash.

    Logits lie in [-clip, clip], so subtracting ``clip`` already keeps the exponentials in
    range and one sum per cross-section is enough.
    """
    if temperature <= 0 or not 0 < clip <= 300:
        raise ValueError("temperature must be positive and clip in (0, 300].")
    logit = F.greatest(F.least(F.col(score) / temperature, F.lit(float(clip))), F.lit(-float(clip)))
    usable = F.coalesce(F.col(tradable), F.lit(False)) if tradable else F.lit(True)
    raw = scores.withColumn("__mass", F.when(usable, F.exp(logit - clip)).otherwise(0.0))
    out = with_stats(raw, keys, wide, __sum=F.sum("__mass"))
    share = F.coalesce(F.try_divide("__mass", "__sum"), F.lit(0.0)).alias("weight")
    return _add_cash(out.select(*keys, "ticker", share, "__mass"), keys, wide)


def sparsemax_weights(
    scores: DataFrame, keys=KEYS, score: str = "score", tradable: str | None = None, wide: bool = False,
) -> DataFrame:
    """Euclidean projection of scores on the simplex (exact zeros) and a cash row."""
    usable = F.coalesce(F.col(tradable), F.lit(False)) if tradable else F.lit(True)
    flagged = scores.withColumn("__use", usable)
    z = F.when(F.col("__use"), F.col(score))
    flagged = with_stats(flagged, keys, wide, __peak=F.max(z)).withColumn("__z", z - F.col("__peak"))
    if wide:
        out = flagged.join(_support_threshold(flagged, keys), list(keys), "left")
    else:
        falling = Window.partitionBy(*keys).orderBy(F.col("__z").desc_nulls_last(), "ticker")
        so_far = falling.rowsBetween(Window.unboundedPreceding, 0)
        ranked = flagged.withColumns({"__k": F.row_number().over(falling), "__c": F.sum("__z").over(so_far)})
        inside = F.col("__use") & (1 + F.col("__k") * F.col("__z") > F.col("__c"))
        member = F.when(inside, F.col("__z"))
        out = with_stats(ranked, keys, False, __total=F.sum(member), __size=F.count(member))
        out = out.withColumn("__tau", F.try_divide(F.col("__total") - 1, F.col("__size")))
    weight = F.greatest(F.col("__z") - F.col("__tau"), F.lit(0.0))
    stocks = out.select(
        *keys, "ticker", F.when(F.col("__use"), weight).otherwise(0.0).alias("weight"),
        F.col("__use").cast("double").alias("__mass"),
    )
    return _add_cash(stocks, keys, wide)


def _support_threshold(flagged: DataFrame, keys) -> DataFrame:
    """Simplex threshold of wide cross-sections.

    Equal scores are collapsed: they enter the support together, so counts and totals over
    distinct values in descending order decide. Values one below the peak can never be in it.
    """
    near = flagged.filter(F.col("__use") & (F.col("__z") > -1)).groupBy(*keys, "__z").agg(F.count(F.lit(1)).alias("__n"))
    near = near.withColumn("__total", F.col("__z") * F.col("__n"))
    ordered = value_prefix(near, keys, "__z", ("__n", "__total"), ascending=False)
    inside = ordered.filter(1 + F.col("__n_before") * F.col("__z") > F.col("__total_before"))
    return inside.groupBy(*keys).agg(((F.sum("__total") - 1) / F.sum("__n")).alias("__tau"))


def normalize(weights: DataFrame, keys=KEYS, fallback: str | None = None, wide: bool = False) -> DataFrame:
    """Long-only weights summing to one; an unusable cross-section takes ``fallback`` or all cash.

    A cross-section is unusable when any weight is not finite or nothing positive is left.
    """
    ok = F.coalesce(finite("weight"), F.lit(False))
    clean = weights.withColumns({"__ok": ok, "__w": F.when(ok, F.greatest("weight", F.lit(0.0))).otherwise(0.0)})
    out = with_stats(clean, keys, wide, __all=F.min("__ok"), __sum=F.sum("__w"))
    other = F.col(fallback) if fallback else F.when(is_cash(), 1.0).otherwise(0.0)
    good = F.col("__all") & (F.col("__sum") > 0)
    value = F.when(good, F.try_divide("__w", "__sum")).otherwise(other)
    return out.withColumn("weight", value).drop("__ok", "__w", "__all", "__sum")


def keep_top_n(weights: DataFrame, n: int, keys=KEYS, wide: bool = False) -> DataFrame:
    """Keep the ``n`` largest risky weights (ties by ticker) and cash; the rest become 0.

    In a wide cross-section Spark keeps n rows per group and map task for the cut-off, and the
    rows compare themselves with it.
    """
    if n <= 0:
        raise ValueError("top_n must be positive.")
    if not wide:
        by_size = Window.partitionBy(*keys).orderBy(is_cash(), F.col("weight").desc(), F.col("ticker"))
        out = weights.withColumn("__rank", F.row_number().over(by_size))
        kept = is_cash() | (F.col("__rank") <= n)
    else:
        by_size = Window.partitionBy(*keys).orderBy(F.col("weight").desc(), F.col("ticker"))
        last_kept = (
            weights.filter(~is_cash())
            .withColumn("__rank", F.row_number().over(by_size))
            .filter(F.col("__rank") <= n)
            .filter(F.col("__rank") == n)
            .select(*keys, F.col("weight").alias("__cut"), F.col("ticker").alias("__cut_ticker"))
        )
        out = weights.join(last_kept, list(keys), "left")
        level = (F.col("weight") == F.col("__cut")) & (F.col("ticker") <= F.col("__cut_ticker"))
        kept = is_cash() | F.col("__cut").isNull() | (F.col("weight") > F.col("__cut")) | level
    sparse = out.withColumn("weight", F.when(kept, F.col("weight")).otherwise(0.0)).select(*weights.columns)
    return normalize(sparse, keys, wide=wide)


def cap_to_cash(weights: DataFrame, cap: float, keys=KEYS, wide: bool = False) -> DataFrame:
    """Cap risky weights and send what is left over to cash."""
    _check_cap(cap)
    capped = weights.withColumn("weight", F.when(is_cash(), F.col("weight")).otherwise(F.least("weight", F.lit(cap))))
    out = with_stats(capped, keys, wide, __sum=F.sum("weight"))
    rest = F.greatest(1 - F.col("__sum"), F.lit(0.0))
    moved = F.col("weight") + F.when(is_cash(), rest).otherwise(0.0)
    return normalize(out.withColumn("weight", moved).drop("__sum"), keys, wide=wide)


def cap_and_redistribute(weights: DataFrame, cap: float, keys=KEYS, wide: bool = False) -> DataFrame:
    """Cap risky weights and share the excess evenly, once, among names still below the cap.

    Without such a name the excess goes to cash. The single pass can lift a name over the cap.
    """
    _check_cap(cap)
    capped = weights.withColumn("weight", F.when(is_cash(), F.col("weight")).otherwise(F.least("weight", F.lit(cap))))
    open_ = ~is_cash() & (F.col("weight") < cap - 1e-12)
    out = with_stats(capped, keys, wide, __sum=F.sum("weight"), __open=F.count(F.when(open_, 1)))
    excess = 1 - F.col("__sum")
    share = F.when((excess > 0) & open_, F.try_divide(excess, F.col("__open"))).when(
        (excess > 0) & is_cash() & (F.col("__open") == 0), excess
    )
    total = F.when(excess > 0, 1.0).otherwise(F.col("__sum"))
    return out.withColumn("weight", (F.col("weight") + F.coalesce(share, F.lit(0.0))) / total).drop("__sum", "__open")


def _check_cap(cap: float) -> None:
    if not 0 < cap <= 1:
        raise ValueError("cap must be in (0, 1].")


def blend(current: DataFrame, target: DataFrame, alpha: float, keys=KEYS, wide: bool = False) -> DataFrame:
    """(1 - alpha) x current + alpha x target, renormalized."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1].")
    both = current.select(*keys, "ticker", (F.col("weight") * (1 - alpha)).alias("weight")).unionByName(
        target.select(*keys, "ticker", (F.col("weight") * alpha).alias("weight"))
    )
    mixed = both.groupBy(*keys, "ticker").agg(F.sum("weight").alias("weight"))
    out = with_stats(mixed, keys, wide, __sum=F.sum("weight"))
    return out.withColumn("weight", F.try_divide("weight", "__sum")).drop("__sum")


POLICIES = ("equal_weight", "equal_weight_cash", "cash")


def policy_portfolios(rows: DataFrame, policies=POLICIES, wide: bool = False) -> DataFrame:
    """Rule weights for every listed (date, ticker) and a cash row, one portfolio per policy."""
    unknown = [p for p in policies if p not in POLICIES]
    if unknown:
        raise ValueError(f"No rule portfolio is called {unknown[0]!r}.")
    keys = ["decision_date"]
    plain = rows.select(*keys, "ticker")
    named = with_group_row(plain, keys, wide, "ticker", {"ticker": F.lit(CASH)})
    counted = with_stats(named, keys, wide, __n=F.count(F.lit(1)))
    n = F.col("__n") - 1
    cash = {"equal_weight": F.lit(0.0), "equal_weight_cash": 1.0 / (n + 1), "cash": F.lit(1.0)}
    name = {"equal_weight": 1.0 / n, "equal_weight_cash": 1.0 / (n + 1), "cash": F.lit(0.0)}
    entries = [
        F.struct(F.lit(p).alias("portfolio_id"), F.when(is_cash(), cash[p]).otherwise(name[p]).alias("weight"))
        for p in policies
    ]
    return counted.select(*keys, "ticker", F.inline(F.array(*entries))).select(*KEYS, "ticker", "weight")


def benchmark_weights(rows: DataFrame, policy: str, wide: bool = False) -> DataFrame:
    return policy_portfolios(rows, (policy,), wide).drop("portfolio_id")


def liquidity_cost(participation: str | Column, spread_bps: str | Column, impact_bps: float = 10.0) -> Column:
    """Spread plus square-root impact, as a decimal."""
    if impact_bps < 0:
        raise ValueError("An impact cannot pay: impact_bps is below 0.")
    p = F.col(participation) if isinstance(participation, str) else participation
    s = F.col(spread_bps) if isinstance(spread_bps, str) else spread_bps
    return s / 10_000.0 + impact_bps / 10_000.0 * F.sqrt(p)
