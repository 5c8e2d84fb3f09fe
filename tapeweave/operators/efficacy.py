"""Feature efficacy: rank and linear correlations, by year, their stability, and partial forms.

A pair is judged on the rows where both of its sides are finite, and ranks are taken on those rows
alone: whatever is missing elsewhere in a row changes nothing. Pooled rank forms rank each column once
per set of rows that its partners leave, and read every pair from one Gram matrix of the ranks. Within
keys, pairs are laid out as rows and ranked by windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tapeweave.functions.groups import with_average_ranks
from tapeweave.functions.pooled_ranks import gram, pooled_ranks
from tapeweave.session import cut_lineage
from tapeweave.sources.schema import finite

METHODS = ("spearman", "pearson")
PAIR = ("feature", "label")


def _ranked(df: DataFrame, keys, columns, wide: bool) -> DataFrame:
    """Each column with its average-tie rank within the keys under ``__r_<column>``.

    Wide ranks read their input several times, so the narrow table of pairs is written once.
    """
    df = cut_lineage(df) if wide else df
    return with_average_ranks(df, keys, {f"__r_{c}": (c, True) for c in columns}, wide)


def _whole(names) -> Column:
    """Whether all columns hold finite numbers."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(finite(n), F.lit(False))
    return out


def _pairs(dataset: DataFrame, keys, pairs, also=()) -> DataFrame:
    """One row per row and pair: keys, feature, label, x, y and ``also``; numbers are null unless all of them are finite."""
    entries = []
    for f, l in pairs:
        ok = _whole([f, l, *also])
        sides = {"x": f, "y": l, **{f"c{i}": c for i, c in enumerate(also)}}
        cells = [F.when(ok, F.col(c).cast("double")).alias(n) for n, c in sides.items()]
        entries.append(F.struct(F.lit(f).alias("feature"), F.lit(l).alias("label"), *cells))
    return dataset.select(*keys, F.inline(F.array(*entries)))


def _guarded(x: Column, y: Column, raw_x: str, raw_y: str) -> Column:
    """Correlation, null below three rows or when a side is constant."""
    usable = (F.count(x) >= 3) & (F.min(raw_x) < F.max(raw_x)) & (F.min(raw_y) < F.max(raw_y))
    return F.when(usable, F.corr(x, y))


def _coefficients(dataset: DataFrame, ranked, pairs: dict, least: int = 3) -> dict:
    """Correlation of ranks per name of ``pairs`` (two names of ``ranked``); None below ``least`` rows or for a constant side."""
    products = gram(ranked)
    out = {}
    for name, (a, b) in pairs.items():
        i, j = ranked.of[a], ranked.of[b]
        spread = products[i, i] * products[j, j]
        out[name] = float(products[i, j] / np.sqrt(products[i, i]) / np.sqrt(products[j, j])) if ranked.sizes[i] >= least and spread > 0 else None
    return out


def _pooled_spearman(dataset: DataFrame, pairs) -> DataFrame:
    """Each unordered pair once; a pair of one column with itself like any other."""
    once = {tuple(sorted(p)) for p in pairs}
    wanted = {(p, side): (p[side], (p[1 - side],)) for p in once for side in (0, 1)}
    found = _coefficients(dataset, pooled_ranks(dataset, wanted), {p: ((p, 0), (p, 1)) for p in once})
    rows = [(f, l, found[tuple(sorted((f, l)))]) for f, l in pairs]
    out = dataset.sparkSession.createDataFrame(rows, "feature string, label string, correlation double")
    return out.withColumn("abs_correlation", F.abs("correlation"))


def feature_label_correlations(
    dataset: DataFrame, features, labels, method: str = "spearman", keys=(), wide: bool | None = None
) -> DataFrame:
    """Every feature against every label per key: correlation and its absolute value.

    ``wide`` goes to the rank kernel; without keys a pair holds the whole table, so it is the default there.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown correlation method {method!r}; known: {', '.join(METHODS)}.")
    if method == "spearman" and not keys and wide is not False:
        return _pooled_spearman(dataset, [(f, l) for f in features for l in labels])
    by = [*keys, *PAIR]
    df = _pairs(dataset, keys, [(f, l) for f in features for l in labels])
    if method == "spearman":
        df = _ranked(df, by, ("x", "y"), not keys if wide is None else wide)
    value = (lambda c: F.col(f"__r_{c}")) if method == "spearman" else F.col
    out = df.groupBy(*by).agg(_guarded(value("x"), value("y"), "x", "y").alias("correlation"))
    return out.withColumn("abs_correlation", F.abs("correlation"))


def correlation_matrix(dataset: DataFrame, columns, method: str = "spearman", keys=()) -> DataFrame:
    return feature_label_correlations(dataset, columns, columns, method, keys).select(
        *keys, F.col("feature").alias("left"), F.col("label").alias("right"), "correlation"
    )


def by_year(
    dataset: DataFrame, features, labels, method: str = "spearman", keys=(), wide: bool | None = None
) -> DataFrame:
    """The same correlations with ranks taken inside each calendar year."""
    dated = dataset.withColumn("year", F.year("date"))
    return feature_label_correlations(dated, features, labels, method, (*keys, "year"), wide)


def stability(yearly: DataFrame, keys=()) -> DataFrame:
    """Median, mean and sign agreement of yearly correlations per feature and label."""
    by = [*keys, "feature", "label"]
    usable = yearly.filter(finite("correlation"))
    facts = usable.groupBy(*by).agg(
        F.median("correlation").alias("median_corr"),
        F.avg("correlation").alias("mean_corr"),
        F.count(F.lit(1)).alias("years"),
        F.count_if(F.col("correlation") > 0).alias("__up"),
        F.count_if(F.col("correlation") < 0).alias("__down"),
    )
    agree = F.when(F.col("median_corr") > 0, F.col("__up")).when(F.col("median_corr") < 0, F.col("__down"))
    return facts.select(
        *by, "median_corr", "mean_corr", F.abs("median_corr").alias("abs_median_corr"),
        (agree / F.col("years")).alias("sign_stability"), "years",
    )


def partial_spearman(dataset: DataFrame, features, label: str, controls) -> DataFrame:
    """Rank correlation of residual ranks given the controls, per feature; null below ten rows.

    A feature is judged on the rows where it, the label and all controls are finite. The normal equations of
    all features come from one Gram matrix; systems as large as the control list are solved on the driver.
    """
    features, controls = list(features), list(controls)
    wanted = {}
    for f in features:
        beside = (f, label, *controls)
        wanted |= {(f, side): (c, beside) for side, c in [("x", f), ("y", label), *enumerate(controls)]}
    ranked = pooled_ranks(dataset, wanted)
    products = gram(ranked)
    left, sides = [], {}
    for k, f in enumerate(features):
        own = [ranked.of[(f, i)] for i in range(len(controls))]
        if ranked.sizes[ranked.of[(f, "x")]] < 10:
            continue
        for side in ("x", "y"):
            at = ranked.of[(f, side)]
            beta = np.linalg.lstsq(products[np.ix_(own, own)], products[own, at], rcond=None)[0]
            mean = (ranked.sizes[at] + 1) / 2
            fitted = sum(((F.col(f"r{c}") - mean) * float(w) for c, w in zip(own, beta)), F.lit(0.0))
            sides[(f, side)] = f"{side}{k}"
            left.append((F.col(f"r{at}") - mean - fitted).alias(f"{side}{k}"))
    found = {}
    if left:
        other = {"x": "y", "y": "x"}
        again = pooled_ranks(ranked.table.select(*left), {(f, s): (c, (sides[(f, other[s])],)) for (f, s), c in sides.items()})
        found = _coefficients(dataset, again, {f: ((f, "x"), (f, "y")) for f in features if (f, "x") in sides})
    rows = [(f, label, found.get(f)) for f in features]
    return dataset.sparkSession.createDataFrame(rows, "feature string, label string, partial_spearman double")


def raw_versus_partial(dataset: DataFrame, features, label: str, controls) -> DataFrame:
    """Raw and partial rank correlation and how much the controls take away."""
    raw = feature_label_correlations(dataset, features, [label])
    both = raw.select("feature", "label", F.col("correlation").alias("raw_spearman")).join(
        partial_spearman(dataset, features, label, controls), ["feature", "label"]
    )
    return both.withColumn("abs_drop", F.abs("raw_spearman") - F.abs("partial_spearman"))


def ticker_summary(dataset: DataFrame, features, labels, top_label: str) -> DataFrame:
    """Per ticker: rows, years, the strongest feature for a label, and the most stable pair."""
    size = dataset.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.year("date")).alias("years")
    )
    pooled = feature_label_correlations(dataset, features, [top_label], keys=("ticker",))
    order = lambda c: F.struct(F.coalesce(c, F.lit(-1.0)), F.col("feature"))
    top = pooled.groupBy("ticker").agg(
        F.max_by(F.struct("feature", "correlation"), order(F.col("abs_correlation"))).alias("t")
    )
    steady = stability(by_year(dataset, features, labels, keys=("ticker",)), ("ticker",))
    firm = steady.groupBy("ticker").agg(
        F.max_by(
            F.struct("feature", "label", "median_corr", "sign_stability"),
            F.struct("abs_median_corr", F.coalesce("sign_stability", F.lit(-1.0)), "feature", "label"),
        ).alias("s")
    )
    return (
        size.join(top, "ticker")
        .join(firm, "ticker")
        .select(
            "ticker", "rows", "years", F.col("t.feature").alias("top_feature"), F.col("t.correlation").alias("top_correlation"),
            F.col("s.feature").alias("stable_feature"), F.col("s.label").alias("stable_label"),
            F.col("s.median_corr").alias("stable_median"), F.col("s.sign_stability").alias("stable_sign"),
        )
    )
