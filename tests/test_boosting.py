import numpy as np
import pytest

from tapeweave.config import BoostedClassifier, BoostedRegression
from tapeweave.operators import boosting
from tapeweave.operators.boosting import Trees
from tapeweave.operators.models import classification_trees, regression_trees


def borders(x, bins):
    v = np.sort(x)
    values = np.unique(v)
    if len(values) > bins:
        values = np.unique([v[-(-len(v) * i // bins) - 1] for i in range(1, bins)])
    return values[values < v[-1]]


def plain(x, y, w, how):
    """Scores of the training rows, one leaf at a time, by trying every border on the rows themselves."""
    score = np.full(len(y), (w * y).sum() / w.sum())
    if how.logistic:
        score = np.log(score / (1 - score))
    cuts = [borders(c, how.bins) for c in x.T]
    soft = lambda g: np.sign(g) * max(abs(g) - how.alpha, 0)
    for _ in range(how.n):
        p = 1 / (1 + np.exp(-score))
        g, h = (w * (p - y), w * p * (1 - p)) if how.logistic else (w * (score - y), w)

        def best(rows):
            worth = lambda r: soft(g[r].sum()) ** 2 / (h[r].sum() + how.l2)
            found = None
            for f, cs in enumerate(cuts):
                for c in cs:
                    left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if min(len(left), len(right)) >= how.least_rows:
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > 1e-13 and (found is None or gain > found[0] + 1e-13):
                            found = (gain, left, right)
            return found

        leaves = [(0, np.arange(len(y)))]
        while len(leaves) < how.leaves:
            options = [(best(r), i) for i, (d, r) in enumerate(leaves) if how.depth is None or d < how.depth]
            options = [(b, i) for b, i in options if b]
            if not options:
                break
            (_, left, right), i = max(options, key=lambda o: o[0][0])
            d, _ = leaves.pop(i)
            leaves += [(d + 1, left), (d + 1, right)]
        for _, r in leaves:
            score[r] -= how.rate * soft(g[r].sum()) / (h[r].sum() + how.l2)
    return score


def table(spark, seed, n, models, logistic):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(models):
        x = np.round(rng.standard_normal((n, 3)), 2)
        x[:, 2] = rng.integers(0, 4, n)
        y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 1) + 0.3 * rng.standard_normal(n)
        y = (y > 0.2).astype(float) if logistic else y
        w = rng.choice([0.5, 1.0, 2.5], n)
        rows += [(m, i, *map(float, r), float(t), float(v), "x") for i, (r, t, v) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "split long, i long, a double, b double, c double, target double, w double, score string"), rows


SETTINGS = [
    Trees(n=4, rate=0.3, leaves=6, depth=None, least_rows=5, alpha=0.4, l2=0.7, bins=12),
    Trees(n=3, rate=0.5, leaves=15, depth=3, least_rows=8, alpha=0.0, l2=1.0, bins=255),
    Trees(n=12, rate=0.2, leaves=2, depth=5, least_rows=1, bins=6),
    Trees(n=3, rate=0.4, leaves=7, depth=4, least_rows=6, l2=0.5, bins=16, logistic=True),
]


@pytest.mark.parametrize("how", SETTINGS)
def test_scores_equal_growing_leaf_by_leaf(spark, how):
    df, rows = table(spark, 3, 160, 2, how.logistic)
    model = boosting.fit(df, ("a", "b", "c"), how, weight="w", keys=("split",))
    got = {(r["split"], r["i"]): r["score"] for r in boosting.predict(model, df).collect()}
    for m in range(2):
        mine = [r for r in rows if r[0] == m]
        want = plain(np.array([r[2:5] for r in mine]), np.array([r[5] for r in mine]), np.array([r[6] for r in mine]), how)
        assert np.allclose([got[(m, r[1])] for r in mine], want, rtol=0, atol=1e-9)


def test_same_bits_under_any_partitioning_and_alone(spark):
    df, _ = table(spark, 5, 200, 3, False)
    how = Trees(n=3, rate=0.3, leaves=5, depth=3, least_rows=4, bins=20)
    one = boosting.fit(df.coalesce(1), ("a", "b", "c"), how, keys=("split",))
    many = boosting.fit(df.repartition(11, "i"), ("a", "b", "c"), how, keys=("split",))
    assert one == many
    alone = boosting.fit(df.where("split = 1"), ("a", "b", "c"), how)
    assert alone.base == one.base[1:2] and alone.trees == one.trees[1:2]
    assert boosting.Ensemble.from_json(one.to_json()) == one


def test_jobs_do_not_grow_with_the_models(spark):
    how = Trees(n=2, rate=0.3, leaves=4, depth=2, least_rows=4, bins=8)
    tracker, spent = spark.sparkContext.statusTracker(), []
    for models in (1, 6):
        df, _ = table(spark, 6, 80, models, False)
        group = f"boosting-{models}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.fit(df, ("a", "b", "c"), how, keys=("split",))
        spent.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("other", "other")
    assert spent[1] <= spent[0] + 6  # adaptive execution may split a few; five more models would add far more


def test_awkward_tables(spark):
    how = Trees(n=2, leaves=3, least_rows=1, bins=4)
    df = spark.createDataFrame([(1.0, 2.0)] * 10, "a double, target double")
    flat = boosting.fit(df, ("a",), how)
    assert {r["score"] for r in boosting.predict(flat, df).collect()} == {2.0}
    big = spark.createDataFrame([(float(i), 1e200 * (-1) ** (i // 5)) for i in range(10)], "a double, target double")
    assert all(np.isfinite(r["score"]) for r in boosting.predict(boosting.fit(big, ("a",), how), big).collect())
    other = spark.createDataFrame([(None, 1.0), (9, 1.0)], "k int, a double")
    keyed = boosting.fit(df.selectExpr("a", "target", "1 AS k"), ("a",), how, keys=("k",))
    assert {r["score"] for r in boosting.predict(keyed, other).collect()} == {None}
    assert boosting.predict(flat, df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(df.limit(0), ("a",), how)
    with pytest.raises(ValueError, match="both classes"):
        boosting.fit(df.selectExpr("a", "1.0D AS target"), ("a",), Trees(logistic=True))
    for bad in (None, float("nan"), float("inf")):
        broken = spark.createDataFrame([(1.0, 2.0), (bad, 1.0)], "a double, target double")
        with pytest.raises(Exception, match="not a number"):
            boosting.fit(broken, ("a",), how)
        with pytest.raises(Exception, match="not a number"):
            boosting.predict(flat, broken).collect()


BAD = [
    dict(n_estimators=0), dict(learning_rate=0.0), dict(num_leaves=1), dict(max_depth=0), dict(max_depth=-2), dict(min_child_samples=0),
    dict(reg_alpha=-0.1), dict(reg_lambda=-1.0), dict(max_bins=256), dict(temperature=0.0), dict(score_clip=-1.0), dict(target_horizons=()),
    dict(target_horizons=(5, 5, 20)), dict(target_horizons=(0, 1, 2)), dict(target_weights=(1.0,)), dict(target_weights=(0.0, 0.0, 0.0)),
    dict(max_position_weight=0.0), dict(smoothing_alpha=1.5),
]


@pytest.mark.parametrize("setting", BAD)
def test_regression_settings_are_checked(setting):
    with pytest.raises(ValueError):
        BoostedRegression(**setting)


@pytest.mark.parametrize("setting", [dict(max_iter=0), dict(max_leaf_nodes=1), dict(max_depth=0), dict(min_samples_leaf=0), dict(l2_regularization=-1.0), dict(max_bins=1), dict(learning_rate=-1.0)])
def test_classifier_settings_are_checked(setting):
    with pytest.raises(ValueError):
        BoostedClassifier(**setting)


def test_settings_reach_the_trees():
    how = regression_trees(BoostedRegression(num_leaves=9, max_depth=-1, reg_alpha=0.0, reg_lambda=0.0, min_child_samples=3))
    assert (how.leaves, how.depth, how.alpha, how.l2, how.least_rows, how.n, how.logistic) == (9, None, 0.0, 0.0, 3, 100, False)
    how = classification_trees(BoostedClassifier(max_leaf_nodes=4, max_depth=None, l2_regularization=0.0, max_bins=31))
    assert (how.leaves, how.depth, how.l2, how.bins, how.least_rows, how.logistic) == (4, None, 0.0, 31, 20, True)
