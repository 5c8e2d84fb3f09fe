import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeweave.llm import neighbours


def brute(rows, k, every=10):
    out = {}
    for q, v in rows:
        if q % every:
            continue
        scores = {}
        for i, w in rows:
            if i != q:
                s = float((v * w).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum())))
                scores[i] = max(s, scores.get(i, -9.0))
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1) for i, v in rows],
        "vec_id long, embedding array<float>, q string, shard int",
    ).repartition(4)


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(0, 12, 900)] + rng.standard_normal((900, 24))).astype(np.float32).astype(float)
    rows = list(enumerate(x))
    found = lists(neighbours.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, shard=200, block=40))
    want = brute(rows, 5)
    assert set(found) == set(want)
    hits = 0
    for q, best in want.items():
        assert [r for r, _, _ in found[q]] == [1, 2, 3, 4, 5]
        exact = dict(brute([(q, x[q])] + [(i, x[i]) for _, i, _ in found[q]], 5, q or 1)[q])
        assert all(np.isclose(s, exact[i], rtol=1e-12) for _, i, s in found[q])
        hits += len({i for _, i, _ in found[q]} & {i for i, _ in best})
    assert hits / (5 * len(want)) >= 0.9


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    index = neighbours.Index(codes)
    for radius in (0, 1, 3, 4, 7, 9, 12, 31, 32):
        for code in codes[:20]:
            want = np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= radius)
            assert (np.sort(index.within(code, radius)) == want).all()


@pytest.mark.parametrize("shard", [5, 1000])
def test_copies_ties_and_unusable_vectors(spark, shard):
    rng = np.random.default_rng(3)
    hot, odd = rng.standard_normal(6).astype(np.float32), rng.standard_normal((20, 6)).astype(np.float32)
    rows = [(i, hot.astype(float)) for i in range(60)] + [(100 + i, v.astype(float)) for i, v in enumerate(odd)]
    rows += [(200, 2.0 * hot.astype(float))]  # the same direction at another length
    bad = [(300, None), (310, []), (320, [0.0] * 6), (330, [1.0, None, 0, 0, 0, 0]), (340, [float("nan")] * 6), (350, [float("inf"), 0, 0, 0, 0, 0]), (360, [1.0, 2.0]), (None, hot)]
    found = lists(neighbours.nearest(table(spark, rows + bad + rows[:3]), F.col("vec_id") % 10 == 0, shard=shard, block=3))
    want = brute(rows, 5)
    assert set(found) == set(want)
    for q, best in want.items():
        if q < 100:
            assert [i for _, i, _ in found[q]] == [i for i, _ in best]
        assert len(found[q]) == 5


def test_few_rows_and_empty_tables(spark):
    rows = [(0, np.array([1.0, 0.0])), (1, np.array([0.0, 1.0])), (2, np.array([-1.0, 0.5]))]
    found = lists(neighbours.nearest(table(spark, rows), F.col("vec_id") == 0))
    assert [(r, i) for r, i, _ in found[0]] == [(1, 1), (2, 2)]
    assert lists(neighbours.nearest(table(spark, rows[:1]), F.col("vec_id") == 0)) == {}
    assert lists(neighbours.nearest(table(spark, rows), F.col("vec_id") > 5)) == {}
    empty = neighbours.nearest(table(spark, rows).where("false"), F.col("vec_id") == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.collect() == []


def test_lengths_of_vectors_do_not_matter(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 16))
    whole = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = lists(neighbours.nearest(whole, F.col("vec_id") % 10 == 0))
    for powers in ([664] * 120, [-664] * 120, [(-900, 0, 900)[i % 3] for i in range(120)]):
        rows = [(i, (v * 2.0**p).tolist()) for i, (v, p) in enumerate(zip(x, powers))]
        moved = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert lists(neighbours.nearest(moved, F.col("vec_id") % 10 == 0)) == want
