import random

import numpy as np
from pyspark.sql import functions as F

from tapeweave.llm import quality

HOW = quality.Training(rows=300, steps=4000)


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(["an", "the", "re", "on"]) for _ in range(3)) for _ in range(rng.choice([5, 40, 200]))]
        good = i % 4 > 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w for w in words for _ in range(8)]
        rows.append((i, " ".join(words), int(good)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, t, _ in rows], "doc_id long, text string, label string, score double")
    return docs, spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = corpus(400)
    docs, labels = tables(spark, rows)
    held = F.col("doc_id") % 5 == 0
    model = quality.fit(docs, labels, HOW, usable=~held)
    scored = {r.doc_id: r.score for r in quality.scores(docs, model).collect()}
    right = [(scored[k] >= quality.THRESHOLD) == q for k, _, q in rows if k % 5 == 0]
    assert np.mean(right) > 0.95
    again = quality.fit(docs.repartition(7), labels, HOW, usable=~held)
    assert np.array_equal(model.parts, again.parts)


def test_labels_outside_the_condition_teach_nothing(spark):
    rows = corpus(120)
    docs, labels = tables(spark, rows)
    usable = F.col("doc_id") % 5 != 0
    flipped = labels.withColumn("quality", F.expr("CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END"))
    a, b = (quality.fit(docs, x, HOW, usable=usable) for x in (labels, flipped))
    assert np.array_equal(a.parts, b.parts) and a.constant == b.constant


def test_scores_match_a_plain_average(spark):
    """Cached word parts give what the counts of the whole text give."""
    rng = np.random.default_rng(0)
    model = quality.Model(rng.standard_normal(quality.BUCKETS), 0.25)
    texts = [t for _, t, _ in corpus(40)] + ["", " \n ", "a", "same same same", "é日本 🙂", "w" * 70_000, "x y " * 9000]
    small = quality.Scorer(model, limit=30)
    for text in texts + texts:
        at, times = quality.counts(text)
        odds = 0.25 + times @ model.parts[at] / (times.sum() + quality.BLANK)
        assert np.isclose(small.score(text), 1 / (1 + np.exp(-odds)))


def test_edge_rows(spark):
    docs, labels = tables(spark, [(1, None, 1), (2, "", 0), (None, "no id", 1), (2, "", 0), (5, "good words", 1)])
    odd = labels.unionByName(spark.createDataFrame([(5, None, 0), (5, 7, 0), (99, 1, 0)], labels.schema))
    model = quality.fit(docs, odd, HOW)
    scores = quality.scores(docs, model).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    nothing = quality.fit(docs, labels.where("false"), HOW)
    assert {r.score for r in quality.scores(docs, nothing).collect()} == {0.5}
    assert quality.scores(docs.where("false"), model).collect() == []
    assert quality.keep_good(docs.where("false"), model).collect() == []


def test_the_filter_keeps_rows_as_they_are(spark):
    rows = corpus(80)
    docs, labels = tables(spark, rows)
    model = quality.fit(docs, labels, HOW)
    kept = quality.keep_good(docs, model)
    good = {r.doc_id for r in quality.scores(docs, model).collect() if r.score >= quality.THRESHOLD}
    assert kept.schema == docs.schema
    assert sorted(kept.collect()) == sorted(r for r in docs.collect() if r.doc_id in good)


def test_the_sample_stays_bounded_when_ids_and_rows_repeat(spark):
    many = [(1, f"text number {i} " * (1 + i % 3)) for i in range(300)] + [(2, "same text")] * 500 + [(3, "other")]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)] * 40, "doc_id long, quality int")
    for rows in (10, 100, 1000):
        how = quality.Training(rows=rows, steps=200)
        taken = quality.sample(docs, labels, how, "doc_id", "text", "quality", F.lit(True)).collect()
        assert len(taken) == min(rows, 302)
    assert sum(r.text == "same text" for r in taken) == 1
    table = quality.features(spark.createDataFrame([(1, "a b " * 80_000)], "label int, text string")).first()
    at, times = quality.counts("a b " * 80_000)
    assert (quality.ints(table["at"], len(at)) == at).all() and (quality.ints(table["times"], len(at)) == times).all()
