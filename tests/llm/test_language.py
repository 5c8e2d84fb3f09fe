import random

import numpy as np
from pyspark.sql import functions as F

from tapeweave.llm import language

SYLLABLES = {"de": ["sch", "ein", "ung", "ü"], "en": ["th", "ing", "er", "wh"], "es": ["ción", "os", "ll", "ñ"], "fr": ["eau", "oi", "è", "ou"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))


def corpus(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        declared = lang if i % 10 else rng.choice(sorted(SYLLABLES))  # some are wrong
        rows.append((i, prose(rng, lang, rng.choice([2, 30, 400])), declared, f"{'m.' if i % 2 else ''}{lang}.example.com", lang))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r[:4], "clash", 3) for r in rows], "doc_id long, text string, lang string, source string, host string, n int").repartition(4)


def test_languages_are_found_despite_wrong_declarations(spark):
    rows = corpus()
    found = {r.doc_id: r for r in language.identify(table(spark, rows), F.col("lang"), F.col("source")).collect()}
    assert len(found) == len(rows)
    assert np.mean([found[k].language == lang for k, *_, lang in rows]) > 0.99
    assert not any(r.rejected for r in found.values())
    assert all(0 < r.probability <= 1 + 1e-9 for r in found.values())


def brute(rows, languages=language.LANGUAGES):
    """The same fusion in plain Python over all rows."""
    counts = np.full((language.BUCKETS, 4), 0.5)
    grams = [language.trigrams(r[1] or "") for r in rows]
    for r, g in zip(rows, grams):
        if r[2] in languages:
            counts[:, languages.index(r[2])] += g
    logs = np.log(counts / counts.sum(axis=0))
    text = [(g @ logs) * min(g.sum(), language.TEXT_WEIGHT) / g.sum() if g.sum() else np.zeros(4) for g in grams]
    own = [int(np.argmax(t)) if g.sum() else None for t, g in zip(text, grams)]
    shares = np.array([1.0 + sum(o == i for o in own) for i in range(4)])
    shares /= shares.sum()
    keys = [((r[3] or ""), ".".join((r[3] or "").split(".")[-2:]) if "." in (r[3] or "") else None, (r[3] or "").split(".")[-1] if "." in (r[3] or "") else None) for r in rows]
    out = {}
    for a, r in enumerate(rows):
        def tally(same):
            return np.array([float(sum(o == i and same(b) for b, o in enumerate(own) if b != a)) for i in range(4)])

        def drawn(n, wider):
            return (n + language.KEPT * wider) / (n.sum() + language.KEPT)

        none = np.zeros(4)
        wide = drawn(tally(lambda b: keys[b][2] == keys[a][2]) if keys[a][2] else none, shares)
        middle = drawn(tally(lambda b: keys[b][1] == keys[a][1]) if keys[a][1] else none, wide)
        prior = drawn(tally(lambda b: keys[b][0] == keys[a][0]) if keys[a][0] else none, middle)
        given = drawn(tally(lambda b: rows[b][2] == r[2]) if r[2] else none, shares)
        fused = text[a] + np.log(prior) + np.log(given) - np.log(shares)
        p = np.exp(fused - fused.max())
        out[r[0]] = (languages[int(np.argmax(fused))], p.max() / p.sum(), grams[a].sum() == 0 or p.max() / p.sum() < 0.5)
    return out


def test_fusion_matches_brute_force(spark):
    rows = corpus(80) + [(900, None, "en", "", None), (901, "", None, "src0", None), (902, "12 34", "fr", None, None), (903, "th", "xx", "src0", None), (904, "日本", "en", "src0", None)]
    want = brute(rows)
    found = language.identify(table(spark, rows), F.col("lang"), F.col("source")).collect()
    for r in found:
        assert (r.language, r.rejected) == (want[r.doc_id][0], want[r.doc_id][2]), r
        assert np.isclose(r.probability, want[r.doc_id][1])
    assert {r.doc_id for r in found if r.rejected} >= {900, 901, 902}


def test_long_texts_are_counted_whole():
    rng = random.Random(1)
    text = prose(rng, "en", 2000)
    whole, parts = language.trigrams(text), None
    language.SLICE, kept = 1000, language.SLICE
    try:
        parts = language.trigrams(text)
    finally:
        language.SLICE = kept
    assert (whole == parts).all() and whole.sum() > 10_000


def test_stage_keeps_columns_repeats_and_null_ids(spark):
    rows = corpus(40) + [(None, "th ing er", "en", "s", "en"), (3, None, "en", "s", "en"), (700, None, "en", "s", "en"), (1, "th ing wh", "en", "s", "en")]
    docs = table(spark, rows)
    kept = language.keep_identified(docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert 700 not in ids and ids.count(1) == 2 and ids.count(None) == 1
    assert language.keep_identified(docs.where("false")).collect() == []


def test_pages(spark):
    html = '<!DOCTYPE html><HTML class="x" lang="fr-CA"><head><title>th</title><script>var en="</p>";</script></head><body><!-- x --><p>eau<b>oi</b></body>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "plain eau oi"), (4, "<p lang='de'>eau")], "page_id long, html string")
    read = pages.select("page_id", language.declared_language(F.col("html")).alias("d"), language.page_text(F.col("html")).alias("t"))
    rows = {r.page_id: (r.d, (r.t or "").split()) for r in read.collect()}
    assert rows[1] == ("fr", ["eau", "oi"]) and rows[2] == (None, []) and rows[3][1] == ["plain", "eau", "oi"] and rows[4] == ("", ["eau"])
    found = language.identify_pages(pages, F.lit("h.org")).collect()
    assert sorted(r.page_id for r in found) == [1, 2, 3, 4]
