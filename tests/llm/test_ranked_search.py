import math
import random
import re
from collections import Counter

import pytest

from tapeweave.llm import ranked_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    """[(item, rank, id, score)] by scoring every pair."""
    split = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n_docs, length = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, c in split:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "x_y", "日本"]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.choice((1, 5, 40))))) for i in range(n)]
    return rows + [(i + n, rows[i % 7][1]) for i in range(40)]  # many equal scores


def run(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(6)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    out = ranked_search.search(d, b, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def expected(docs, items, k=10):
    return sorted(plain(docs, items, k), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


ITEMS = [(1, "w0 w1 W2 w59"), (2, "naïve ÉtÉ"), (3, "absent"), (4, None), (5, ""), (6, "日本 x y w3, w3"), (None, "w5 w6"), (1, "w7 W0")]


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_ranks_equal_scoring_every_pair(spark, k):
    docs = corpus(1, 150) + [(None, "w0 w1 w2"), (900, None), (901, ""), (902, "!!"), (3, "w0 w59"), (3, "w0 w59"), (903, "w1 " * 30_000)]
    assert run(spark, docs, ITEMS, k) == expected(docs, ITEMS, k)


def test_blocks_of_items(spark, monkeypatch):
    docs = corpus(2, 60)
    monkeypatch.setattr(ranked_search, "BLOCK_PAIRS", 3)
    pairs = ranked_search.item_terms(spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text")
    assert len(ranked_search.blocks(pairs)) > 2
    assert run(spark, docs, ITEMS) == expected(docs, ITEMS)


def test_sums_beyond_exact_doubles(spark, monkeypatch):
    docs = corpus(3, 60)
    monkeypatch.setattr(ranked_search, "EXACT", 0)
    assert run(spark, docs, ITEMS) == expected(docs, ITEMS)


def test_empty_tables(spark):
    assert run(spark, [(1, "w1")], []) == []
    assert run(spark, [], ITEMS) == []
