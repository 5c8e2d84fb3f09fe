import random
from collections import Counter

import numpy as np
import pytest

from tapeweave.llm import spelling
from tapeweave.llm.queries import mistyped


def near(a, b):
    """One insertion, deletion or replacement apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """{word: (n, n_near, form, form_n, root)} by comparing all pairs."""
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    out = {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [n, len(close), form, words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def vocabulary(seed, size, letters="abcé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters[: rng.choice((2, 3, 4))]) for _ in range(rng.randint(7, 10))) for _ in range(size)}
    return {w: rng.choice((1, 2, 3, 25, 30, 300, 4000)) for w in sorted(words)}


def found(words):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in words.collect()}


@pytest.mark.parametrize("shard", [spelling.SHARD, 40, 7])  # with 7 words most halves are crowded and dealt over shards
def test_variants_equal_comparing_all_pairs(spark, shard):
    counts = vocabulary(1, 400)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(table, shard=shard)) == plain(counts)


def test_each_search_finds_its_half(spark):
    for seed in range(25):
        words = list(vocabulary(seed, random.Random(seed).choice((1, 2, 60))))
        n = np.ones(len(words), np.int64)
        indexed = np.array([hash_ % 3 > 0 for hash_ in range(len(words))])
        asked = np.array([i % 4 > 0 for i in range(len(words))])
        first = spelling.search_shard("first", words, n, indexed, asked)
        second = spelling.search_shard("second", words, n, indexed, asked)
        for place, i in enumerate(first[0]):
            other = [v for v, here in zip(words, indexed) if here and near(words[i], v)]
            assert first[1][place] == sum(v.startswith(words[i][: len(words[i]) // 2]) for v in other)
            assert first[1][place] + second[1][place] == len(other)


def test_ranks_are_intervals_of_sorted_suffixes():
    words = ["abab", "ab", "b", "aab"]
    codes = np.concatenate([[{"a": 1, "b": 2}[c] for c in w] + [0] for w in words]).astype(np.int64)
    index = spelling.Ranks(codes, np.array([len(w) for w in words]), 3)
    assert [words[i] for i in index.words] == sorted(words)
    for pattern in ("a", "b", "ab", "ba", "aba", "bb", "abab"):
        low, high = np.array([0]), np.array([len(codes)])
        for c in reversed(pattern):
            symbol = np.array([{"a": 1, "b": 2}[c]])
            low, high = index.step(symbol, low), index.step(symbol, high)
        count = sum(w.startswith(pattern, i) for w in words for i in range(len(w)))
        assert max(0, int(high[0] - low[0])) == count


def test_chains_lead_to_the_last_form(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "zzzzzzz": 5, "longest" * 3000: 3, "longest" * 3000 + "s": 30}
    got = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain(counts)
    assert got["aaaaaaa"][4] == "aaabbbb" and got["longest" * 3000][2] == "longest" * 3000 + "s"


def test_counts_over_awkward_texts(spark):
    texts = [
        (1, "Éclairs ÉCLAIRS eclairs, Running-running RUNNING!"), (2, None), (3, ""), (None, "running runnings"), (1, "x" * 50_000),
        (1, "Éclairs ÉCLAIRS eclairs, Running-running RUNNING!"), (4, "short words only"), (5, "naïveté×naïveté"),
    ]
    docs = spark.createDataFrame([(i, t, 7, "w") for i, t in texts], "doc_id long, text string, n int, word string")
    runs = spelling.re.compile("[A-Za-zÀ-ÿ]+")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for alter in (None, mistyped):
        expected = Counter()
        for ident, text in texts:
            for run in runs.findall(text or ""):
                word = run.translate(upper)
                expected[alter("" if ident is None else str(ident), word) if alter else word] += 1
        got = {r["word"]: r["n"] for r in spelling.word_counts(docs, alter=alter).collect()}
        assert got == {w: n for w, n in expected.items() if len(w) >= 7}
    assert spelling.variants(spelling.word_counts(docs.limit(0))).collect() == []


def test_a_document_in_31_loses_a_letter():
    changed = [d for d in range(3100) if mistyped(str(d), "spelling") != "spelling"]
    assert 60 < len(changed) < 140 and all(len(mistyped(str(d), "spelling")) == 7 for d in changed)
