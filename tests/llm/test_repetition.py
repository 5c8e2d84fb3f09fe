import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from tapeweave.llm import repetition


def plain(words, least):
    """(words in repeated windows, words in passages, longest repeat, maximal passages), by counting every window."""
    n, longest = len(words), 0
    places = {}
    for size in range(1, n):
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        if not any(len(p) > 1 for w, p in places.items() if len(w) == size):
            break
        longest = size

    def inside(size):
        count = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        return len({j for i in range(n - size + 1) if count[tuple(words[i : i + size])] > 1 for j in range(i, i + size)})

    maximal = 0
    for window, at in places.items():
        if len(window) >= least and len(at) > 1:
            left = {words[i - 1] if i else None for i in at}
            right = {words[i + len(window)] if i + len(window) < n else None for i in at}
            maximal += len(left) > 1 and len(right) > 1
    return inside(repetition.WINDOW), inside(least), longest, maximal


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=5), st.integers(2, 6))
def test_figures_equal_counting_every_window(texts, least):
    found = repetition.repetition(texts, least)
    for i, words in enumerate(texts):
        got = tuple(int(found[k][i]) for k in ("n_repeat_words", "n_covered", "longest_repeat", "n_passages"))
        assert got == plain(words, least)


def test_suffixes_come_in_order_within_each_text():
    rng = random.Random(3)
    words = np.array([rng.randrange(3) for _ in range(200)], np.int64)
    text = np.repeat(np.arange(4), 50)
    order, levels = repetition.suffix_order(words, text)
    suffixes = [tuple(words[p : (text[p] + 1) * 50]) for p in order]
    assert [text[p] for p in order] == sorted(text)
    assert all(suffixes[i] < suffixes[i + 1] for i in range(199) if text[order[i]] == text[order[i + 1]])
    lcp = repetition.neighbour_prefixes(order, levels, text)
    for i in range(1, 200):
        same = 0
        while text[order[i]] == text[order[i - 1]] and suffixes[i][:same + 1] == suffixes[i - 1][:same + 1] and same < min(len(suffixes[i]), len(suffixes[i - 1])):
            same += 1
        assert lcp[i] == same


def words_of(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_verdicts_and_awkward_rows(spark):
    clean, passage = words_of(300, 1), words_of(60, 2)
    texts = {
        1: " ".join(clean), 2: None, 3: "", 4: " \t\n", 5: " ".join(clean[:49]), 6: " ".join(clean[:50]),
        7: " ".join(clean + passage + words_of(20, 3) + passage),  # one long repeat, little of the text
        8: " ".join((words_of(12, 4) + words_of(2, 5)) * 1 + words_of(30, 6) + words_of(12, 4) + words_of(12, 4)),
        9: " ".join(["spam"] * 5000), 10: "x" * 300_000 + " " + " ".join(words_of(30_000, 7)),
        11: "a # b $\na # b $\n\n\nä ü\nlast", None: " ".join(clean),
    }
    rows = [(k, t, 5, "y") for k, t in texts.items()] + [(1, texts[1], 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept_not string")
    got = {}
    for r in repetition.score(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[1]) == 2 and got[1][0]["kept"] and got[None][0]["kept"] and got[6][0]["kept"] and got[10][0]["kept"]
    assert all(got[i][0]["base_failed"] and not got[i][0]["kept"] for i in (2, 3, 4, 5, 9))
    assert got[7][0]["longest_repeat"] == 60 and not got[7][0]["base_failed"] and not got[7][0]["kept"]
    assert got[8][0]["n_covered"] == 36 and not got[8][0]["kept"]
    assert got[9][0]["longest_repeat"] == 4999 and got[9][0]["n_repeat_words"] == 5000
    assert got[10][0]["n_words"] == 30_001 and got[10][0]["word_chars"] == 300_000 + 180_000
    last = got[11][0]
    assert (last["n_words"], last["n_symbols"], last["n_dup_lines"], last["word_chars"]) == (11, 4, 1, 14)
    assert "kept_not" in docs.columns and repetition.score(docs).columns.count("n_words") == 1
    assert repetition.score(docs.limit(0)).collect() == []


def test_blocks_do_not_change_results():
    texts = [" ".join(random.Random(i).choices("abcd", k=80)) for i in range(20)]
    whole = repetition.judge(texts)
    parts = [repetition.judge(b) for b in repetition._blocks(texts, 100)]
    assert len(parts) > 5
    for name, values in whole.items():
        assert (np.concatenate([p[name] for p in parts]) == values).all()
