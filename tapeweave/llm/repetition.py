"""Quality rules on repetition: suffix arrays over the words of each text.

Words are runs of characters that are not ASCII white space, compared as they are. The suffixes of
a text's words are sorted by prefix doubling, many texts in one numpy sort, with the text as the
first sort key. Longest common prefixes of neighbouring suffixes follow from the doubling's own
ranks. Every LCP interval whose occurrences are not all preceded by the same word is a maximal
repeated passage; the union of all their spans is the covered part of a text.

A text is rejected when passages of at least ``PASSAGE`` words that repeat inside it cover more than
``COVERED`` of its words, or its longest repeat has more than ``LONGEST`` words, and always by the
base rules (fewer than ``WORDS`` words, or repeated three-word windows over more than half of them).

A null text is an empty one: it has no words and is rejected by the base rule. Texts of any length are taken whole; a
batch closes at ``BATCH_WORDS`` words or with the one text that has more. Overlapping occurrences count. Rows are
judged alone, so repeated rows and null ids get results of their own; an empty table gives no rows. Columns named like
results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tapeweave.llm.common import map_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WORDS, WINDOW = 50, 3
PASSAGE, COVERED, LONGEST = 10, 0.3, 50
BATCH_WORDS = 400_000

RESULTS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("n_covered", "long"), ("longest_repeat", "long"), ("n_passages", "long"), ("base_failed", "boolean"), ("kept", "boolean"),
)


def suffix_order(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions sorted by (text, suffix), and the rank of every position by its first 1, 2, 4, ... words.

    Equal ranks at a level mean equal words in full, as a suffix that ends earlier has a rank of its own.
    """
    n = len(words)
    key = text.astype(np.int64) << 32 | words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    levels, width = [rank.astype(np.int32)], 1
    ends = np.flatnonzero(np.r_[text[1:] != text[:-1], True])[text]  # last position of each position's text
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank[order]] > 1)  # places in the order that still tie
        if not len(open_):
            return order, levels
        at = order[open_]
        next_ = at + width
        then = np.where(next_ <= ends[at], rank[np.minimum(next_, n - 1)] + 1, 0)
        resort = np.lexsort((then, rank[at]))
        at, then = at[resort], then[resort]
        order[open_] = at
        group = rank[at]
        new_run = np.r_[True, (group[1:] != group[:-1]) | (then[1:] != then[:-1])]
        rank = rank.copy()
        starts = np.flatnonzero(new_run)
        rank[at] = np.repeat(open_[starts], np.diff(np.r_[starts, len(at)]))
        levels.append(rank.astype(np.int32))
        width *= 2


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in the order with the one before it, in words."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    live = np.flatnonzero(text[a] == text[b])
    a, b = a[live], b[live]
    common = np.zeros(len(live), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank, step = levels[level], 1 << level
        inside = (a < n) & (b < n)
        ia, ib = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = inside & (rank[ia] == rank[ib])
        common += same * step
        a += same * step
        b += same * step
    lcp[live + 1] = common
    return lcp


def passages(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(words, first, last) of every LCP interval of at least ``least`` words that can't be extended to the left.

    first and last are places in the order; ``before`` holds the word ahead of each position, a value of its own at starts.
    """
    left = np.cumsum(np.r_[0, before[order[1:]] != before[order[:-1]]])
    long = np.flatnonzero(lcp >= least)
    if not len(long):
        return
    for run in np.split(long, np.flatnonzero(np.diff(long) > 1) + 1):
        stack: list[tuple[int, int]] = []
        values = lcp[run].tolist() + [least - 1]
        for i, value in enumerate(values, int(run[0])):
            start = i - 1
            while stack and stack[-1][0] > value:
                length, start = stack.pop()
                if left[i - 1] > left[start]:
                    yield length, start, i - 1
            if value >= least and (not stack or stack[-1][0] < value):
                stack.append((value, start))


def covered(repeat: np.ndarray, text: np.ndarray, n_texts: int, least: int) -> np.ndarray:
    """Words per text inside the union of the spans [p, p + repeat[p]) with repeats of at least ``least`` words."""
    at = np.flatnonzero(repeat >= least)
    change = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + repeat[at], -1)
    return np.bincount(text[np.cumsum(change[:-1]) > 0], minlength=n_texts)


def repetition(texts: list[list[str]], least: int = PASSAGE) -> dict[str, np.ndarray]:
    """Figures per word list: words in repeated windows and passages, longest repeat, maximal passages."""
    sizes = np.array([len(w) for w in texts], np.int64)
    empty = np.zeros(len(texts), np.int64)
    if not sizes.sum():
        return {"n_repeat_words": empty, "n_covered": empty, "longest_repeat": empty, "n_passages": empty}
    number: dict[str, int] = {}
    words = np.array([number.setdefault(w, len(number)) for ws in texts for w in ws], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    compact = np.repeat(np.arange(int((sizes > 0).sum())), sizes[sizes > 0])
    order, levels = suffix_order(words, compact)
    lcp = neighbour_prefixes(order, levels, compact)
    repeat = np.empty(len(words), np.int64)
    repeat[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    longest = empty.copy()
    np.maximum.at(longest, text, repeat)
    before = np.r_[-1, words[:-1]]
    start = np.r_[True, text[1:] != text[:-1]]
    before[start] = -1 - np.arange(int(start.sum()))
    owners = [text[order[first]] for _, first, _ in passages(order, lcp, before, least)]
    return {
        "n_repeat_words": covered(repeat, text, len(texts), WINDOW), "n_covered": covered(repeat, text, len(texts), least),
        "longest_repeat": longest, "n_passages": np.bincount(np.array(owners, np.int64), minlength=len(texts)),
    }


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def judge(texts: list[str]) -> dict[str, np.ndarray]:
    """All figures and verdicts of some texts."""
    split = [WORD.findall(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    out = {
        "n_words": n,
        "word_chars": np.array([sum(map(len, w)) for w in split], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
    } | repetition(split)
    out["base_failed"] = (n < WORDS) | (100 * out["n_repeat_words"] > 50 * n)
    out["kept"] = ~(out["base_failed"] | (out["n_covered"] > COVERED * n) | (out["longest_repeat"] > LONGEST))
    return out


def _blocks(texts: list[str], words: int) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        if block and size + len(t) // 2 > words:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t) // 2 + 1  # no text has more words
    if block:
        yield block


def score(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its texts, with the columns of ``RESULTS``."""
    carried = [c for c in docs.columns if c not in dict(RESULTS) and c != text_col]
    schema = T.StructType(
        [T.StructField(c, docs.schema[c].dataType) for c in carried] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in RESULTS]
    )
    batch_words = BATCH_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(carried)).to_pylist()]
            done = 0
            for block in _blocks(texts, batch_words):
                found = judge(block)
                rows = batch.slice(done, len(block))
                done += len(block)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(i) for i in range(len(carried))] + [pa.array(found[n]) for n, _ in RESULTS],
                    names=carried + [n for n, _ in RESULTS],
                )

    return map_batches(docs.select(*carried, docs[text_col].cast("string").alias("__text")), run, schema)
