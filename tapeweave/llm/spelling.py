"""Spelling variants: words one edit apart, found with FM-indexes, and followed to the commonest form.

Words are maximal runs of Latin letters, lower-cased A-Z alone, of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT``
occurrences. Two words are near if one inserted, deleted or replaced code point turns one into the other. One edit leaves a
half of the word whole, so a search matches either half exactly and extends across the other half with one error:

* the search that starts with the first half reads words from the left, the one that starts with the second half from the
  right. Each direction has its own index; the second search keeps what differs in the first half, so no pair comes twice;
* an index covers the delimited words of a shard. All words that share a half are in one shard, so the number of shards
  grows with the vocabulary and their size doesn't. Halves with more than ``SHARD`` words are dealt over several shards,
  and their searches visit each of these;
* a search state is an interval of suffix ranks. numpy steps all states of a shard at once; counts of symbols are sampled
  every 16 ranks.

A word's form is its near word of the largest count (ties: the first in code-point order) if that is at least ``RATIO``
times its own; following forms ends at its root. Counts grow tenfold along such a chain, so pointer doubling needs a
number of joins that the largest count gives.

Null and empty texts hold no words; texts and words of any length are taken whole. A null id is an empty one for ``alter``.
Repeated rows count as often as they come. An empty table gives no rows. Other columns are never looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tapeweave.llm.common import cut_lineage, map_batches

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
SHARD = 16_000  # words of an index
KEPT = 200_000  # distinct words that a task counts before it hands them on
STEP = 16  # ranks between sampled counts
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

Alter = Callable[[str, str], str]


def word_counts(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", alter: Alter | None = None, least_length: int = LEAST_LENGTH
) -> DataFrame:
    """(word, n) over all texts, of words of at least ``least_length`` code points.

    ``alter`` turns (id as text, word) into the word to count; it must not make words longer.
    """
    runs, kept = re.compile(f"[{LETTERS}]{{{least_length},}}"), KEPT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run, n in Counter(runs.findall(text or "")).items():
                    word = run.translate(UPPER)
                    if alter is not None:
                        word = alter(ident or "", word)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) >= kept:
                    yield hand_on()
        if total:
            yield hand_on()

    parts = map_batches(docs.select(docs[id_col].cast("string"), docs[text_col].cast("string")), count, T.StructType.fromDDL("word string, n long"))
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Ranks:
    """FM-index of delimited words: intervals of suffix ranks, extended by one symbol to the left.

    Symbol 0 is the delimiter. The text is the cyclic sequence of all words in sorted order, so the ranks that start with
    the delimiter are in the order of the word behind it, and such a rank is the word's place in ``self.words``.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, symbols: int):
        """``codes`` holds the symbols (from 1) of distinct words, one after the other, each closed by a 0."""
        n, self.symbols = len(codes), symbols
        word = np.repeat(np.arange(len(sizes)), sizes + 1)
        ends = np.cumsum(sizes + 1) - 1
        rank = codes.astype(np.int64)
        width = 1
        while True:  # prefix doubling inside the words
            at = np.arange(n) + width
            then = np.where(at <= ends[word], rank[np.minimum(at, n - 1)] + 1, 0)
            order = np.lexsort((then, rank))
            new = np.r_[True, (np.diff(rank[order]) != 0) | (np.diff(then[order]) != 0)]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(new) - 1
            if width > int(sizes.max(initial=0)) or fresh.max() == rank.max() and width > 1:
                break
            rank, width = fresh, width * 2
        starts = ends - sizes
        self.words = np.argsort(fresh[starts], kind="stable")
        follows = np.empty(len(sizes), np.int64)
        follows[self.words] = (np.arange(len(sizes)) + 1) % max(len(sizes), 1)
        order = np.lexsort((follows[word], fresh))
        previous = np.r_[0, codes[:-1]]
        previous[starts] = 0
        self.last = previous[order].astype(np.int16)  # the symbol ahead of each suffix
        blocks = -(-n // STEP) + 1
        self.padded = np.full(blocks * STEP, -1, np.int16)
        self.padded[:n] = self.last
        self.padded = self.padded.reshape(blocks, STEP)
        inside = np.bincount(np.arange(n) // STEP * symbols + self.last, minlength=blocks * symbols).reshape(blocks, symbols)
        self.sampled = np.r_[np.zeros((1, symbols), np.int64), np.cumsum(inside, axis=0)].astype(np.int32)
        self.first = np.r_[0, np.cumsum(np.bincount(codes, minlength=symbols))].astype(np.int64)

    def step(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where the border ``rank`` of an interval goes when ``symbol`` is put in front."""
        block, rest = rank // STEP, rank % STEP
        near = (self.padded[block] == symbol[:, None]) & (np.arange(STEP) < rest[:, None])
        return self.first[symbol] + self.sampled[block, symbol] + near.sum(axis=1)

    def symbols_ahead(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) of what can stand in front of each interval; wide intervals name every symbol."""
        size = high - low
        narrow = np.flatnonzero(size <= self.symbols)
        state = np.repeat(narrow, size[narrow])
        place = np.arange(len(state)) - np.repeat(np.cumsum(size[narrow]) - size[narrow], size[narrow])
        key = np.unique(state * self.symbols + self.last[np.repeat(low[narrow], size[narrow]) + place])
        wide = np.flatnonzero(size > self.symbols)
        state = np.r_[key // self.symbols, np.repeat(wide, self.symbols)]
        return state, np.r_[key % self.symbols, np.tile(np.arange(self.symbols), len(wide))].astype(np.int64)


def near_words(words: list[str], indexed: np.ndarray, asked: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked word, indexed word), as places in ``words``, one edit apart and equal in the first ``halves`` code points."""
    if not indexed.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    alphabet, codes = np.unique(points, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    begin = np.cumsum(sizes) - sizes
    chosen = np.flatnonzero(indexed)
    # each indexed word backwards, so that putting a symbol in front reads the next one
    length = sizes[chosen]
    total = int((length + 1).sum())
    text = np.zeros(total, np.int64)
    opened = np.cumsum(length + 1) - (length + 1)
    offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(opened, length) + offset] = codes[np.repeat(begin[chosen] + length - 1, length) - offset]
    index = Ranks(text, length, len(alphabet) + 1)

    def read(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The symbol that word q has at place ``at``; the delimiter behind its end."""
        return np.where(at < sizes[q], codes[np.minimum(begin[q] + at, len(codes) - 1)], 0)

    def extend(q, at, low, high, symbol):
        low, high = index.step(symbol, low), index.step(symbol, high)
        some = high > low
        return q[some], at[some], low[some], high[some]

    q = np.flatnonzero(asked)
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(chosen), np.int64)
    at = np.zeros(len(q), np.int64)
    done_q, done_word = [], []
    open_ = [np.empty(0, np.int64)] * 4  # states with their error behind them
    while len(q) or len(open_[0]):
        if len(open_[0]):
            oq, oat, olow, ohigh = open_
            symbol = read(oq, oat)
            oq, oat, olow, ohigh = extend(oq, oat + 1, olow, ohigh, symbol)
            closed = oat > sizes[oq]
            done_q.append(oq[closed])
            done_word.append(olow[closed])
            open_ = [x[~closed] for x in (oq, oat, olow, ohigh)]
        if len(q):
            alone = (high - low == 1) & indexed[q]  # nothing but the word itself
            q, at, low, high = (x[~alone] for x in (q, at, low, high))
            behind = np.flatnonzero(at >= halves[q])
            bq, bat, blow, bhigh = q[behind], at[behind], low[behind], high[behind]
            left = bat < sizes[bq]
            states = [(bq[left], bat[left] + 1, blow[left], bhigh[left])]  # the word lacks a symbol
            state, symbol = index.symbols_ahead(blow, bhigh)
            real = symbol > 0
            state, symbol = state[real], symbol[real]
            sq, sat, slow, shigh = bq[state], bat[state], blow[state], bhigh[state]
            other = (sat < sizes[sq]) & (symbol != read(sq, sat))
            nlow, nhigh = index.step(symbol, slow), index.step(symbol, shigh)
            some = nhigh > nlow
            states.append((sq[some], sat[some], nlow[some], nhigh[some]))  # one more symbol
            some &= other
            states.append((sq[some], sat[some] + 1, nlow[some], nhigh[some]))  # another symbol
            open_ = [np.concatenate(x) for x in zip(open_, *states)]
            more = at < sizes[q]
            q, at, low, high = q[more], at[more], low[more], high[more]
            q, at, low, high = extend(q, at + 1, low, high, read(q, at))
    if not done_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, second = np.concatenate(done_q), chosen[index.words[np.concatenate(done_word)]]
    pairs = np.unique(np.stack([first, second], axis=1)[first != second], axis=0)
    return pairs[:, 0], pairs[:, 1]


def search_shard(side: str, words: list[str], n: np.ndarray, indexed: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, ...]:
    """(asked word, near words, place of the best or -1) of one shard; ``side`` is the half that is matched exactly."""
    sizes = np.array([len(w) for w in words], np.int64)
    if side == "first":
        q, v = near_words(words, indexed, asked, sizes // 2)
    else:
        q, v = near_words([w[::-1] for w in words], indexed, asked, sizes - sizes // 2)
        new = np.array([not words[b].startswith(words[a][: len(words[a]) // 2]) for a, b in zip(q.tolist(), v.tolist())], bool)
        q, v = q[new], v[new]
    rows = np.flatnonzero(asked)
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[v], -n[v], q))
    best = np.full(len(words), -1, np.int64)
    head = order[np.r_[True, np.diff(q[order]) != 0]] if len(q) else order
    best[q[head]] = v[head]
    return rows, np.bincount(q, minlength=len(words))[rows], best[rows]


def halves(words: DataFrame) -> DataFrame:
    """One row per word and half under which it is found: (side, key, word, n, asked).

    A word one edit away has a length of one less or more, so its halves end at one of two places.
    """
    m = F.length("word")

    def of(side: str, size, key, mine):
        return F.struct(F.lit(side).alias("side"), key.alias("key"), (size == mine).alias("asked"))

    short, long_ = F.floor((m - 1) / 2).cast("int"), F.floor((m + 1) / 2).cast("int")
    mine = F.floor(m / 2).cast("int")
    options = [of("first", s, F.substring(F.col("word"), F.lit(1), s), mine) for s in (short, long_)]
    options += [of("second", s, F.substring(F.col("word"), m - s + 1, s), m - mine) for s in (mine, mine + 1)]
    return words.select("word", "n", F.explode(F.array(*options)).alias("h")).select("h.side", "h.key", "word", "n", "h.asked")


def near_counts(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, best, best_n): near words of every word of (word, n), and the one of the largest count."""
    rows = halves(words)
    total = words.count()
    shards = max(1, math.ceil(2 * total / shard))
    crowded = cut_lineage(rows.groupBy("side", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > shard))
    parts = F.lit(1)
    n_crowded = crowded.count()
    if n_crowded:
        crowded = crowded.select("side", "key", F.ceil(F.col("size") / shard).cast("int").alias("parts"))
        rows = rows.join(F.broadcast(crowded) if n_crowded <= 100_000 else crowded, ["side", "key"], "left")
        parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    visits = F.when(F.col("asked"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    routed = rows.withColumn("own", own).withColumn("part", F.explode(visits))
    routed = routed.select(
        "side", F.pmod(F.xxhash64("side", "key", "part"), F.lit(shards)).alias("shard"), "word", "n", "asked",
        (F.col("part") == F.col("own")).alias("indexed"),
    )

    def search(key: tuple, table: pa.Table) -> pa.Table:
        known: dict[str, list] = {}
        for word, n, asked, indexed in zip(*(table.column(c).to_pylist() for c in ("word", "n", "asked", "indexed"))):
            row = known.setdefault(word, [n, False, False])
            row[1] |= asked
            row[2] |= indexed
        found, values = list(known), list(known.values())
        n = np.array([v[0] for v in values], np.int64)
        rows, near, best = search_shard(
            key[0].as_py(), found, n, np.array([v[2] for v in values], bool), np.array([v[1] for v in values], bool)
        )
        none = best < 0
        return pa.table({
            "word": pa.array([found[i] for i in rows], pa.string()), "n": pa.array(n[rows]), "n_near": pa.array(near, pa.int64()),
            "best": pa.array([None if b < 0 else found[b] for b in best], pa.string()),
            "best_n": pa.array(np.where(none, 0, n[best]), mask=none),
        })

    found = routed.groupBy("side", "shard").applyInArrow(search, "word string, n long, n_near long, best string, best_n long")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("word"))))
    merged = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n", "n_near", F.col("b.word").alias("best"), (-F.col("b.order")).alias("best_n"))


def variants(words: DataFrame, ratio: int = RATIO, least_count: int = LEAST_COUNT, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n) that occurs often enough."""
    words = cut_lineage(words.where(F.col("n") >= least_count))
    common = F.col("best_n") >= ratio * F.col("n")
    near = cut_lineage(
        near_counts(words, shard).select(
            "word", "n", "n_near", F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n")
        )
    )
    most = words.agg(F.max("n")).first()[0] or 1
    links = math.ceil(math.log(max(most, 2), ratio)) + 1  # no chain of forms is longer
    to = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links))):
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = cut_lineage(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return near.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))
