"""Quality classifier on supervised subword embeddings.

A text is the bag of its white-space separated words, the character n-grams of every word between
boundary marks, and its pairs of neighbouring words. Each of these is hashed to one of ``BUCKETS``
learned vectors; the document is their average, and a softmax over it gives the class. Vectors
and output weights are fitted together by stochastic gradient descent in numpy.

The fit uses a bounded sample of labelled rows: the ``rows`` pairs of id and text with the smallest
hash of their id among those of at most ``max_chars`` characters. Their hashed feature counts, four
bytes for a feature and a few tens of megabytes in all, meet in one task that trains; the driver
gets the finished model, one number a bucket.
Scoring covers every row and whole texts. As averaging and the output are linear, each bucket
contributes one number to the log-odds, and each distinct word is hashed once per worker while it
stays in a bounded cache.

Defined results: a null text counts as empty and an empty one gets the prior's score; rows without a
label, or with a null or other label than 0 and 1, teach nothing; a repeated row teaches once, an id
with several texts once with each; without any label the score is 0.5 everywhere, with one class near it; an empty
table gives no rows; further columns, whatever their names, are never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tapeweave.llm.common import field_sql, text_or_empty

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
CACHED = 250_000  # words per worker
THRESHOLD = 0.3
#: Features without a vector that every text is taken to have, so that a few words alone decide little.
BLANK = 16
MIX = np.uint64(0x9E3779B97F4A7C15)
SAME = 0  # bucket of a word that repeats its neighbour


@dataclass(frozen=True)
class Training:
    rows: int = 4000
    max_chars: int = 20_000
    dim: int = 16
    steps: int = 32_000
    rate: float = 0.5
    seed: int = 7


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def _bucket(h: np.ndarray) -> np.ndarray:
    return 1 + (_mixed(h) % np.uint64(BUCKETS - 1)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of distinct words: (word index, bucket) per feature, and one hash per word."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(marked)), sizes)
    with np.errstate(over="ignore"):
        # the whole word: a sum of codes mixed with their place in it
        place = (np.arange(len(codes)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
        whole = np.add.reduceat(_mixed(codes + place * np.uint64(0x100000001B3) + np.uint64(1)), ends - sizes)
        owners, buckets = [np.arange(len(marked))], [_bucket(whole)]
        for n in GRAMS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                h = (h + codes[j : len(codes) - n + 1 + j]) * MIX
                h ^= h >> np.uint64(32)
            inside = owner[: len(h)] == owner[n - 1 :]
            owners.append(owner[: len(h)][inside])
            buckets.append(_bucket(h[inside]))
    return np.concatenate(owners), np.concatenate(buckets), whole


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; a repeated word has a bucket of its own."""
    with np.errstate(over="ignore"):
        out = _bucket(hashes[:-1] * np.uint64(3) + _mixed(hashes[1:]))
    out[hashes[:-1] == hashes[1:]] = SAME
    return out


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    distinct, back, times = np.unique(np.array(words, dtype=object), return_inverse=True, return_counts=True)
    owner, bucket, whole = word_features(distinct.tolist())
    total = np.bincount(bucket, weights=times[owner], minlength=BUCKETS)
    total += np.bincount(pair_buckets(whole[back]), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found].astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Per bucket its part of the log-odds of class 1, and the constant part."""

    parts: np.ndarray
    constant: float

    def odds(self, total: float, n: float) -> float:
        return self.constant + total / (n + BLANK)


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], how: Training) -> Model:
    """Softmax over averaged bucket vectors, by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(how.seed)
    vectors = rng.uniform(-1 / how.dim, 1 / how.dim, (BUCKETS, how.dim))
    out, bias = np.zeros((how.dim, 2)), np.zeros(2)
    done = 0
    while bags and done < how.steps:
        for i in rng.permutation(len(bags))[: how.steps - done]:
            at, times, label = bags[i]
            rate = how.rate * (1 - done / how.steps)
            done += 1
            weight = times / (times.sum() + BLANK)
            hidden = weight @ vectors[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            # the rate of a vector grows with the bag, as every one of its members has a share
            vectors[at] -= rate * len(at) ** 0.5 * np.outer(weight, back)
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


class Scorer:
    """Log-odds of whole texts; words seen before are looked up."""

    def __init__(self, model: Model, limit: int = CACHED):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.part, self.size, self.hash = np.zeros(1024), np.zeros(1024), np.zeros(1024, dtype=np.uint64)

    def learn(self, words: list[str]) -> None:
        known = len(self.index)
        need = known + len(words)
        if need > len(self.part):
            grow = max(need, 2 * len(self.part))
            self.part, self.size, self.hash = (np.resize(a, grow) for a in (self.part, self.size, self.hash))
        owner, bucket, whole = word_features(words)
        here = slice(known, need)
        self.part[here] = np.bincount(owner, weights=self.model.parts[bucket], minlength=len(words))
        self.size[here] = np.bincount(owner, minlength=len(words))
        self.hash[here] = whole
        self.index.update(zip(words, range(known, need)))

    def score(self, text: str) -> float:
        words = text.split()
        total = n = 0.0
        if words:
            new = set(words).difference(self.index)
            if len(self.index) + len(new) > self.limit:
                self.clear()
                new = set(words)
            if new:
                self.learn(sorted(new))
            at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
            pairs = pair_buckets(self.hash[at])
            total = float(self.part[at].sum() + self.model.parts[pairs].sum())
            n = float(self.size[at].sum() + len(pairs))
        return float(1 / (1 + np.exp(-self.model.odds(total, n))))


def sample(docs: DataFrame, labels: DataFrame, how: Training, id_col: str, text_col: str, label_col: str, usable: Column) -> DataFrame:
    """(label, text) of the training sample: ``how.rows`` pairs of id and text at the most."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label"))
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    source = source.where(F.length("text") <= how.max_chars).withColumn("h", F.xxhash64("text"))
    once = source.select("doc_id", "h").where(usable).distinct().join(marked, "doc_id")
    chosen = once.orderBy(F.xxhash64("doc_id", F.lit(how.seed)), "doc_id", "h").limit(how.rows)
    # bound: how.rows rows; copies of a row are one again behind the join
    texts = source.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    return texts.select("label", "text")


def small_ints(values: np.ndarray) -> bytes:
    return values.astype("<u2" if values.max(initial=0) < 1 << 16 else "<u4").tobytes()


def ints(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def features(texts: DataFrame) -> DataFrame:
    """(label, at, times): feature counts as packed integers, two bytes each (four where a count needs them)."""

    def run(batches):
        for batch in batches:
            bags = [counts(t.as_py()) for t in batch.column(1)]
            arrays = [pa.array([small_ints(b[k]) for b in bags], type=pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *arrays], names=["label", "at", "times"])

    return texts.select("label", "text").mapInArrow(run, T.StructType.fromDDL("label int, at binary, times binary"))


@lru_cache(maxsize=1)
def _scorer(parts: bytes, constant: float) -> Scorer:
    return Scorer(Model(np.frombuffer(parts), constant))


def fit(
    docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", usable: Column | None = None,
) -> Model:
    """Model from the labelled rows for which ``usable``, a condition on ``doc_id``, holds."""
    texts = sample(docs, labels, how, id_col, text_col, label_col, F.lit(True) if usable is None else usable)

    def run(batches):
        bags = []
        for batch in batches:
            for label, at, times in zip(*(batch.column(i).to_pylist() for i in range(3))):
                bags.append((ints(at, len(at) // 2), ints(times, len(at) // 2), label))
        # the sample's order differs between runs
        bags.sort(key=lambda b: (b[2], len(b[0]), zlib.crc32(b[0].tobytes()), zlib.crc32(b[1].tobytes()), b[0][:16].tobytes()))
        model = train(bags, how)
        yield pa.RecordBatch.from_arrays([pa.array([model.parts.tobytes()], pa.binary()), pa.array([model.constant])], names=["parts", "constant"])

    row = features(texts).repartition(1).mapInArrow(run, T.StructType.fromDDL("parts binary, constant double")).first()
    return train([], how) if row is None else Model(np.frombuffer(row["parts"]), row["constant"])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    parts, constant = model.parts.tobytes(), model.constant
    schema = T.StructType([field_sql(docs, id_col, "doc_id"), T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = _scorer(parts, constant)
        for batch in batches:
            found = pa.array([scorer.score(t.as_py()) for t in batch.column(1)], type=pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score under ``threshold``; nothing is shuffled."""
    parts, constant, at = model.parts.tobytes(), model.constant, docs.columns.index(text_col)

    def run(batches):
        scorer = _scorer(parts, constant)
        for batch in batches:
            keep = [scorer.score(t.as_py() or "") >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
