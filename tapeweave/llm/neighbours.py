"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations (iterative quantization): a bounded sample is
centred, rotated so that its signs lose least, and several such rotations are joined into a code of
``BITS`` bits. A code is split into substrings of eight bits, each with an index of its own. A
code within ``radius`` differing bits of the query differs in at most radius // m bits in some of
the m substrings (the first radius % m + 1 of them suffice at that bound, the others at one
less), so probing the buckets within those bounds retrieves every code within the radius. What is
retrieved is reranked by the cosine of the original vectors in double precision.

The radius is the smallest at which a sample's true neighbours are found in the wanted share.
Queries that find fewer than ``k`` rows are searched again with every bit allowed to differ, which
visits all rows, so none comes back short.

Equal vectors are one class, searched once; a class keeps its k + 1 smallest ids, which is all a
list of k can show of it, so copies in any number cost nothing. Classes are dealt into shards of
``SHARD`` and query classes into blocks of ``BLOCK``; a task holds one of each, and the lists of the
shards are merged by a window that keeps the best on the way. Work grows as queries times rows:
the codes of vectors without structure have nothing to prune by, and a query set that grows with
the table is compared to all of it.

Vectors may be of any finite length: each is scaled by a power of two first, which leaves its cosines as they are.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components are neither found nor answered; rows with a null id likewise; ties go to
the smaller id; a row given twice under one id counts once; fewer than k other rows give all
of them; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeweave.llm.common import cut_lineage

BITS = 128
SAMPLE = 4000
RECALL = 0.98
SHARD = 8192
BLOCK = 2048
SEED = 11


def rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Orthogonal matrix that moves the rows of ``x`` towards the corners of a cube."""
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r), full_matrices=False)
        r = u @ vt
    return r


@dataclass(frozen=True)
class Coder:
    centre: np.ndarray
    planes: np.ndarray  # dimension x bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows of bytes, eight bits each."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.centre) @ self.planes > 0, axis=1)


def fit_coder(sample: np.ndarray, bits: int = BITS) -> Coder:
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.mean(axis=0)
    rng = np.random.default_rng(SEED)
    turns = -(-bits // sample.shape[1])
    return Coder(centre, np.hstack([rotation(unit - centre, rng) for _ in range(turns)])[:, :bits])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of ``a`` and every row of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for x, y in zip(a.T, b.T):
        out += np.bitwise_count(x[:, None] ^ y[None, :])
    return out


def fit_radius(sample: np.ndarray, coder: Coder, k: int, recall: float = RECALL, asked: int = 200) -> int:
    """Smallest radius within which ``recall`` of the true neighbours of some sample rows lie.

    Neighbours are nearer in the whole table than in its sample, so the radius is on the safe side.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    few = unit[:asked]
    near = few @ unit.T
    near[np.arange(len(few)), np.arange(len(few))] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, len(unit) - 1)]
    if best.size == 0:
        return coder.planes.shape[1]
    codes = coder.codes(sample)
    found = np.take_along_axis(distances(codes[:asked], codes), best, axis=1)
    return int(np.quantile(found, recall, method="higher"))


class Index:
    """One index per byte of the code: the rows in each bucket, as ranges of one sorted order."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.orders = [np.argsort(column, kind="stable") for column in codes.T]
        self.sizes = [np.bincount(column, minlength=256) for column in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        bound, more = divmod(radius, len(code))
        met = np.zeros(len(self.codes), dtype=bool)
        values = np.arange(256, dtype=np.uint8)
        for i, byte in enumerate(code):
            reach = bound if i <= more else bound - 1
            if reach < 0:
                break
            probed = np.bitwise_count(values ^ byte) <= reach
            met[self.orders[i][np.repeat(probed, self.sizes[i])]] = True
        return self.verified(code, np.flatnonzero(met), radius)

    def verified(self, code: np.ndarray, rows: np.ndarray, radius: int) -> np.ndarray:
        apart = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.uint16)
        return rows[apart <= radius]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")) & ~F.isnan(x), F.lit(False)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component between 1/2 and 1: no square overflows, no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _matrix(column: pd.Series) -> np.ndarray:
    return scaled(np.stack(column.to_numpy()).astype(np.float64))


def _search(classes: DataFrame, queries: DataFrame, coder: Coder, radius: int, k: int, shards: int, blocks: int) -> DataFrame:
    """(q, ids, score): per shard and query the best k + 1 classes within the radius."""
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vector", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "ids": [], "score": []}
        if len(rows) and len(asks):
            x, y = _matrix(rows["vector"]), _matrix(asks["vector"])
            sizes, ids = np.sqrt((x * x).sum(axis=1)), rows["ids"].to_numpy()
            index = Index(coder.codes(x))
            for q, v, code in zip(asks["q"].tolist(), y, coder.codes(y)):
                at = index.within(code, radius)
                if not len(at):
                    continue
                score = (x[at] * v).sum(axis=1) / (sizes[at] * np.sqrt((v * v).sum()))
                if len(at) > k + 1:  # ties at the end stay, their ids decide later
                    least = np.partition(score, -(k + 1))[-(k + 1)]
                    at, score = at[score >= least], score[score >= least]
                out["q"] += [q] * len(at)
                out["ids"] += [ids[i].tolist() for i in at]
                out["score"] += score.tolist()
        return pd.DataFrame({"q": np.array(out["q"], dtype=np.int64), "ids": pd.Series(out["ids"], dtype=object), "score": np.array(out["score"], dtype=float)})

    return dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(
        run, "q long, ids array<long>, score double"
    )


def _best(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` best (q, vec_id, score) per query."""
    rows = found.select("q", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n).drop("at")


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    bits: int = BITS, sample_rows: int = SAMPLE, recall: float = RECALL, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of every row for which ``is_query``, a condition on ``vec_id``, holds."""
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    common = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    vectors = vectors.where(F.size("vector") == common["d"])

    order = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.withColumn("at", F.dense_rank().over(order)).where(F.col("at") <= k + 1)
    classes = cut_lineage(few.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    asking = vectors.where(is_query).distinct()
    queries = cut_lineage(asking.groupBy("vector").agg(F.min("vec_id").alias("q")))

    picked = classes.orderBy(F.xxhash64("vector", F.lit(SEED)), "ids").limit(sample_rows).select("vector").toArrow()
    flat = picked.column("vector").combine_chunks().flatten().to_numpy()
    sample = scaled(flat.reshape(-1, common["d"]))
    coder = fit_coder(sample, bits)
    shards = max(1, -(-classes.count() // shard))
    blocks = max(1, -(-queries.count() // block))

    found = cut_lineage(_best(_search(classes, queries, coder, fit_radius(sample, coder, k, recall), k, shards, blocks), k + 1))
    full = found.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    short = cut_lineage(queries.join(full, "q", "left_anti"))
    if not short.isEmpty():
        blocks = max(1, -(-short.count() // block))
        more = _best(_search(classes, short, coder, bits, k, shards, blocks), k + 1)
        found = found.join(full, "q", "left_semi").unionByName(more)

    answers = asking.join(queries, "vector").select(F.col("vec_id").alias("query_id"), "q")
    lists = answers.join(found, "q").where("vec_id <> query_id")
    lists = lists.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
