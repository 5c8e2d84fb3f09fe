"""Ranked lexical search, reversed: the items are indexed, the documents pass by.

The terms of a block of items form an inverted index that is broadcast. One pass over the documents counts, per task, the
documents that hold each of these terms, all documents with a term, and all terms. A second pass weighs every document's
term counts through the index and updates one bounded heap per item; the heaps of all tasks are merged in two steps, by
(item, part) and by item. So no document is shuffled, and what leaves a task is at most ``k`` rows an item.

A block holds at most ``BLOCK_PAIRS`` (item, term) pairs and ``BLOCK_BYTES`` bytes of terms, or the one item that has more;
more items mean more blocks, each with its passes.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Scores are integers, see ``search``.

Null and empty texts have no terms: such documents don't count and are never found, such items have no rows. Texts are
taken whole. Rows of one item id are one item with all their terms; a null item id is an id like others. Each row of
documents is ranked on its own, so repeated rows take a place each; equal scores go by document id, null ids last.
Empty tables give no rows. Other columns are never looked at.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tapeweave.llm.common import field_sql, map_batches

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK_PAIRS, BLOCK_BYTES = 1_000_000, 32_000_000
PARTS = 64  # first merge of heaps
EXACT = 1 << 53
DOCUMENTS, LENGTH = -1, -2  # keys of the totals beside the terms'


def terms(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.lower()) if text else []  # bytes.lower() knows ASCII alone


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term) without repeats; terms as UTF-8 bytes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(terms(t))) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([t for f in found for t in f], pa.binary())], ["item", "term"]
            )

    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(rows, split, T.StructType([field_sql(items, item_col, "item"), T.StructField("term", T.BinaryType())])).distinct()


def blocks(pairs: DataFrame) -> list[DataFrame]:
    """``pairs`` in parts of bounded size, whole items each: twice as many parts until every one fits or is one item."""
    key = F.xxhash64("item")
    sizes = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.length("term")).alias("bytes"))
    n = 1
    while True:
        block = F.pmod(key, F.lit(n))
        over = sizes.groupBy(block.alias("block")).agg(
            F.sum("pairs").alias("pairs"), F.sum("bytes").alias("bytes"), F.count_distinct(key).alias("items")
        ).where((F.col("items") > 1) & ((F.col("pairs") > BLOCK_PAIRS) | (F.col("bytes") > BLOCK_BYTES)))
        if over.isEmpty():
            return [pairs.where(block == i) for i in range(n)]
        n *= 2


class Index:
    """Inverted index of one block's terms: term -> number, and per number the items that hold it."""

    def __init__(self, rows: list[tuple]):
        self.items = list(dict.fromkeys(item for item, _ in rows))
        place = {item: i for i, item in enumerate(self.items)}
        self.number: dict[bytes, int] = {}
        holders: list[list[int]] = []
        for item, term in rows:
            i = self.number.setdefault(bytes(term), len(self.number))
            if i == len(holders):
                holders.append([])
            holders[i].append(place[item])
        self.holders = [np.array(h, np.int64) for h in holders]
        self.size = np.array([len(h) for h in holders], np.int64)

    def weigh(self, totals: dict[int, int]) -> None:
        """Weights from the document frequencies in ``totals``."""
        self.documents, self.length = totals.get(DOCUMENTS, 0), totals.get(LENGTH, 0)
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * self.documents + 2) / (2 * totals.get(i, 0) + 1))) for i in range(len(self.number))],
            np.int64,
        )
        top = np.zeros(len(self.items))
        for weight, held in zip(self.weight.tolist(), self.holders):
            top[held] += abs(weight) * 1e6
        self.exact = float(top.max(initial=0)) < EXACT  # sums of doubles then stay whole numbers

    def scores(self, count: Counter[bytes], n: int) -> np.ndarray | None:
        """Scores of one document for all items; None if it holds no term of theirs."""
        both = count.keys() & self.number.keys()
        if not both:
            return None
        at = [self.number[t] for t in both]
        tf = np.array([count[t] for t in both], np.int64)
        norm = 10 + 90 * n * self.documents // self.length
        gain = self.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))
        held, gains = np.concatenate([self.holders[i] for i in at]), np.repeat(gain, self.size[at])
        if self.exact:
            return np.bincount(held, weights=gains, minlength=len(self.items)).astype(np.int64)
        out = np.zeros(len(self.items), np.int64)
        np.add.at(out, held, gains)
        return out


def totals(docs: DataFrame, index) -> dict[int, int]:
    """Documents that hold each term of the broadcast ``index``, documents with a term, and all terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sums = index.value.number, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms(text)
                if found:
                    sums[DOCUMENTS] += 1
                    sums[LENGTH] += len(found)
                    sums.update(map(number.__getitem__, number.keys() & set(found)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["key", "n"])

    return dict(tuple(r) for r in map_batches(docs.select("text"), count, T.StructType.fromDDL("key long, n long")).groupBy("key").agg(F.sum("n")).collect())


def best_of_tasks(docs: DataFrame, index, k: int, schema: T.StructType) -> DataFrame:
    """(item, id, score): the best ``k`` documents of each task for each item."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in known.items]  # larger is better: score, has an id, -id
        least = np.ones(len(heaps), np.int64)
        for batch in batches:
            for text, ident in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text)
                scores = known.scores(Counter(found), len(found)) if found else None
                if scores is None:
                    continue
                for i in np.flatnonzero(scores >= least).tolist():
                    entry, heap = (int(scores[i]), ident is not None, -(ident or 0)), heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        least[i] = heap[0][0]
        rows = [(known.items[i], -e[2] if e[1] else None, e[0]) for i, heap in enumerate(heaps) for e in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], item_type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            ["item", "id", "score"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(schema["item"].dataType)
    return map_batches(docs.select("text", "id"), stream, schema)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, id, score): each item's ``k`` documents of the highest score above 0.

    Ids of documents are integers. With N documents that have a term, L terms in all and n in the document, a term in df
    documents weighs floor(1000 ln((2N+2)/(2df+1))) and gives, where it comes tf times, that weight times
    10^9 tf div (1000 tf + 8 (10 + 90nN div L)).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"), F.col(id_col).cast("long").alias("id"))
    schema = T.StructType([field_sql(items, item_col, "item"), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    found = None
    for block in blocks(item_terms(items, item_col, item_text_col)):
        index = Index([tuple(r) for r in block.collect()])  # of the size checked in blocks()
        sent = spark.sparkContext.broadcast(index)
        index.weigh(totals(rows, sent))
        best = best_of_tasks(rows, spark.sparkContext.broadcast(index), k, schema)
        found = best if found is None else found.unionByName(best)
    order = (F.col("score").desc(), F.col("id").asc_nulls_last())
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    for keys in ([F.col("item"), part], [F.col("item")]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
