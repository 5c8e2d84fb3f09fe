"""Bounded-space online packing of token ids into fixed windows.

Every partition keeps at most ``open_windows`` unfinished windows. A document's full windows go out
directly; its rest goes to the open window that it fits most tightly. When it fits none and no
further window may be opened, the fullest open window is topped up with the head of the rest and
emitted, so emitted windows carry no padding. Windows still open at the end of a partition are
leftovers: they are gathered over groups of partitions and filled one after the other, which leaves
one open window a group; these are gathered again until one group is left. Its last window alone is
cut into sequences whose lengths are powers of two, which need no padding: 11 of them at the most.

Defined results: a null text counts as empty, and an empty text is the single end id; repeated
rows are packed as often as they come; a null id is carried as null; an empty table gives no
rows; further columns of the input are ignored. Sequences differ between runs only if the rows
of the partitions do. Memory per task is ``open_windows`` windows and one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tapeweave.llm.common import cut_lineage, field_sql, text_or_empty
from tapeweave.llm.tokens import chunk_cache

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
GATHER = 16  # partitions whose leftovers meet in one task
MERGED = 1 << 62  # sequence ids of merged leftovers start here
PER_ROUND = 1 << 56  # sequence ids that a round of merging may give
PER_TASK = 1 << 36  # sequence ids that a task may give


class Windows:
    """Open windows; a piece is (doc id, start, ids as bytes, tokens of the document)."""

    def __init__(self, window: int, slots: int, first_id: int):
        self.window, self.slots, self.next_id = window, slots, first_id
        self.open: list[list] = []  # [space left, pieces]

    def emit(self, pieces: list[tuple]) -> tuple[int, list[tuple]]:
        self.next_id += 1
        return self.next_id - 1, pieces

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple[int, list[tuple]]]:
        size = self.window * 4
        while len(ids) >= size:
            yield self.emit([(doc, start, ids[:size], total)])
            start, ids = start + self.window, ids[size:]
        if not ids:
            return
        need = len(ids) // 4
        fits = [w for w in self.open if w[0] >= need]
        if fits:
            best = min(fits, key=lambda w: w[0])
            best[0] -= need
            best[1].append((doc, start, ids, total))
            if best[0] == 0:
                self.open.remove(best)
                yield self.emit(best[1])
            return
        if len(self.open) >= self.slots:
            fullest = min(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            head = fullest[0]
            fullest[1].append((doc, start, ids[: head * 4], total))
            yield self.emit(fullest[1])
            start, ids, need = start + head, ids[head * 4 :], need - head
        self.open.append([self.window - need, [(doc, start, ids, total)]])

    def leftovers(self) -> Iterator[tuple[int, list[tuple]]]:
        for _, pieces in self.open:
            yield self.emit(pieces)
        self.open = []


def powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Cut a window's pieces into runs whose lengths are powers of two, largest first."""
    filled = sum(len(p[2]) for p in pieces) // 4
    rest = list(reversed(pieces))
    while filled:
        room = 1 << (filled.bit_length() - 1)
        filled -= room
        run = []
        while room:
            doc, start, ids, total = rest.pop()
            take = min(room, len(ids) // 4)
            run.append((doc, start, ids[: take * 4], total))
            if take * 4 < len(ids):
                rest.append((doc, start + take, ids[take * 4 :], total))
            room -= take
        yield run


class Rows:
    """Output rows, gathered into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, batch_rows: int = 4096, batch_bytes: int = 8 << 20):
        self.schema, self.batch_rows, self.batch_bytes = schema, batch_rows, batch_bytes
        self.columns, self.held = [[] for _ in schema], 0

    def sequence(self, number: int, pieces: list[tuple], leftover: bool, with_ids: bool) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            kept = ids if with_ids or leftover else None
            self.held += len(kept or b"")
            for column, value in zip(self.columns, (doc, start, n, zlib.crc32(ids), total, number, offset, kept, leftover)):
                column.append(value)
            offset += n

    def take(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.columns[0] and (last or len(self.columns[0]) >= self.batch_rows or self.held >= self.batch_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema
            )
            self.columns, self.held = [[] for _ in self.schema], 0


def _schema(df: DataFrame, id_col: str) -> T.StructType:
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [field_sql(df, id_col, "doc_id")] + [T.StructField(n, T.LongType()) for n in longs]
    return T.StructType(fields + [T.StructField("ids", T.BinaryType()), T.StructField("leftover", T.BooleanType())])


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    vocabulary: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers; without
    ``with_ids`` only their checksum is kept. ``vocabulary`` is the path of a public rank file.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(docs, id_col)
    arrow = to_arrow_schema(schema)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def tokenized(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        chunks = chunk_cache(vocabulary)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1)):
                ids = chunks.ids(text.as_py()) + end
                yield key, 0, ids, len(ids) // 4

    def first(batches):
        windows = Windows(window, open_windows, TaskContext.get().partitionId() * PER_TASK)
        rows = Rows(arrow)
        for piece in tokenized(batches):
            for number, pieces in windows.add(*piece):
                rows.sequence(number, pieces, False, with_ids)
            yield from rows.take()
        for number, pieces in windows.leftovers():
            rows.sequence(number, pieces, True, with_ids)
        yield from rows.take(last=True)

    def merge(first_id: int, last: bool):
        def run(batches):
            # one open window: what doesn't fit tops it up, so all but the last window are full
            windows = Windows(window, 1, first_id + TaskContext.get().partitionId() * PER_TASK)
            rows = Rows(arrow)
            for batch in batches:
                for r in batch.to_pylist():
                    for number, pieces in windows.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]):
                        rows.sequence(number, pieces, False, with_ids)
                yield from rows.take()
            for _, pieces in list(windows.open):
                for cut in powers(pieces) if last else [pieces]:
                    rows.sequence(*windows.emit(cut), not last, with_ids)
            yield from rows.take(last=True)

        return run

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    placed = texts.mapInArrow(first, schema)
    # One run of the placement feeds both branches: another run over reordered rows could place otherwise.
    placed = cut_lineage(placed)
    done, left, first_id, round_ = placed.where("NOT leftover"), placed.where("leftover"), 0, 0
    tasks = placed.rdd.getNumPartitions()
    while True:
        tasks = max(1, -(-tasks // GATHER))
        group = F.floor((F.col("sequence_id") - F.lit(first_id)) / F.lit(PER_TASK * GATHER)) if tasks > 1 else F.lit(0)
        first_id = MERGED + round_ * PER_ROUND
        merged = left.repartition(tasks, group).sortWithinPartitions("sequence_id", "offset").mapInArrow(merge(first_id, tasks == 1), schema)
        if tasks == 1:
            break
        merged = cut_lineage(merged)
        done, left, round_ = done.unionByName(merged.where("NOT leftover")), merged.where("leftover"), round_ + 1
    out = done.unionByName(merged).drop("leftover")
    return out if with_ids else out.drop("ids")
