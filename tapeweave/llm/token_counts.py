"""Edit-aware token counts.

A document keeps its text and a segment tree over its pre-tokens. A leaf is a run of whole
pre-tokens with its length in characters and its number of tokens; an inner node holds the sums
of its two children, so the root is the count of the document. An edit replaces characters: the
pre-tokens from shortly before it are formed again until one ends where a leaf ended before, only
those are encoded, and the sums on the paths of the touched leaves are updated. If they no longer
fit into the leaves that they replace, the tree is laid out anew from the leaves' sums; nothing
else is encoded again.

Why so little context is enough: the pattern forms pre-tokens from left to right and never looks
more than two characters past a pre-token's end. So a pre-token that ends three characters or
more before an edit stays, and so does everything after a boundary that old and new text share
behind it. An added token is a pre-token of its own, and the pattern sees the text between two of
them alone. As an edit can make or break one, context grows by the longest one's length.

Edits of one batch have positions in the stored text, must not overlap, and count from 0 in
characters (those at one position apply in their given order). A position or length beyond the
text is cut to it; overlapping edits raise an error.

Defined results: a null text counts as empty, an empty one has no tokens; null or no edits leave
the count; null parts of an edit are 0, 0 and empty; repeated rows and null ids are carried as
they come; an empty table gives no rows; further columns are ignored. A task holds one Arrow
batch; a document's tree takes about a tenth of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tapeweave.llm.common import field_sql, text_or_empty
from tapeweave.llm.tokens import Chunks, START, chunk_cache

LEAF = 64  # pre-token chunks in a new leaf
FULL = 4 * LEAF  # chunks above which a leaf is split
LOOK = 3

EDITS = T.ArrayType(
    T.StructType([T.StructField("position", T.LongType()), T.StructField("deleted", T.LongType()), T.StructField("inserted", T.StringType())])
)


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def pre_tokens(text: str, chunks: Chunks, start: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of pre-tokens and added tokens from ``start``, a border between two of them, on."""
    while True:
        mark = chunks.marks.search(text, start) if chunks.marks else None
        end = mark.start() if mark else len(text)
        for m in _pattern().finditer(text, start, end):
            yield m.span()
        if not mark:
            return
        yield mark.span()
        start = mark.end()


def sums(leaves: np.ndarray) -> np.ndarray:
    """Heap of sums over (leaf, 2) values: node i has children 2i and 2i + 1, the root is 1."""
    width = 1 << max(0, len(leaves) - 1).bit_length()
    tree = np.zeros((2 * width, 2), dtype=np.int64)
    tree[width : width + len(leaves)] = leaves
    while width > 1:
        half = width // 2
        tree[half:width] = tree[width : 2 * width : 2] + tree[width + 1 : 2 * width : 2]
        width = half
    return tree


class Counted:
    """One document: its text, and the tree over (characters, tokens) of its leaves."""

    def __init__(self, text: str, chunks: Chunks, tree: np.ndarray | None = None):
        self.text, self.chunks, self.encoded = text, chunks, 0
        self.tree = sums(self.leaves_of(text)) if tree is None else tree

    def leaves_of(self, text: str) -> np.ndarray:
        parts = self.chunks.split(text)
        if parts is None:
            return self.leaves_of_spans(text, list(pre_tokens(text, self.chunks)))
        tokens = np.fromiter((len(self.chunks[p]) // 4 for p in parts), dtype=np.int64, count=len(parts))
        # a chunk is its characters and the space before it; a marked one has no space, nor has a line break
        lengths = np.fromiter((len(p) - (p[:1] == START) + (p != "\n" and p[:1] != START) for p in parts), dtype=np.int64, count=len(parts))
        starts = np.arange(0, len(parts), LEAF)
        return np.stack([np.add.reduceat(lengths, starts), np.add.reduceat(tokens, starts)], axis=1)

    def leaves_of_spans(self, text: str, spans: list[tuple[int, int]], at_most: int = LEAF) -> np.ndarray:
        if not spans:
            return np.zeros((1, 2), dtype=np.int64)
        tokens = np.fromiter((len(self.pre_token(text[a:b])) // 4 for a, b in spans), dtype=np.int64, count=len(spans))
        lengths = np.array([b - a for a, b in spans], dtype=np.int64)
        starts = np.arange(0, len(spans), at_most)
        return np.stack([np.add.reduceat(lengths, starts), np.add.reduceat(tokens, starts)], axis=1)

    def pre_token(self, word: str) -> bytes:
        if word in self.chunks.added:
            return self.chunks.added[word]
        if "\x00" in word:
            return self.chunks.pack(word)
        return self.chunks[word[1:]] if word[:1] == " " and len(word) > 1 and not word.isspace() else self.chunks[START + word]

    @property
    def n_tokens(self) -> int:
        return int(self.tree[1, 1])

    def leaf_at(self, position: int) -> tuple[int, int]:
        """(node, start) of the leaf that holds the character at ``position``, by descent."""
        node, start, width = 1, 0, len(self.tree) // 2
        while node < width:
            left = int(self.tree[2 * node, 0])
            go = position >= start + left and self.tree[2 * node + 1, 0] > 0
            start += left * go
            node = 2 * node + go
        return node, start

    def edit(self, position: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters from ``position`` on, both within the text."""
        size = len(self.text)
        if not deleted and not inserted:
            return
        width = len(self.tree) // 2
        first, start = self.leaf_at(max(0, position - LOOK - self.chunks.longest))
        last, from_ = self.leaf_at(min(position + deleted, max(size - 1, 0)))
        end = from_ + int(self.tree[last, 0])
        self.text = text = self.text[:position] + inserted + self.text[position + deleted :]
        shift = len(inserted) - deleted
        spans, at = [], start
        # old boundaries behind the edit, in the new text; more leaves are taken in until one is met
        for span in pre_tokens(text, self.chunks, start):
            at = span[1]
            spans.append(span)
            while at > end + shift and last + 1 < 2 * width and end < size:
                last += 1
                end += int(self.tree[last, 0])
            if at == end + shift and at >= position + len(inserted):
                break
        self.encoded += at - start
        room = last - first + 1
        if len(spans) <= room * FULL:
            each = max(1, -(-len(spans) // room))
            leaves = np.zeros((room, 2), dtype=np.int64)
            fresh = self.leaves_of_spans(text, spans, each)
            leaves[: len(fresh)] = fresh
            self.update(first, leaves)
        else:
            old = self.tree[width:]
            fresh = self.leaves_of_spans(text, spans)
            merged = np.concatenate([old[: first - width], fresh, old[last + 1 - width :]])
            self.tree = sums(merged[merged[:, 0] > 0])

    def update(self, node: int, leaves: np.ndarray) -> None:
        """Put ``leaves`` from ``node`` on, and the sums of all nodes above them."""
        self.tree[node : node + len(leaves)] = leaves
        low, high = node, node + len(leaves) - 1
        while low > 1:
            low, high = low // 2, high // 2
            self.tree[low : high + 1] = self.tree[2 * low : 2 * high + 2 : 2] + self.tree[2 * low + 1 : 2 * high + 2 : 2]

    def apply(self, edits: list[dict] | None) -> None:
        """One batch of edits, the last one first so that positions stay right."""
        size, batch = len(self.text), []
        for e in edits or ():
            if e is not None:
                position = min(max(e["position"] or 0, 0), size)
                batch.append((position, min(max(e["deleted"] or 0, 0), size - position), e["inserted"] or ""))
        order = sorted(range(len(batch)), key=lambda i: (batch[i][0], batch[i][1], i))
        reach = 0
        for i in order:
            if batch[i][0] < reach:
                raise ValueError(f"Edits overlap at position {batch[i][0]}.")
            reach = max(reach, batch[i][0] + batch[i][1])
        for i in reversed(order):
            self.edit(*batch[i])


def _state_schema(df: DataFrame, id_col: str) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    return T.StructType(
        [field_sql(df, id_col, "doc_id"), T.StructField("text", T.StringType()), T.StructField("chars", longs),
         T.StructField("tokens", longs), T.StructField("n_tokens", T.LongType()), T.StructField("encoded_chars", T.LongType())]
    )


def _batch(keys: pa.Array, docs: list[Counted]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [keys, pa.array([d.text for d in docs], type=pa.string()), pa.array([d.tree[:, 0] for d in docs], type=longs),
         pa.array([d.tree[:, 1] for d in docs], type=longs), pa.array([d.n_tokens for d in docs], type=pa.int64()),
         pa.array([d.encoded for d in docs], type=pa.int64())],
        names=["doc_id", "text", "chars", "tokens", "n_tokens", "encoded_chars"],
    )


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The state of every document: doc_id, text, chars, tokens (heaps of sums), n_tokens, encoded_chars (0)."""

    def run(batches):
        chunks = chunk_cache(vocabulary)
        for batch in batches:
            yield _batch(batch.column(0), [Counted(t.as_py(), chunks) for t in batch.column(1)])

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, _state_schema(docs, id_col))


def attach(state: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``state`` with an ``edits`` column from rows (id, position, deleted, inserted), in any order."""
    batch = F.sort_array(F.collect_list(F.struct("position", "deleted", "inserted"))).alias("edits")
    grouped = edits.groupBy(F.col(id_col).alias("__id")).agg(batch)
    return state.join(grouped, F.col("doc_id") == F.col("__id"), "left").drop("__id")


def update(state: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The state after each row's ``edits``; ``encoded_chars`` says how much was encoded again."""

    def run(batches):
        chunks = chunk_cache(vocabulary)
        for batch in batches:
            docs = []
            for text, chars, tokens, edits in zip(*(batch.column(i) for i in range(1, 5))):
                tree = np.stack([np.array(chars.values), np.array(tokens.values)], axis=1)
                doc = Counted(text.as_py(), chunks, tree)
                doc.apply(edits.as_py())
                docs.append(doc)
            yield _batch(batch.column(0), docs)

    return state.select("doc_id", "text", "chars", "tokens", F.col("edits").cast(EDITS)).mapInArrow(
        run, _state_schema(state, "doc_id")
    )


def counts_with_edits(
    docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Build and update in one pass: doc_id, n_tokens, n_tokens_after, n_chars_after, encoded_chars."""
    names = ["n_tokens", "n_tokens_after", "n_chars_after", "encoded_chars"]
    schema = T.StructType([field_sql(docs, id_col, "doc_id")] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        chunks = chunk_cache(vocabulary)
        for batch in batches:
            rows = []
            for text, batch_edits in zip(batch.column(1), batch.column(2)):
                doc = Counted(text.as_py(), chunks)
                before = doc.n_tokens
                doc.apply(batch_edits.as_py())
                rows.append((before, doc.n_tokens, len(doc.text), doc.encoded))
            columns = [pa.array(c, type=pa.int64()) for c in zip(*rows)] or [pa.array([], type=pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), edits.cast(EDITS).alias("edits"))
    return source.mapInArrow(run, schema)
