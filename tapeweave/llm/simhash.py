"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 16 four-bit segments, held as the 16
nibbles of one long. One differing bit moves one count by at most one, so the Manhattan distance
of two count vectors never exceeds the Hamming distance of the fingerprints. The grid range join
finds all pairs of vectors within distance 2: every vector is put into its own cell and the cells
one step away, and two vectors within distance 2 always meet in a cell. Pairs that meet are
verified on the fingerprints.

Only distinct fingerprints take part, so exact copies cost nothing. A cell with more than
``DENSE`` fingerprints is not paired up. Its fingerprints are embedded again with the finest
segments, one bit each, where the Manhattan distance is the Hamming distance; a cell of that grid
holds 65 fingerprints at most, all within 2 bits of each other, and gives a star of links. So no
pair is lost, and no group, however large, is written out as all its pairs.

Defined results: a null text is an empty one; texts of fewer words than a shingle have one
shingle, the whole sequence; no words give fingerprint zero, linked like any other; rows with
a null id take part but name no component; repeated rows come out as often as they come in;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tapeweave.llm.common import cut_lineage, drop_ids, field_sql, text_or_empty
from tapeweave.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
DENSE = 64
SLICE = 1 << 15  # shingles held at a time


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z alone is lowered, white space is x20, x09-x0D
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for at in range(0, n, SLICE):
        part = words[at : min(at + SLICE, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""
    schema = T.StructType([field_sql(docs, id_col, "doc_id"), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


#: Bit counts of the 16 four-bit segments of ``fp``, one per nibble.
COUNTS = " + ".join(f"(shiftrightunsigned(fp, {i}) & 1229782938247303441L)" for i in range(4))
STEPS = "sequence(0, 60, 4)"
#: The cell of a count vector, and the cells one step up or down in one count.
COUNT_CELLS = f"""concat(array(counts),
  transform(filter({STEPS}, s -> (shiftrightunsigned(counts, s) & 15L) < 4L), s -> counts + shiftleft(1L, s)),
  transform(filter({STEPS}, s -> (shiftrightunsigned(counts, s) & 15L) > 0L), s -> counts - shiftleft(1L, s)))"""
#: The same for segments of one bit: the fingerprint and those one bit away.
BIT_CELLS = "concat(array(fp), transform(sequence(0, 63), s -> fp ^ shiftleft(1L, s)))"


def links(prints: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints ``fp`` that connect all pairs within ``radius`` bits.

    Small cells give every verified pair, dense ones a star per set of near fingerprints.
    """
    if radius != 2:
        raise ValueError("The grid steps by one cell on either side, which is a radius of 2.")
    # explode_outer: for the plain form the optimizer adds a filter on the array's size, which builds every array twice
    cells = prints.select("fp", F.expr(COUNTS).alias("counts")).select("fp", F.expr(f"explode_outer({COUNT_CELLS})").alias("cell"))
    crowded = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("cell")
    small = cells.join(crowded, "cell", "left_anti").groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = small.where(F.size("fps") > 1).select(
        F.expr(
            f"""explode_outer(flatten(transform(fps, a -> transform(
                filter(fps, b -> b > a AND bit_count(a ^ b) <= {radius}), b -> struct(a AS a, b AS b)))))"""
        ).alias("p")
    ).where("p IS NOT NULL").select("p.a", "p.b")
    packed = cells.join(crowded, "cell", "left_semi").select("fp").distinct()
    balls = packed.select("fp", F.expr(f"explode_outer({BIT_CELLS})").alias("ball"))
    stars = balls.groupBy("ball").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.element_at("fps", 1).alias("a"), F.explode_outer(F.slice("fps", 2, 65)).alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, dense: int = DENSE
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = components(links(classes.select("fp"), dense=dense), "a", "b")
    named = classes.join(rooted, classes.fp == rooted.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "root").select(F.col("fp").alias("of"), "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(named, prints.fp == named["of"]).select("doc_id", hexed, "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of every component; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col)
    return drop_ids(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)), id_col)
