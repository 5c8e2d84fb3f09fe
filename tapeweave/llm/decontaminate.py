"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations alone.

Test items are short and documents long, so their Jaccard similarity is tiny while the share of
the item found in the document is what counts. Items are partitioned by the size class of their
distinct shingle sets. For a class with at most u shingles and a wanted containment t, an item
lacks at most u - ceil(t u) of its shingles, so its u - ceil(t u) + 1 smallest hash values (its
bottom-k MinHash) must contain one that the document has: the search by those values has no
false negatives. Every shingle hash of a document is looked up, so long documents cost their
length and nothing more. Pairs found are verified on the shingles themselves.

Words are maximal runs of ASCII letters and digits and of all other non-ASCII characters of the
lower-cased text; shingles have five words. Shorter texts have one shingle, the whole sequence, so
an item under five words matches a document that consists of just those words.

Defined results: null and wordless texts, of items or documents, match nothing; rows that share an
id, or have none, are one document; repeated items count once; items with a null id match and
count but are not listed; empty tables match nothing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeweave.llm.common import cut_lineage, drop_ids, stored, text_or_empty

SHINGLE = 5
CONTAINMENT = 0.8
BREAKS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    split = F.expr(f"array_remove(split(lower(__text), '{BREAKS}'), '')")
    return df.select(*keep, text_or_empty(text_col).alias("__text")).select(*keep, split.alias("words"))


def hashed_shingles(df: DataFrame, *keep: str) -> DataFrame:
    """``grams``: the hash of every shingle, in order; words are hashed once."""
    hashed = df.select(*keep, F.size("words").alias("n"), F.expr("transform(words, w -> xxhash64(w))").alias("h"))
    parts = ", ".join(f"h[i + {j}]" for j in range(SHINGLE))
    long = f"transform(sequence(0, n - {SHINGLE}), i -> xxhash64({parts}))"
    short = "array(aggregate(h, 0L, (a, x) -> xxhash64(a, x)))"
    empty = "cast(array() AS array<bigint>)"
    return hashed.select(
        *keep, F.expr(f"CASE WHEN n >= {SHINGLE} THEN {long} WHEN n > 0 THEN {short} ELSE {empty} END").alias("grams")
    )


def text_shingles(df: DataFrame, *keep: str) -> DataFrame:
    """``grams``: the distinct shingles as text."""
    long = f"transform(sequence(1, size(words) - {SHINGLE - 1}), i -> concat_ws(' ', slice(words, i, {SHINGLE})))"
    whole = "array(concat_ws(' ', words))"
    return df.select(
        *keep, F.expr(f"array_distinct(CASE WHEN size(words) >= {SHINGLE} THEN {long} ELSE {whole} END)").alias("grams")
    )


def item_sketches(items: DataFrame, text_col: str, containment: float) -> DataFrame:
    """(item, h): the bottom-k MinHash of every item, k set by its size class."""
    sets = hashed_shingles(words(items, text_col, "item"), "item").select(
        "item", F.expr("sort_array(array_distinct(grams))").alias("grams")
    )
    sized = sets.where(F.size("grams") > 0).withColumn("top", F.expr("cast(pow(2, floor(log2(size(grams))) + 1) AS int) - 1"))
    k = F.expr(f"top - cast(ceil({containment}D * top - 1e-9D) AS int) + 1")
    return sized.withColumn("k", k).select("item", F.explode_outer(F.expr("slice(grams, 1, k)")).alias("h"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, item_id, containment) of the pairs at or above ``containment``."""
    # the same text under the same id once; its place in the join is the text itself
    named = items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("text")).distinct()
    named = named.withColumn("item", F.struct("item_id", "text"))
    sketches = item_sketches(named, "text", containment)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the outer form: for the other one the optimizer adds a filter on the array's size, which builds every array again
    probes = hashed_shingles(words(source, "text", "doc_id"), "doc_id").select("doc_id", F.explode_outer("grams").alias("h"))
    found = cut_lineage(probes.join(sketches, "h").select("doc_id", "item").distinct())
    # few ids as a rule: with their size known in advance, the texts need no shuffle to be held against them
    those = stored(found.select(F.col("doc_id").alias("__id")).distinct(), "decontaminate-near")
    near = source.join(those, F.expr("doc_id <=> __id"), "left_semi")
    near = near.groupBy("doc_id").agg(F.collect_set("text").alias("texts")).select("doc_id", F.explode("texts").alias("text"))
    grams = text_shingles(words(near, "text", "doc_id"), "doc_id")
    asked = text_shingles(words(named, "text", "item"), "item").select("item", F.col("grams").alias("wanted"))
    pairs = found.withColumnRenamed("doc_id", "__id").join(asked, "item").join(grams, F.expr("doc_id <=> __id"))
    share = F.expr("size(array_intersect(wanted, grams)) / size(wanted)")
    pairs = pairs.select("doc_id", "item", share.alias("containment")).where(F.col("containment") >= containment - 1e-9)
    return pairs.groupBy("doc_id", F.col("item.item_id").alias("item_id")).agg(F.max("containment").alias("containment"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_items, items (sorted ids), containment (the largest, else 0)."""
    found = contained_items(docs, items, id_col, **names).groupBy(F.col("doc_id").alias("__id")).agg(
        F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"),
        F.max("containment").alias("containment"),
    )
    every = docs.select(F.col(id_col).alias("doc_id"))
    kind = found.schema["items"].dataType.simpleString()
    return every.join(found, F.expr("doc_id <=> __id"), "left").select(
        "doc_id",
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.expr(f"cast(array() AS {kind})")).alias("items"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """``docs`` without the documents that contain an item; rows without an id stay."""
    found = contained_items(docs, items, id_col, **names).select(F.col("doc_id").alias(id_col)).distinct()
    return drop_ids(docs, stored(found, "decontaminate-found"), id_col)
