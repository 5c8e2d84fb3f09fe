"""Near-duplicates by the Jaccard similarity of five-word shingles: MinHash bands, exact check, components.

At a similarity of 0.8, 64-bit SimHash fingerprints differ in about ten bits, which no grid of small
steps covers. Here every distinct shingle set gets ``BANDS`` keys of ``ROWS`` MinHash values each.
Two sets of similarity s share no key with a chance of (1 - s^4)^32: below 5e-8 at 0.8, less above.
The keys only propose pairs; every link is checked on the shingle sets themselves.

Only distinct sets take part, so exact copies cost nothing. A key of at most ``SMALL`` sets proposes
all its pairs. A larger one proceeds in rounds: in each, the first few sets, sixteen times as many as
in the round before, are held against all later ones of other components, and then leave the key.
Sets with the fewest shingles of their own, the middle of a group, come first, and sets with so many
that no other can be similar leave. The key is done when one component is left in it. So no pair is
lost, and a large group of near copies is not written out as all its pairs.

What one round leaves of the crowded keys, copies changed too much to be linked to a group's middle and
texts that merely share passages, is keyed anew: a set's shingles are ordered from the rarest to the most
frequent, and the set goes under each of those that can be the first one shared with a similar set. Two
sets of n and m shingles, the first shared one at places i and j, share min(n - i, m - j) at most, and
similar ones share 4/9 (n + m); so shingles of a group's middle no longer bring together its changed
copies. The rounds go on over these keys, with the place of the shingle for the number of own ones.

Words are maximal runs without ASCII white space, with A-Z lowered; a text of fewer than five words has
one shingle, the whole sequence. Shingles stand as 64-bit hashes.

Defined results: a null text is an empty one; texts without words are copies of each other; rows are
judged by id and text, so rows that lack an id or share one are judged like any other. Of every
component one row stays: that of the smallest id, rows without an id last, equal ids by the
texts' hashes. An empty table gives no rows; columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tapeweave.llm.common import cut_lineage, text_or_empty
from tapeweave.llm.components import LEAST_TASKS, components

SHINGLE = 5
BANDS, ROWS = 32, 4
SMALL = 8
FIRST, MORE = 4, 16  # sets held against the later ones in the first round, and how many times as many in the next
SEED = 42
SLICE = 1 << 10  # shingles whose MinHash values are held at a time
TASK_LINKS = 1 << 16  # links that one task of a step of components writes
SPREAD = 64  # parts that the pairs of one set are dealt to

_odd = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
TIMES, FLIP, JOIN = _odd[0][:, None], _odd[1][:, None], _odd[2].reshape(BANDS, ROWS)
PLACES = np.random.default_rng(SEED + 1).integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z alone is lowered, white space is x20, x09-x0D
    if len(words) < SHINGLE:
        whole = [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
        return np.array(whole, dtype=np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - SHINGLE + 1
    grams = np.zeros(n, dtype=np.uint64)
    for i, times in enumerate(PLACES):
        grams += hashes[i : i + n] * times
    return np.unique(_mixed(grams))


def set_key(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(grams.tobytes(), SEED)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One key per band; sets without shingles have none."""
    if not len(grams):
        return grams
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), SLICE):
        np.minimum(least, ((grams[None, at : at + SLICE] ^ FLIP) * TIMES).min(axis=1), out=least)
    joined = (least.reshape(BANDS, ROWS) * JOIN).sum(axis=1, dtype=np.uint64)
    return _mixed(joined + np.arange(BANDS, dtype=np.uint64))


def _signed(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


ROW_SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, key, keys): every row's set, with the band keys where a task meets a set first."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), *ROW_SCHEMA])

    def run(batches):
        seen = set()
        for batch in batches:
            found, bands = [], []
            for text in batch.column(2):
                grams = shingles(text.as_py())
                found.append(set_key(grams))
                bands.append(None if found[-1] in seen else _signed(band_keys(grams)))
                seen.add(found[-1])
            columns = [batch.column(0), batch.column(1), pa.array(_signed(found)), pa.array(bands, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "key", "keys"])

    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, schema)


def _sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(key, grams) of the ``wanted`` keys."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches):
        seen = set()
        for batch in batches:
            for text in batch.column(0):
                grams = shingles(text.as_py())
                key = set_key(grams)
                if key in seen:
                    continue
                seen.add(key)
                columns = [pa.array(_signed([key])), pa.array([_signed(grams)], type=pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "grams"])

    every = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
    return every.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("grams").alias("grams"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose sets have a Jaccard similarity of 0.8 or more."""
    dealt = pairs.withColumn("part", F.expr(f"pmod(b, {SPREAD})"))  # one set may have many pairs
    heads = dealt.select("a", "part").distinct().join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")
    both = dealt.join(heads, ["a", "part"]).join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    counted = both.select("a", "b", F.expr("size(ga) + size(gb)").alias("n"), F.expr("size(array_intersect(ga, gb))").alias("met"))
    return counted.where("5 * met >= 4 * (n - met)").select("a", "b")


def _and(links: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``links`` and the similar ones of ``pairs``, in as many tasks as the links need, not as many more each round."""
    every = links.unionByName(cut_lineage(_similar(pairs, sets)))
    return every.coalesce(LEAST_TASKS + every.count() // TASK_LINKS)


def _alive(rows: DataFrame) -> DataFrame:
    """(band, members): keys that still join components, with the sets that can be similar to another, common ones first.

    Sets of n shingles, u of them not shared under the key, share at most the smaller n - u; similar ones share 4/9 of both n.
    """
    lists = rows.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("u", "n", "key", "root"))).alias("members"))
    least = lists.select("band", "members", F.expr("array_min(members.n)").alias("least"))
    able = least.select("band", F.expr("filter(members, m -> 9 * (m.n - m.u) >= 4 * (m.n + least))").alias("members"))
    return cut_lineage(able.where("size(array_distinct(members.root)) > 1"))


def _by_rarest(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(band, u, n, key): the sets of ``rest`` under all shingles that can be the rarest that they share with a similar set.

    u shingles are rarer. Similar sets share 4/5 of the larger one's n shingles, so n / 5 are rarer at most.
    """
    grams = sets.join(rest.select("key").distinct(), "key", "left_semi").select("key", F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(counts, "gram").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    ranked = ranked.withColumn("n", F.size("grams"))
    places = ranked.select("n", "key", F.posexplode(F.expr("slice(grams, 1, n - (4 * n + 4) div 5 + 1)")).alias("u", "g"))
    return places.where("g.df > 1").select(F.col("g.gram").alias("band"), "u", "n", "key")


def linked(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """(node, root) of the sets that are linked to others."""
    classes = rows.where("keys IS NOT NULL").dropDuplicates(["key"])
    bands = classes.select("key", F.explode("keys").alias("band")).groupBy("band").agg(F.collect_list("key").alias("keys"))
    bands = cut_lineage(bands.where("size(keys) > 1").select("band", F.array_sort("keys").alias("keys")))
    sets = cut_lineage(_sets(docs, text_col, bands.select(F.explode("keys").alias("key")).distinct()))
    all_pairs = "flatten(transform(keys, a -> transform(filter(keys, b -> b > a), b -> struct(a AS a, b AS b))))"
    small = bands.where(f"size(keys) <= {SMALL}").select(F.explode(F.expr(all_pairs)).alias("p")).select("p.a", "p.b").distinct()
    links = cut_lineage(_similar(small, sets))
    large = bands.where(f"size(keys) > {SMALL}").select("band", F.explode("keys").alias("key"))
    there = sets.join(large.select("key").distinct(), "key", "left_semi")
    grams = there.select("key", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    alone = grams.where("n = 1").groupBy("key").agg(F.count(F.lit(1)).alias("u"))
    sizes = there.select("key", F.size("grams").alias("n")).join(alone, "key", "left").select("key", "n", F.coalesce("u", F.lit(0)).alias("u"))
    bands = _alive(large.join(sizes, "key").withColumn("root", F.col("key")))
    first, roots = FIRST, None
    while bands.head(1):
        heads = bands.select("members", F.posexplode(F.slice("members", 1, first)).alias("at", "head"))
        later = """transform(filter(slice(members, at + 2, size(members)), m -> m.root <> head.root
            AND 9 * least(m.n - m.u, head.n - head.u) >= 4 * (m.n + head.n)), m -> m.key)"""
        pairs = heads.select(F.col("head.key").alias("a"), F.explode(F.expr(later)).alias("b")).distinct()
        links = _and(links, pairs, sets)
        rest = bands.select("band", F.explode(F.slice("members", first + 1, 1 << 30)).alias("m")).select("band", "m.u", "m.n", "m.key")
        first *= MORE
        if roots is None:
            rest, first = _by_rarest(rest, sets), FIRST
        roots = components(links, "a", "b", TASK_LINKS)
        rest = rest.join(roots.withColumnRenamed("node", "key"), "key", "left")
        bands = _alive(rest.withColumn("root", F.coalesce("root", "key")))
    return components(links, "a", "b", TASK_LINKS) if roots is None else roots


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component."""
    rows = cut_lineage(_rows(docs, id_col, text_col))
    roots = linked(docs, rows, text_col)
    # per set the row that would stay, and how often it comes
    own = rows.groupBy("key", "id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "copies")
    heads = own.groupBy("key").agg(F.min(place).alias("head")).join(roots, F.col("key") == roots.node, "left")
    heads = heads.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("head").alias("head"))
    heads = heads.select(F.col("head.id").alias("__id"), F.col("head.text_hash").alias("__hash"), F.col("head.copies").alias("__copies"))
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty(docs[text_col])) == F.col("__hash"))
    kept = docs.join(heads, same)
    once = kept.where("__copies = 1").select(*[docs[c] for c in docs.columns])
    again = kept.where("__copies > 1").groupBy("__id", "__hash").agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return once.unionByName(again.select("row.*"))
