import random

import xxhash
from pyspark.sql import types as T

from tapeweave.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string, node int"


def brute(rows):
    """doc_id -> (fingerprint, component) by comparing every pair."""
    prints = []
    for key, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append((key, sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))))
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted((str(key), f"{fp:016x}", str(least.get(find(i)))) for i, (key, fp) in enumerate(prints))


def found(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300])))
        rows.append((len(rows), text))
        for _ in range(rng.choice([0, 0, 1, 4])):
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "ONE  two"), (1005, "x" * 50_000)]
    return rows + [(1003, "one two"), (None, "one two"), (None, "nobody else says this")]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "clash", "clash", 1) for k, t in rows], SCHEMA).repartition(3)


def test_components_match_all_pairs(spark):
    rows = corpus()
    assert found(simhash.near_duplicates(frame(spark, rows))) == brute(rows)


def test_dense_cells_lose_no_link(spark):
    rows = corpus()
    assert found(simhash.near_duplicates(frame(spark, rows), dense=1)) == brute(rows)


def test_links_of_random_near_prints(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) % (1 << 64)).count("1") <= 2}
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    assert {tuple(r) for r in simhash.links(table).collect()} == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert simhash.near_duplicates(empty).collect() == []


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (2, "other words stand here"), (None, "a b c d"), (4, None)]
    kept = simhash.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "component_id", "node"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]
