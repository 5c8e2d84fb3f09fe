import random
import re

import pytest

from tapeweave.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall((text or "").lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, items, containment=0.8):
    pooled = {}
    for key, text in docs:
        pooled.setdefault(key, []).append(grams(text))
    out = {}
    for key, sets in pooled.items():
        for item, text in items:
            q = grams(text)
            share = max(len(q & s) / len(q) if q else 0 for s in [set().union(*sets)] if s is not None)
            if q and share >= containment - 1e-9:
                out[key, item] = max(share, out.get((key, item), 0))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiouétr") for _ in range(3)) for _ in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([5, 6, 9, 17, 31, 64])))) for i in range(30)]
    docs = []
    for i in range(90):
        words = some(rng.choice([0, 3, 50, 700]))
        for _, text in rng.sample(items, rng.choice([0, 1, 2])):
            part = text.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((i, (", " if i % 3 else "\n").join(words).upper() if i % 5 == 0 else " ".join(words)))
    return docs, items


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(k, t, "clash", 1, 2) for k, t in docs], "doc_id long, text string, item string, n_items int, h int").repartition(3),
        spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, doc_id string"),
    )


@pytest.mark.parametrize("containment", [0.8, 0.5, 1.0])
def test_pairs_match_brute_force(spark, containment):
    docs, items = corpus(1)
    found = decontaminate.contained_items(*tables(spark, docs, items), containment=containment).collect()
    want = brute(docs, items, containment)
    assert {(r.doc_id, r.item_id): round(r.containment, 9) for r in found} == {k: round(v, 9) for k, v in want.items()}
    assert len(found) == len(want) > 20


def test_size_classes_lose_nothing(spark):
    """One item of each length, in a document that lacks as many shingles as 0.8 allows."""
    items, docs = [], []
    for n in range(1, 60):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        docs += [(n, " ".join(words)), (100 + n, " ".join(words[: 4 + -(-8 * (n - 4) // 10)]) if n > 5 else "other"), (200 + n, "pre " + " ".join(words) + " post")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(*tables(spark, docs, items)).collect()}
    assert found == set(brute(docs, items))


def test_edge_rows(spark):
    text = "one two three four five six seven"
    docs = [(1, None), (2, ""), (3, "x " + text), (None, text), (4, "one two"), (4, "one two"), (5, "one two three"), (6, "!!! ... !!!"), (7, text * 1), (8, "Ümlaut " * 9000 + text)]
    items = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "One, TWO!"), (5, "...")]
    d, i = tables(spark, docs, items)
    rows = decontaminate.contamination(d, i).collect()
    got = sorted((str(r.doc_id), r.n_items, str(sorted(map(str, r["items"])))) for r in rows)
    both, short, none = str(["1"]), str(["4"]), "[]"
    assert got == sorted([("1", 0, none), ("2", 0, none), ("3", 2, both), ("None", 2, both), ("4", 1, short), ("4", 1, short), ("5", 0, none), ("6", 0, none), ("7", 2, both), ("8", 2, both)])
    kept = decontaminate.clean(d, i)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "None"]
    assert decontaminate.contamination(d.where("false"), i).collect() == []
    assert all(r.n_items == 0 for r in decontaminate.contamination(d, i.where("false")).collect())
