import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tapeweave.llm.packing import pack
from tapeweave.llm.tokens import Chunks, load_added, load_encoding


@pytest.fixture(scope="module")
def tokenizer():
    return reference()


CACHE = Chunks(load_encoding(), limit=50, added=load_added())
PARTS = ["the", "Foo", "é", "'s", "'", "12", "a1", ",", "...", " ", "\n", "\t", " ", "\x1c", "\x00", "<|endoftext|>", "<|endoftext", "|>", "  ", "日本", "🙂", "\r\n"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS)).map("".join), st.text()))
def test_chunked_ids_are_the_tokenizer_ids(text):
    want = reference().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(CACHE.ids(text), dtype="<u4").tolist() == want


def reference(held=[]):
    if not held:
        held.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return held[0]


def check(rows, texts, tokenizer, window):
    """Every id lies in exactly one piece; sequences are gapless and not over-long. Returns the padding share."""
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    seen, sequences = {k: [] for k in texts}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        raw = np.array(part, dtype="<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(raw)
        if "ids" in r:
            assert r.ids == raw
        seen[r.doc_id] += range(r.start, r.start + r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(at) == list(range(len(ids[k]))) for k, at in seen.items())
    padding = total = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
        total += end
    return padding / total


@pytest.mark.parametrize("slots,with_ids", [(1, True), (3, False), (64, True)])
def test_pieces_cover_all_ids_without_padding(spark, tokenizer, slots, with_ids):
    rng = random.Random(slots)
    texts = {i: " ".join(rng.choice(["alpha", "Beta,", "g.\nH", "x  y"]) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for i in range(150)}
    texts[200], texts[201] = None, "long " * 20_000
    table = spark.createDataFrame([(k, t, "clash", 5) for k, t in texts.items()], "doc_id long, text string, ids string, start int")
    out = pack(table.repartition(5), window=128, open_windows=slots, with_ids=with_ids)
    assert ("ids" in out.columns) == with_ids
    assert check(out.collect(), texts, tokenizer, 128) == 0


def test_repeated_rows_null_ids_and_empty_tables(spark):
    table = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")
    rows = pack(table).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == ["7", "7", "None"]
    assert sum(r.length for r in rows) == 9
    assert pack(table.where("doc_id > 7")).collect() == []


def test_one_window_stays_open_over_many_partitions(spark, tokenizer):
    texts = {i: "alpha beta " * (i % 37) for i in range(600)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(40)
    rows = pack(table, window=256, open_windows=4).collect()
    assert check(rows, texts, tokenizer, 256) == 0
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert sum(n < 256 for n in filled.values()) <= 8


def test_added_tokens_count_as_one_id(spark, tokenizer):
    texts = {1: "<|endoftext|>", 2: "one<|endoftext|><|endoftext|> two  <|endoftext|>", 3: "<|endoftext| >", 4: "a  <|endoftext|>\n\nb"}
    rows = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert check(rows, texts, tokenizer, 2048) == 0
    assert next(r.doc_tokens for r in rows if r.doc_id == 1) == 2
