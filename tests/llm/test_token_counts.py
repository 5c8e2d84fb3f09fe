import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeweave.llm import token_counts
from tapeweave.llm.tokens import Chunks, load_added, load_encoding

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
CHUNKS = Chunks(load_encoding(), added=load_added())
PARTS = ["the", " and", " Foo", "é", "'", "'r", "re", "e", "'s", " 12", "7", ",", " ...", " ", "  ", "\n", "\n\n", "\t", "\x00", "日本", "🙂", "x" * 40, "<|endoftext|>", "<|endof", "text|>"]


def count(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def spliced(text, edits):
    out, at = "", 0
    for position, deleted, inserted in edits:
        position = min(position, len(text))
        out += text[at:position] + inserted
        at = min(len(text), position + deleted)
    return out + text[at:]


def is_consistent(doc):
    width = len(doc.tree) // 2
    assert doc.tree[width:, 0].sum() == len(doc.text) == doc.tree[1, 0]
    for i in range(1, width):
        assert (doc.tree[i] == doc.tree[2 * i] + doc.tree[2 * i + 1]).all()


@pytest.mark.parametrize("seed", range(6))
def test_updated_counts_match_a_full_count(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice(PARTS) for _ in range(n))
    for size in (0, 1, 5, 60, 900, 4000):
        doc = token_counts.Counted(some(size) if seed % 2 else " ".join(["plain", "words,", "line.\nNext"] * (size // 3)), CHUNKS)
        assert doc.n_tokens == count(doc.text)
        for _ in range(12):
            marks = sorted(rng.randrange(len(doc.text) + 3) for _ in range(6))
            edits = [(marks[i], rng.randrange(marks[i + 1] - marks[i] + 1), some(rng.choice([0, 1, 3, 40]))) for i in (0, 2, 4)]
            want = spliced(doc.text, edits)
            doc.apply([dict(zip(("position", "deleted", "inserted"), e)) for e in edits])
            assert doc.text == want
            assert doc.n_tokens == count(want)
            is_consistent(doc)


def test_long_texts_encode_little_again():
    doc = token_counts.Counted("a word and another one, " * 50_000, CHUNKS)
    doc.apply([{"position": 600_000, "deleted": 3, "inserted": "new"}])
    assert doc.encoded < 2_000 and doc.n_tokens == count(doc.text)
    doc.apply([{"position": 10, "deleted": 0, "inserted": "many fresh words here " * 3_000}])
    assert doc.encoded < 80_000 and doc.n_tokens == count(doc.text)
    is_consistent(doc)


def test_overlapping_edits_are_refused():
    doc = token_counts.Counted("some text", CHUNKS)
    with pytest.raises(ValueError, match="overlap"):
        doc.apply([{"position": 0, "deleted": 4, "inserted": ""}, {"position": 3, "deleted": 1, "inserted": "x"}])


ROWS = [(1, "One line.\nTwo  lines", "a"), (2, None, None), (3, "", "c"), (None, "no id", "d"), (1, "One line.\nTwo  lines", "a"), (5, "z" * 30_000, "e")]


def test_state_edits_and_one_pass_agree(spark):
    docs = spark.createDataFrame([(k, t, s, 9) for k, t, s in ROWS], "doc_id long, text string, source string, tokens int")
    state = token_counts.build(docs)
    assert sorted(r.n_tokens for r in state.collect()) == sorted(count(t or "") for _, t, _ in ROWS)
    edits = spark.createDataFrame([(1, 0, 3, "Three"), (1, 9, 1, " "), (5, 7, 0, None), (77, 1, 1, "x")], "doc_id long, position long, deleted long, inserted string")
    after = {(r.doc_id, r.text): r.n_tokens for r in token_counts.update(token_counts.attach(state, edits)).collect()}
    assert after[(1, "Three line. Two  lines")] == count("Three line. Two  lines")
    assert all(n == count(t) for (_, t), n in after.items()) and len(after) == 5
    edit = F.array(F.struct(F.lit(0).alias("position"), F.lit(1).alias("deleted"), F.lit("new ").alias("inserted")))
    rows = token_counts.counts_with_edits(docs, edit).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in rows) == sorted(
        (str(k), count(t or ""), count("new " + (t or "")[1:]), len("new " + (t or "")[1:])) for k, t, _ in ROWS
    )
    none = F.lit(None).cast(token_counts.EDITS)
    assert all(r.n_tokens == r.n_tokens_after for r in token_counts.counts_with_edits(docs, none).collect())
    assert token_counts.counts_with_edits(docs.where("false"), edit).collect() == []


@pytest.mark.parametrize("before,after", [("one  ", "  two"), ("", ""), ("a..", "'s"), ("x" * 300 + " " * 50, "\n\n\n")])
def test_edits_make_and_break_added_tokens(before, after):
    mark = "<|endoftext|>"
    for at in range(len(mark) + 1):
        doc = token_counts.Counted(before + mark + after, CHUNKS)
        doc.apply([{"position": len(before) + at, "deleted": 0, "inserted": " "}])
        assert doc.n_tokens == count(doc.text)
        doc.apply([{"position": len(before) + at, "deleted": 1, "inserted": ""}])
        assert doc.text == before + mark + after and doc.n_tokens == count(doc.text)
        doc.apply([{"position": len(before), "deleted": at, "inserted": mark[:at] + mark}])
        assert doc.n_tokens == count(doc.text)
        is_consistent(doc)
