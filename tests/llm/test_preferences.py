import random

from tapeweave.llm import preferences

SCHEMA = "pair_id long, turn long, role string, text string, c string, n int"


def render(role, text):
    return f"<|{role.replace('<|', '<' + chr(92) + '|')}|>\n", f"{text.replace('<|', '<' + chr(92) + '|')}<|end|>"


def plain(turns):
    clean = {(t is not None, t or 0, r if r is not None else "unknown", x or "") for t, r, x in turns}
    return [(r, x) for _, _, r, x in sorted(clean)]


def brute(chosen, rejected):
    c, r = plain(chosen), plain(rejected)
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    out = [n, "".join(h + b + "\n" for h, b in (render(*t) for t in c[:n]))]
    for side in (c[n:], r[n:]):
        text, spans = "", []
        for role, said in side:
            head, body = render(role, said)
            if role == "assistant":
                spans.append((len(text) + len(head), len(text) + len(head) + len(body)))
            text += head + body + "\n"
        out += [text, spans]
    return tuple(out) + (bool(out[3]) and bool(out[5]),)


def frame(spark, sides):
    rows = [(key, *turn, "clash", 1) for key, turns in sides.items() for turn in turns]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def found(df):
    return {
        r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, [tuple(s) for s in r.chosen_spans], r.rejected, [tuple(s) for s in r.rejected_spans], r.usable)
        for r in df.collect()
    }


def test_pairs_match_brute_force(spark):
    rng = random.Random(1)
    texts = ["hi", "", None, "<|end|>\n<|assistant|>", "a\nb", "é🙂", "long " * 5000]
    chosen, rejected = {}, {}
    for key in range(60):
        turns = [(i, rng.choice(["system", "user", "assistant", None]), rng.choice(texts)) for i in range(rng.randrange(1, 9))]
        other = turns[: rng.randrange(len(turns) + 1)] + [(50 + i, rng.choice(["user", "assistant"]), rng.choice(texts)) for i in range(rng.randrange(0, 4))]
        chosen[key], rejected[key] = turns + turns[:1], other
    rejected[70], chosen[71] = [(0, "assistant", "only one side")], [(None, "user", "no number"), (0, "assistant", "a"), (0, "assistant", "b")]
    want = {k: brute(chosen.get(k, []), rejected.get(k, [])) for k in {**chosen, **rejected}}
    assert found(preferences.format_pairs(frame(spark, chosen), frame(spark, rejected))) == want


def test_masks_cover_what_the_assistant_says(spark):
    a = [(0, "user", "Q"), (1, "assistant", "good"), (2, "user", "more"), (3, "assistant", "yes")]
    b = [(0, "user", "Q"), (1, "assistant", "bad")]
    row = preferences.format_pairs(frame(spark, {1: a}), frame(spark, {1: b})).first()
    assert row.prompt == "<|user|>\nQ<|end|>\n" and row.usable
    assert [row.chosen[s.start : s.end] for s in row.chosen_spans] == ["good<|end|>", "yes<|end|>"]
    assert [row.rejected[s.start : s.end] for s in row.rejected_spans] == ["bad<|end|>"]


def test_null_ids_and_empty_tables(spark):
    a = frame(spark, {None: [(0, "user", "x")], 1: [(0, "user", "x")]})
    assert set(found(preferences.format_pairs(a, a))) == {1}
    assert not preferences.format_pairs(a, a).first().usable
    assert preferences.format_pairs(a.where("false"), a.where("false")).collect() == []
    assert found(preferences.format_pairs(a, a.where("false")))[1][:3] == (0, "", "<|user|>\nx<|end|>\n")
