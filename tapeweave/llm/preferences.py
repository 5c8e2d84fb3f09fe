"""Preference formatting of chosen and rejected conversations, in DataFrame operations alone.

Both conversations of a pair are ordered by turn; their longest common prefix of turns (same role
and text) is rendered once as the prompt, and what follows becomes the two completions. A mask
goes with each completion: the character spans of assistant turns, closing mark included, that a
loss should see. Marks that occur inside a text are broken with a backslash, so a rendered turn
cannot be forged from within.

Defined results: exactly repeated turn rows count once, other rows with the same turn number are
ordered by role and text; turns without a number come first; a null role is rendered as
``unknown``, a null text as empty (and equal to an empty one); rows with a null pair id belong to no pair; a pair with one
side missing has an empty prompt and an empty completion there; ``usable`` is true if both
completions train on something; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<|", "<|end|>"
TRAINED = "assistant"

_SAFE = "replace({0}, '<|', '<\\\\|')"
_HEAD = f"concat('{OPEN}', {_SAFE.format('t.role')}, '|>\\n')"
_BODY = f"concat({_SAFE.format('t.text')}, '{CLOSE}')"


def _side(turns: DataFrame, name: str, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.select(
        F.col(id_col).alias("pair_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    ).where("pair_id IS NOT NULL")
    return rows.groupBy("pair_id").agg(F.sort_array(F.collect_set("t")).alias(name))


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat({_HEAD}, {_BODY}, '\\n')), '')"


def _spans(turns: str) -> str:
    """Start and end, in characters of the rendered completion, of what assistant turns say."""
    kind = "array<struct<start:int,end:int>>"
    start, end = f"a.at + length({_HEAD})", f"a.at + length({_HEAD}) + length({_BODY})"
    return f"""aggregate({turns}, struct(0 AS at, cast(array() AS {kind}) AS spans), (a, t) -> struct(
        {end} + 1 AS at,
        CASE WHEN t.role = '{TRAINED}' THEN concat(a.spans, array(struct({start} AS start, {end} AS end))) ELSE a.spans END AS spans
    ), a -> a.spans)"""


def format_pairs(
    chosen: DataFrame,
    rejected: DataFrame,
    id_col: str = "pair_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per pair: pair_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans, usable."""
    names = (id_col, turn_col, role_col, text_col)
    pairs = _side(chosen, "c", *names).join(_side(rejected, "r", *names), "pair_id", "full")
    none = "cast(array() AS array<struct<turn:bigint,role:string,text:string>>)"
    pairs = pairs.select("pair_id", *[F.expr(f"coalesce({x}, {none})").alias(x) for x in "cr"])
    same = """zip_with(slice(c, 1, least(size(c), size(r))), slice(r, 1, least(size(c), size(r))),
        (x, y) -> x.role = y.role AND x.text = y.text)"""
    pairs = pairs.withColumn("same", F.expr(same))
    first = F.expr("CASE WHEN array_position(same, false) > 0 THEN array_position(same, false) - 1 ELSE size(same) END")
    pairs = pairs.withColumn("n", first.cast("int"))
    parts = pairs.select(
        "pair_id", "n", F.expr("slice(c, 1, n)").alias("p"),
        *[F.expr(f"slice({x}, n + 1, greatest(size({x}) - n, 0))").alias(x) for x in "cr"],
    )
    out = parts.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), F.expr(_rendered("p")).alias("prompt"),
        F.expr(_rendered("c")).alias("chosen"), F.expr(_spans("c")).alias("chosen_spans"),
        F.expr(_rendered("r")).alias("rejected"), F.expr(_spans("r")).alias("rejected_spans"),
    )
    return out.withColumn("usable", (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0))
