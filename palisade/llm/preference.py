"""Preference pairs: the common start of two conversations once as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How one turn is rendered around its text; the closing mark belongs to the turn and is trained on.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def _opening(turn: Column) -> Column:
    before, after = OPEN.split("{role}")
    return F.concat(F.lit(before), turn["role"], F.lit(after))


def _closing(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t), _closing(t))), "")


def _spans(turns: Column) -> Column:
    """Character ranges [start, end) of assistant texts with their closing marks."""
    empty = F.lit(0).cast("long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc, t):
        start = acc["at"] + F.char_length(_opening(t))
        end = start + F.char_length(_closing(t))
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(
            end.cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span)))
            .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(empty.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame, pair: str = "pair_id", chosen: str = "chosen", turn: str = "turn",
                     role: str = "role", text: str = "text") -> DataFrame:
    """One row a pair: prompt, the two completions, and what of them is trained on.

    `turns` has a row a turn; `chosen` (boolean) tells the side. Turns of a side are ordered by
    (turn, role, text), nulls first; exact repeats of a turn count once; a null role is 'user' and
    a null text ''. The prompt is the longest run of leading turns with equal role and text on both
    sides, rendered once. `*_mask` lists the [start, end) character ranges of assistant turns in a
    completion; all else there, and the whole prompt, is masked out. If the sides are equal both
    completions are ''. A pair with one side missing has an empty prompt and a null completion for
    that side. Rows with a null pair or side belong to no pair. Other columns are ignored.
    """
    rows = turns.select(
        F.col(pair).alias("pair_id"), F.col(chosen).alias("_side"), F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_turn"),
    ).where("pair_id is not null and _side is not null")
    ordered = lambda side: F.array_sort(F.collect_set(F.when(side, F.col("_turn"))))
    sides = rows.groupBy("pair_id").agg(
        ordered(F.col("_side")).alias("a"), ordered(~F.col("_side")).alias("b"))
    bare = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & (bare(x) == bare(y)))
    first = F.array_position(same, False)
    shared = F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int")
    cut = sides.withColumn("n_prompt_turns", shared)
    tail = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    cut = cut.select(
        "pair_id", "n_prompt_turns", F.slice("a", 1, F.col("n_prompt_turns")).alias("p"),
        tail("a").alias("ta"), tail("b").alias("tb"), (F.size("a") > 0).alias("has_a"), (F.size("b") > 0).alias("has_b"))
    return cut.select(
        "pair_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), _render(F.col("p")).alias("prompt"),
        F.when(F.col("has_a"), _render(F.col("ta"))).alias("chosen"),
        F.when(F.col("has_a"), _spans(F.col("ta"))).alias("chosen_mask"),
        F.when(F.col("has_b"), _render(F.col("tb"))).alias("rejected"),
        F.when(F.col("has_b"), _spans(F.col("tb"))).alias("rejected_mask"))
