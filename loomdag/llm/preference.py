"""Preference formatting of paired conversations, in DataFrame functions.

A pair names a chosen and a rejected conversation. Their longest common turn prefix is
rendered once, as the prompt; what follows on either side is rendered as a completion.
The result has a row per turn, not per conversation, so that a conversation of any
length is spread over tasks; a row's ``learn`` says whether its text is in the loss
(the assistant's turns of completions) or masked.

The prefix is found without gathering a conversation: the turns of one number on one
side are summed up by count and two hash sums, both sides meet on (pair, turn), and the
least turn that differs ends the prefix.

Defined results: a null role or text counts as empty; a null turn number comes first;
turns of one conversation with the same number form one turn with all their texts,
compared whatever their order and all rendered; a pair with a missing conversation has
an empty prefix and the other side's completion; equal conversations give a prompt and
no completion; a conversation may be in many pairs; no pairs give no rows; other columns
of ``turns`` are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdag.llm.common import global_prefix, write_table

#: Fixed value: the rendered form of a turn.
TURN = "<|%s|>\n%s<|end|>\n"
FIRST = -(2**63)
LAST = 2**63 - 1


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) and ``pairs`` (pair_id, chosen_id,
    rejected_id) give pair_id, part (prompt, chosen, rejected), conv_id, turn, role,
    rendered, learn."""
    clean = turns.select(
        F.col("conv_id").alias("__conv"), "turn", F.coalesce("turn", F.lit(FIRST)).alias("__turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("__text"),
    )
    sides = write_table(
        pairs.select("pair_id", F.col("chosen_id").alias("__of"), F.lit("chosen").alias("__side"))
        .unionByName(pairs.select("pair_id", F.col("rejected_id").alias("__of"), F.lit("rejected").alias("__side"))),
        "preference-sides",
    )
    # exact decimal sums: order and overflow don't matter
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    prints = write_table(
        clean.groupBy("__conv", "__turn").agg(
            F.count(F.lit(1)).alias("n"), total("role", "__text").alias("s"), total(F.lit(7), "__text", "role").alias("r")
        ),
        "preference-prints",
    )
    both = prints.join(sides, F.col("__conv") == F.col("__of")).select("pair_id", "__side", "__turn", F.struct("n", "s", "r").alias("p"))
    at = both.groupBy("pair_id", "__turn").agg(
        F.max(F.when(F.col("__side") == "chosen", F.col("p"))).alias("c"), F.max(F.when(F.col("__side") == "rejected", F.col("p"))).alias("r")
    )
    ends = at.filter(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("__turn").alias("__end"))
    ends = write_table(ends.withColumnRenamed("pair_id", "__pair"), "preference-ends")
    bounded = write_table(
        sides.join(ends, F.col("pair_id") == F.col("__pair"), "left").select("pair_id", "__of", "__side", F.coalesce("__end", F.lit(LAST)).alias("__end")),
        "preference-bounds",
    )
    met = clean.join(bounded, F.col("__conv") == F.col("__of"))
    in_prompt = F.col("__turn") < F.col("__end")
    rendered = F.format_string(TURN, "role", "__text")
    return met.filter(~in_prompt | (F.col("__side") == "chosen")).select(
        "pair_id", F.when(in_prompt, F.lit("prompt")).otherwise(F.col("__side")).alias("part"), F.col("__conv").alias("conv_id"),
        "turn", "role", rendered.alias("rendered"), (~in_prompt & (F.col("role") == "assistant")).alias("learn"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations that are neighbours in the order of (first turn's text, id).

    The first turn is the one of the least number (a null number comes first), whatever
    that is. Conversations that begin alike stand together; each is in one pair, and of an
    odd number the last has no partner: its ``rejected_id`` is null. ``chosen_id`` is the
    first of the two, ``pair_id`` the number of the pair. Turns without a ``conv_id``
    belong to no conversation.
    """
    first = F.min(F.struct(F.coalesce("turn", F.lit(FIRST)).alias("n"), F.coalesce("text", F.lit("")).alias("t")))
    heads = turns.filter("conv_id is not null").groupBy("conv_id").agg(first.alias("__first")).select("conv_id", F.col("__first.t").alias("__head"))
    placed = global_prefix(heads, ["__head", "conv_id"], [], "preference-order")
    return placed.groupBy(F.expr("__index div 2").alias("pair_id")).agg(
        F.max(F.when(F.col("__index") % 2 == 0, F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(F.col("__index") % 2 == 1, F.col("conv_id"))).alias("rejected_id"),
    )
