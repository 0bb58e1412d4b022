"""Chat formatting: logged conversations that are prefixes of longer ones collapse into them before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.llm.common import running_sums, work_table

#: What stands around a turn, and the turns of one rendered part.
OPEN, CLOSE, PART = "<|im_start|>", "<|im_end|>", 64


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the template. Markers inside it lose their bars; a null role is `unknown`, a null text is empty."""
    plain = lambda c: F.replace(F.replace(c, F.lit(OPEN), F.lit(OPEN.replace("|", ""))), F.lit(CLOSE), F.lit(CLOSE.replace("|", "")))
    return F.concat(F.lit(OPEN), plain(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), plain(F.coalesce(text, F.lit(""))), F.lit(CLOSE + "\n"))


def prefix_states(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked turns, states): each turn with its place `n` in its conversation, and (conv_id, n, s1, s2), the 128-bit rolling hash of its first n turns.

    A turn's term hashes its place, role and text, so that a state is the running sum of terms. Both running sums run over sorted
    ranges, so that a conversation of any length spreads over tasks.
    """
    one = turns.dropDuplicates(["conv_id", "turn", "role", "text"]).withColumn("key", F.col("conv_id").cast("string")).withColumn("one", F.lit(1).cast("bigint"))
    ranked = work_table(running_sums(one, "key", ["turn", "role", "text"], ["one"]).withColumn("n", F.col("one_before") + 1).drop("one", "one_before"))
    terms = ranked.select("conv_id", "key", "n", F.xxhash64("n", "role", F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text", "n", F.lit(3), "role").alias("t2"))
    sums = running_sums(terms, "key", ["n"], ["t1", "t2"])
    # one more hash per term keeps the sum inside 64 bits without overflow errors
    states = work_table(sums.select("conv_id", "n", F.xxhash64("t1_before", "t1").alias("s1"), F.xxhash64("t2_before", "t2").alias("s2")))
    return ranked, states


def maximal(states: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged): conversations that no longer one continues; of equal ones, the smallest id stands for all `n_logged`."""
    key = ["n", "s1", "s2"]
    last = states.groupBy("conv_id").agg(F.max(F.struct("n", "s1", "s2")).alias("s")).select("conv_id", "s.*")
    ended = work_table(last.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged")))
    passed = states.groupBy(*key).agg(F.count("*").alias("n_passed"))
    continued = passed.join(ended, key).where("n_passed > n_logged").select(*key)
    return ended.join(continued, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_logged")


def format_chats(conversations: DataFrame, part_turns: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, n_logged, text): the rendered maximal conversations, `part_turns` turns to a part; most have one part, and a conversation's text is its parts' in their order.

    `conversations` has rows (conv_id, turn, role, text); ids and turn numbers may have any type that has an order, such as text. Turns stand in the order of turn, role and text, nulls first. Equal rows count
    once. Rows without a conv_id belong to no conversation and are left out. A conversation collapses if its turns (roles and texts) are
    the first turns of a longer one, or all turns of one with a smaller id.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ranked, states = prefix_states(turns)
    kept = ranked.join(maximal(states), "conv_id")
    pieces = kept.select("conv_id", F.floor((F.col("n") - 1) / part_turns).cast("int").alias("part"), "n_turns", "n_logged", "n", render_turn(F.col("role"), F.col("text")).alias("piece"))
    parts = pieces.groupBy("conv_id", "part", "n_turns", "n_logged").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("p"))
    return parts.select("conv_id", "part", "n_turns", "n_logged", F.array_join("p.piece", "").alias("text"))
