"""Preference formatting, in DataFrame functions only.

``pairs`` finds conversations that open alike (equal role and text of the first turn): of each
such group that with the most assistant text (then the smallest id) is chosen, every other
conversation with different turns is rejected against it: one pair per rejected conversation,
never all pairs. A group's chosen conversation is a partial maximum per task, and the join
back is split by the skew join. Pairs from elsewhere (chosen_id, rejected_id) do as well.

``format_pairs`` finds the longest common turn prefix of both, renders it once as prompt, and
renders what is left of each as completion. A mask lists the character ranges [start, end) of
a completion that train: the assistant's texts and the marks that end them.

``format_replies`` makes pairs of one conversation each: its last reply against the one before.

Edge cases: turns are in order of their number; of rows with equal conv_id and turn the first
by (role, text) counts; rows with a null conv_id or turn are left out. A null role renders as
``none``, a null text as an empty one. Marks within a text are broken up by blanks, and so is what
could become part of one in a role (every ``<`` and ``|``), so that only real turns have marks. A conversation that is a prefix of the other has an empty
completion without mask. Copies of the chosen conversation make no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), one row per turn, nulls and marks replaced."""
    rows = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("< |"))
    role = F.replace(F.replace(F.coalesce("role", F.lit("none")), F.lit("<"), F.lit("< ")), F.lit("|"), F.lit(" | "))
    one = rows.groupBy("conv_id", "turn").agg(F.min(F.struct(role.alias("role"), text.alias("text"))).alias("t"))
    return one.select("conv_id", "turn", "t.role", "t.text")


def pairs(own: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id) from the turns of conversations that open alike."""
    said = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)
    each = own.select("conv_id", "turn", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit("g"), "role", "text").alias("g"), said.cast("long").alias("said"))
    # what all turns say, whatever their order of arrival: two sums of hashes (exact decimals)
    mark = lambda c: F.sum(F.xxhash64("turn", c).cast("decimal(20,0)"))
    talks = each.groupBy("conv_id").agg(F.min(F.struct("turn", "h", "g")).alias("first"), F.sum("said").alias("said"), mark("h").alias("m"), mark("g").alias("k"))
    talks = talks.select("conv_id", "first.h", "first.g", "said", "m", "k")
    best = talks.groupBy("h", "g").agg(F.min(F.struct((-F.col("said")).alias("less"), F.col("conv_id").alias("id"), "m", "k")).alias("best"), F.count("*").alias("n")).where("n > 1")
    both = talks.join(best.select("h", "g", "best"), ["h", "g"]).where((F.col("conv_id") != F.col("best.id")) & ((F.col("m") != F.col("best.m")) | (F.col("k") != F.col("best.k"))))
    return both.select(F.col("best.id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"))


def _text(part: Column) -> Column:
    """The turns of an array, rendered."""
    return F.array_join(F.transform(part, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SHUT), t["text"], F.lit(END))), "")


def _mask(part: Column) -> Column:
    """The ranges of an array's rendered turns that train."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + F.lit(len(OPEN) + len(SHUT))
        end = start + F.length(t["text"]) + F.lit(len(END))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(part, none, add, lambda acc: acc["spans"])


def _whole(own: DataFrame) -> DataFrame:
    return own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def format_pairs(own: DataFrame, found: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected,
    rejected_mask per pair of conversations given by their turns."""
    whole = _whole(own)
    both = found.join(whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r")), "rejected_id")
    return _formatted(both.join(whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id"))


def format_replies(own: DataFrame) -> DataFrame:
    """The same, of each conversation up to its last reply (assistant turn) as chosen, and
    with the reply before that in place of the last, if it differs, as rejected."""
    last = lambda c, k: F.get(c, F.size(c) - k)
    two = _whole(own).withColumn("a", F.filter("turns", lambda t: t["role"] == "assistant")).where(F.size("a") > 1)
    two = two.where(last(F.col("a"), 1)["text"] != last(F.col("a"), 2)["text"])
    before = F.filter("turns", lambda t: t["turn"] < last(F.col("a"), 1)["turn"])
    stale = F.struct(last(F.col("a"), 1)["turn"].alias("turn"), F.lit("assistant").alias("role"), last(F.col("a"), 2)["text"].alias("text"))
    return _formatted(two.select(
        F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.concat(before, F.array(last(F.col("a"), 1))).alias("c"), F.concat(before, F.array(stale)).alias("r")))


def _formatted(both: DataFrame) -> DataFrame:
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, False)  # from 1; 0: the conversations are equal
    common = F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int")
    cut = both.select("chosen_id", "rejected_id", "c", "r", common.alias("p"))
    rest = lambda c: F.slice(c, F.col("p") + 1, F.size(c))
    cut = cut.select("chosen_id", "rejected_id", F.col("p").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("p")).alias("common"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        "chosen_id", "rejected_id", "n_prompt_turns", _text(F.col("common")).alias("prompt"), _text(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
        _text(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))
