"""Preference formatting with DataFrame functions only.

A chosen and a rejected conversation share their longest common prefix of turns (equal role
and text).  The prefix is rendered once as the prompt; what remains of either side is its
completion, with the character spans that a loss should count: the text and end mark of
assistant turns.  The prompt never counts.

Turns are ordered by turn, role, text, nulls first; repeated rows are turns of their own.  A
null role is rendered as `unknown`, a null text as empty, and the opening of a marker inside
a text is broken up, so that texts cannot forge turns.  A side that is missing is empty; of
two equal conversations both completions are empty.  Rows without a conversation id belong to
none and are left out.  Extra columns are ignored; an empty table gives an empty result.  A
conversation is one row in the end, so its turns meet in one task; nothing larger does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, array<struct<turn, role, text>>."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _head(turn: Column) -> Column:
    # a role that would end its own head or begin another one can't
    role = F.translate(F.coalesce(turn["role"], F.lit("unknown")), "<|>\n\r", "_____")
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    kind = "struct<at:int,spans:array<struct<first:int,last:int>>>"

    def add(state: Column, turn: Column) -> Column:
        first = state["at"] + F.length(_head(turn))
        last = first + F.length(_body(turn))
        own = F.array(F.struct(first.alias("first"), last.alias("last")))
        return F.struct(last.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans")).cast(kind)

    start = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(kind)
    return F.aggregate(turns, start, add)["spans"]


def paired(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Of two frames (pair_id, turns), pair_id, n_prefix, prompt, and text and spans of both completions."""
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = chosen.select("pair_id", F.col("turns").alias("c")).join(rejected.select("pair_id", F.col("turns").alias("r")), "pair_id", "full")
    both = both.select("pair_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first_unlike = F.array_position(same, F.lit(False)).cast("int")
    n = F.when(first_unlike > 0, first_unlike - 1).otherwise(F.size("c"))
    cut = both.withColumn("n_prefix", n)
    cut = cut.select("pair_id", "n_prefix", F.slice("c", F.lit(1), F.col("n_prefix")).alias("p"), *(F.slice(s, F.col("n_prefix") + 1, F.size(s)).alias(s) for s in ("c", "r")))
    return cut.select("pair_id", "n_prefix", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _spans(F.col("c")).alias("chosen_spans"), _rendered(F.col("r")).alias("rejected"), _spans(F.col("r")).alias("rejected_spans"))


def neighbours_paired(turns: DataFrame) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) as pair n."""
    all_of = conversations(turns).select(F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id").bitwiseAND(1) == 0).alias("is_chosen"), "turns")
    return paired(all_of.where("is_chosen"), all_of.where(~F.col("is_chosen")))
