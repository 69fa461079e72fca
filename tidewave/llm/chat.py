"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as prompt; what follows it is rendered as two
completions, each with the character spans that a loss should count (the assistant's turns) and the same as segments with a mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.store import cut

TRAINED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (turn, role, text) in order; a null role or text is empty, rows without a conv_id go."""
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def escaped(text: Column) -> Column:
    """Text that holds no marker: one more backslash in each ``<|``, ``<\\|``, ``<\\\\|``, ...; taking one out of each gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def render(turns: Column) -> Column:
    """Turns as text: a line with the role, the text, an end line.  Markers within roles and texts are escaped, so that no text makes a turn."""
    return F.concat_ws("", F.transform(turns, lambda x: F.concat(F.lit("<|"), escaped(x["role"]), F.lit("|>\n"), escaped(x["text"]), F.lit("<|end|>\n"))))


def segments(turns: Column) -> Column:
    """(text, mask) pieces whose texts joined are render(turns); mask 1 on what the assistant says and its end."""

    def of(x: Column) -> Column:
        head = F.concat(F.lit("<|"), escaped(x["role"]), F.lit("|>\n"))
        body = F.concat(escaped(x["text"]), F.lit("<|end|>\n"))
        return F.array(F.struct(head.alias("text"), F.lit(0).alias("mask")), F.struct(body.alias("text"), (x["role"] == TRAINED).cast("int").alias("mask")))

    return F.flatten(F.transform(turns, of))


def spans(pieces: Column) -> Column:
    """(begin, end) character spans of the pieces with mask 1, in their joined text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        to = s["at"] + F.length(x["text"])
        mine = F.array(F.struct(s["at"].alias("begin"), to.alias("end")))
        return F.struct(to.alias("at"), F.when(x["mask"] == 1, F.concat(s["out"], mine)).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two conversations, by role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    at = F.array_position(same, F.lit(False)).cast("int")
    return F.when(at == 0, F.size(a)).otherwise(at - 1)


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (chosen_id, rejected_id, chosen, rejected: arrays of turns) as prompt and masked completions.

    Equal conversations have all turns in the prompt and empty completions; those without a common turn have an empty prompt.
    """
    n = common_turns(F.col("chosen"), F.col("rejected"))
    rest = lambda c: F.when(F.col("n") < F.size(c), F.slice(F.col(c), F.col("n") + 1, F.size(c))).otherwise(F.slice(F.col(c), 1, 0))
    out = pairs.withColumn("n", n).withColumns({"head": F.slice("chosen", 1, F.col("n")), "c": rest("chosen"), "r": rest("rejected")})
    out = out.withColumns({"cs": segments(F.col("c")), "rs": segments(F.col("r"))})
    return out.select(
        "chosen_id", "rejected_id", F.col("n").cast("int").alias("n_common"), render(F.col("head")).alias("prompt"),
        render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), spans(F.col("cs")).alias("chosen_spans"), spans(F.col("rs")).alias("rejected_spans"),
    )


def _followers(turns: DataFrame) -> DataFrame:
    """conv_id, next_id and alone of every conversation with an assistant's turn.

    next_id is the next conversation with the same opening, by conv_id, the first for the last; a conversation that is alone
    with its opening has the next of the table in the order of openings' hashes, the first for the last.
    """
    first = F.min(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    heads = turns.where("conv_id is not null").groupBy("conv_id").agg(first.alias("x"), F.max(F.coalesce(F.col("role") == TRAINED, F.lit(False))).alias("trained")).where("trained")
    # ranges of openings and ids, so that a hot opening is spread over parts; a part's last row goes on with the first of the next part
    ranged = heads.select("conv_id", F.xxhash64("x.role", "x.text").alias("opening")).repartitionByRange("opening", "conv_id")
    rows = cut(ranged.withColumn("part", F.spark_partition_id()))
    order = F.struct("opening", "conv_id")
    w = Window.partitionBy("part").orderBy("opening", "conv_id")
    rows = rows.withColumn("next", F.lead(order).over(w))
    # one row a part
    parts = rows.groupBy("part").agg(F.min(order).alias("low"))
    all_parts = Window.partitionBy(F.lit(0)).orderBy("part")
    parts = parts.select("part", F.coalesce(F.lead("low").over(all_parts), F.min("low").over(all_parts)).alias("after"))
    openings = rows.groupBy("opening").agg(F.min("conv_id").alias("first_id"), F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = rows.join(F.broadcast(parts), "part").withColumn("next", F.coalesce("next", "after")).join(openings, "opening", "left")
    alone = F.col("c").isNull()
    follower = F.when(alone | (F.col("next.opening") == F.col("opening")) & (F.col("next.conv_id") > F.col("conv_id")), F.col("next.conv_id")).otherwise(F.col("first_id"))
    return rows.select("conv_id", follower.alias("next_id"), alone.alias("alone"))


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs (chosen_id, rejected_id, chosen, rejected) for every conversation of ``turns`` that has an assistant's turn.

    Conversations that open with the same turn are candidates for the same prompt: the rejected one is the next of them, by
    conv_id, the first for the last.  A conversation that is alone there is rejected with its own last assistant's turn
    replaced by that of the next conversation of the table (the only one takes an empty turn);
    rejected_id is the one that the text is from (null: none).
    """
    convs = conversations(turns)
    last = lambda c: F.array_max(F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.when(F.element_at(c, i)["role"] == TRAINED, i)))
    others = convs.select(F.col("conv_id").alias("next_id"), F.col("turns").alias("other"))
    rows = convs.join(_followers(turns), "conv_id").join(others, "next_id").withColumns({"last": last("turns"), "other_last": last("other")})
    own = F.col("next_id") == F.col("conv_id")
    text = F.when(own, F.lit("")).otherwise(F.element_at("other", F.col("other_last"))["text"])
    turn = F.element_at("turns", F.col("last"))
    swapped = F.concat(F.slice("turns", 1, F.col("last") - 1), F.array(F.struct(turn["turn"].alias("turn"), turn["role"].alias("role"), text.alias("text"))))
    return rows.select(
        F.col("conv_id").alias("chosen_id"), F.when(~own, F.col("next_id")).alias("rejected_id"),
        F.col("turns").alias("chosen"), F.when(F.col("alone"), swapped).otherwise(F.col("other")).alias("rejected"),
    )


def op10(turns: DataFrame) -> DataFrame:
    """A preference example of every conversation with an assistant's turn."""
    return format_pairs(neighbours(turns))
