"""Preference formatting: one prompt and a pair of masked completions, with DataFrame functions only.

Chosen and rejected conversations are tables of turns: pair_id, turn, role
and text.  Turns are laid side by side by their number; the longest common
prefix ends before the smallest number at which role or text differ or one
side has no turn.  The prefix is rendered once, as the prompt, and the rest of
either side as its completion.  ``loss`` has the spans of a completion (in
code points, the end exclusive, "start-end" joined by commas) that bear loss: the texts of the assistant and
the marks that end them.

A part of very many turns is given in rows of ``BLOCK`` turn numbers, in order, so no
conversation is ever collected whole; the usual one has one row for each part.

Defined results: a null turn comes before all others, a null role or text
counts as empty; of rows that repeat a turn of one side the smallest by (role, text)
counts; null ids are one pair; a pair whose sides are equal has a prompt and
no completions, and one that has nothing in common has no prompt; a side
that ends at the prefix has no row for its completion; marks inside texts
are broken up by a space, so that texts cannot forge turns; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"      # fixed values: the ChatML marks
ASSISTANT = "assistant"


def _turns(df: DataFrame, side: str) -> DataFrame:
    return df.select("pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.struct(
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias(side))


def side_by_side(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, turn, chosen and rejected (role and text; null: no such turn), common."""
    both = _turns(chosen, "chosen").unionByName(_turns(rejected, "rejected"), allowMissingColumns=True)
    turns = both.groupBy("pair_id", "turn").agg(F.min("chosen").alias("chosen"), F.min("rejected").alias("rejected"))
    split = (turns.where(~F.col("chosen").eqNullSafe(F.col("rejected")))
             .groupBy("pair_id").agg(F.min("turn").alias("split")).withColumnRenamed("pair_id", "_id"))
    return (turns.join(split, F.col("pair_id").eqNullSafe(F.col("_id")), "left")
            .select("pair_id", "turn", "chosen", "rejected",
                    F.coalesce(F.col("turn") < F.col("split"), F.lit(True)).alias("common")))


def _rendered(role: Column, text: Column) -> Column:
    def plain(x):
        return F.replace(x, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE + "\n"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, block: int = BLOCK) -> DataFrame:
    """pair_id, part (prompt, chosen or rejected), block, n_turns, text, loss, n_loss (characters)."""
    def piece(part, side, when):
        return F.when(when & F.col(side).isNotNull(), F.struct(
            F.lit(part).alias("part"), F.col(side)["role"].alias("role"), F.col(side)["text"].alias("text")))

    common = F.col("common")
    pieces = F.array(piece("prompt", "chosen", common), piece("chosen", "chosen", ~common),
                     piece("rejected", "rejected", ~common))
    rows = (side_by_side(chosen, rejected)
            .select("pair_id", "turn", F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p"))
            .select("pair_id", "turn", "p.part", "p.role", "p.text"))
    line = _rendered(F.col("role"), F.col("text"))
    # Loss begins after the line of the role, and ends with the closing mark.
    head = F.length(F.replace(F.col("role"), F.lit("<|"), F.lit("< |"))) + len(OPEN) + 1
    bears = (F.col("part") != "prompt") & (F.col("role") == ASSISTANT)
    rows = rows.select("pair_id", "part", F.floor(F.col("turn") / block).alias("block"), F.struct(
        "turn", line.alias("line"), F.when(bears, head).alias("head")).alias("t"))
    packed = rows.groupBy("pair_id", "part", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("spans"))

    def add(s, t):
        n = F.length(t["line"])
        first, end = s["at"] + t["head"], s["at"] + n - 1
        mine = t["head"].isNotNull()
        return F.struct(
            (s["at"] + n).alias("at"), (s["n"] + F.when(mine, end - first).otherwise(0)).alias("n"),
            F.when(mine, F.array_append(s["spans"], F.concat_ws("-", first.cast("string"), end.cast("string"))))
            .otherwise(s["spans"]).alias("spans"))

    return (packed.withColumn("m", F.aggregate("ts", begin, add))
            .select("pair_id", "part", "block", F.size("ts").alias("n_turns"),
                    F.array_join(F.transform("ts", lambda t: t["line"]), "").alias("text"),
                    F.array_join("m.spans", ",").alias("loss"), F.col("m.n").alias("n_loss")))


def broken_off(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations.

    Chosen is a conversation up to its last answer of the assistant;
    rejected is the same with that answer broken off half-way.
    Conversations without an answer give no pair.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = (turns.where(F.col("role") == ASSISTANT).groupBy("pair_id")
            .agg(F.max("turn").alias("last")).withColumnRenamed("pair_id", "_id"))
    upto = (turns.join(last, F.col("pair_id").eqNullSafe(F.col("_id")))
            .where(F.coalesce(F.col("turn") <= F.col("last"), F.lit(True))))
    names = ["pair_id", "turn", "role"]
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    cut = F.when((F.col("turn") == F.col("last")) & (F.col("role") == ASSISTANT), half).otherwise(F.col("text"))
    return upto.select(*names, "text"), upto.select(*names, cut.alias("text"))
