"""Multi-party perspective rotation of conversations, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def rotate_perspectives(turns: DataFrame, system: str = "system") -> DataFrame:
    """Render every dialogue once per participant, with that speaker as the assistant.

    Input: conv_id, turn, role, text. A participant is a distinct non-null role other than ``system``. For each one the
    dialogue is all rows of the conversation by turn (then role and text, nulls first): the participant's rows under
    ``assistant``, system rows under ``system``, the others under ``user name=<role>``. Result, one row per conversation,
    participant and turn: conv_id, perspective, turn, role (as given), rendered, start (characters of the dialogue before
    this row), mask_start and mask_end (the half-open range of the dialogue that is learned: text and end mark of the
    participant's own turns; null where nothing is). Joining ``rendered`` by ``start`` gives the dialogue.

    A dialogue stays dealt over rows: positions are sums within blocks of turns plus sums of blocks, so that one huge
    conversation is neither gathered in one row nor sorted in one task. A null role is an unnamed user and no
    participant, null text is empty, null turns come first, a null conv_id is a conversation of its own. Repeated rows
    are repeated turns. Conversations without participants give no rows, nor does an empty table. Other columns are ignored,
    whatever their names. A text may be of any length: it is moved as a row's value and only its length is added up.
    """
    t = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("block", F.floor(F.col("turn") / BLOCK))
    # A null-safe key: joins on conv_id and block must not lose nulls.
    key = F.struct(F.col("conv_id"), F.col("conv_id").isNull())
    t = t.withColumn("ck", F.to_json(key)).withColumn("bk", F.coalesce("block", F.lit(-(2**62))))
    who = t.where(F.col("role").isNotNull() & (F.col("role") != system)).select("ck", F.col("role").alias("perspective")).distinct()
    spread = t.select("ck", "bk").distinct().join(who, "ck")
    own = F.col("role").eqNullSafe(F.col("perspective"))
    label = (
        F.when(own, F.lit("assistant"))
        .when(F.col("role") == system, F.lit(system))
        .when(F.col("role").isNull(), F.lit("user"))
        .otherwise(F.concat(F.lit("user name="), "role"))
    )
    start_mark = F.concat(F.lit("<|im_start|>"), label, F.lit("\n"))
    body = F.concat("text", F.lit("<|im_end|>\n"))
    lines = t.join(spread, ["ck", "bk"]).select(
        "ck", "bk", "conv_id", "perspective", "turn", "role", own.alias("own"), F.length(start_mark).cast("long").alias("head"),
        F.concat(start_mark, body).alias("rendered"),
    ).withColumn("size", F.length("rendered").cast("long"))
    sums = lines.groupBy("ck", "perspective", "bk").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("ck", "perspective").orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select("ck", "perspective", "bk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("ck", "perspective", "bk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "rendered").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(blocks, ["ck", "perspective", "bk"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.select(
        "conv_id", "perspective", "turn", "role", "rendered", "start",
        F.when(F.col("own"), F.col("start") + F.col("head")).alias("mask_start"), F.when(F.col("own"), F.col("start") + F.col("size")).alias("mask_end"),
    )
