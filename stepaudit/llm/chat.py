"""Chat formatting: every participant's view of a multi-party dialogue.

For each participant the whole dialogue is rendered with that speaker's turns as the assistant's
and all others' as named users'; the loss mask covers the assistant's text and end mark. Only
built-in functions are used.

A rendering is a sequence of segments, one row for each turn, with the segment's place in
the rendered dialogue; so no dialogue, however long, is gathered in one task. Places are two-level
prefix sums: the lengths of blocks of ``BLOCK`` turns are summed first, then those within a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 256
UNNAMED = "unnamed"
END = "<|end|>\n"


def _before(part: list[str], order: list[Column | str], value: Column | str) -> Column:
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_role: str | None = "system"
) -> DataFrame:
    """``conv_id, speaker, turn, role, segment, start, length, mask_start, mask_length`` per speaker and turn.

    ``start`` and ``mask_start`` count characters from the rendering's beginning; the mask is null
    where the turn is not the speaker's. Turns of ``system_role`` (None: there is none) stay system
    turns in every rendering and are no participant's.

    Defined cases: a null text is an empty one; a null role is the participant ``unnamed``; a null
    conversation is a conversation of its own; a null turn comes first; turns that tie are ordered
    by role, then text; equal rows each give a segment; a dialogue of system turns only, and an
    empty table, give no rows; other columns are ignored.
    """
    base = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(UNNAMED)).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    system = F.col("name") == F.lit(system_role) if system_role is not None else F.lit(False)
    people = base.where(~system).select(F.col("conv_id").alias("c2"), F.col("name").alias("speaker")).distinct()
    own = F.col("name") == F.col("speaker")
    head = (
        F.when(system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user:"), F.col("name"), F.lit("|>\n")))
    )
    made = (
        base.join(people, F.col("conv_id").eqNullSafe(F.col("c2")))
        .withColumn("head", head)
        .select(
            "conv_id", "speaker", "turn", "name", "text",
            F.when(system, "system").when(own, "assistant").otherwise("user").alias("role"),
            F.concat("head", "text", F.lit(END)).alias("segment"), F.length("head").cast("long").alias("h"),
            F.floor(F.col("turn") / BLOCK).alias("block"),
        )
        .withColumn("length", F.length("segment").cast("long"))
    )
    blocks = made.groupBy("conv_id", "speaker", "block").agg(F.sum("length").alias("size"))
    bases = blocks.select(
        F.col("conv_id").alias("c2"), F.col("speaker").alias("s2"), F.col("block").alias("b2"),
        _before(["conv_id", "speaker"], ["block"], "size").alias("base"),
    )
    inner = _before(["conv_id", "speaker", "block"], ["turn", "name", "text"], "length")
    placed = made.withColumn("inner", inner).join(
        bases, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("speaker") == F.col("s2")) & F.col("block").eqNullSafe(F.col("b2"))
    )
    start = F.col("base") + F.col("inner")
    mine = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "speaker", "turn", "role", "segment", start.alias("start"), "length",
        F.when(mine, start + F.col("h")).alias("mask_start"), F.when(mine, F.col("length") - F.col("h")).alias("mask_length"),
    )
