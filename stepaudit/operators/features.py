"""Prefix features: a window of three message slots as text; answer tags are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slots, characters of a part and of a feature, roles with text, and the tag's stand-in.
SLOTS, PART_CHARS, FEATURE_CHARS = 3, 4000, 12000
ROLES = ["assistant", "user", "tool"]
ANSWER, OMITTED = r"(?is)<an[sſ]wer>.*?</an[sſ]wer>", "[answer omitted]"


def part(content: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(content, F.lit("")), ANSWER, OMITTED), 1, PART_CHARS)


def calls_of(messages: DataFrame, any_role: bool = False) -> Column:
    """Tool calls of assistants; those of other roles (unless ``any_role``), and a null array, are none."""
    none = F.array().cast(messages.schema["tool_calls"].dataType)
    calls = F.coalesce("tool_calls", none)
    return calls if any_role else F.when(F.col("role") == "assistant", calls).otherwise(none)


def unsupported(messages: DataFrame) -> DataFrame:
    """``run_id, msg_index, reason`` of the first message of a run whose role is unknown or null; such a run has no steps."""
    bad = messages.where(~F.coalesce(F.col("role").isin([*ROLES, "system"]), F.lit(False)))
    return bad.groupBy("run_id").agg(F.min("msg_index").alias("msg_index")).withColumn("reason", F.lit("unsupported-role"))


def adapt(messages: DataFrame, exclude_final: bool = False) -> DataFrame:
    """Steps of messages ``run_id, msg_index, role, content[, tool_calls]``: user is task, tool is tool_result.

    System messages give no step. Every tool call of an assistant is a step after its message. A run
    with a role that :func:`unsupported` names is left out whole. ``exclude_final`` ends a run before
    its last assistant message and leaves answer tags out. ``pos`` counts from 1.
    """
    run = Window.partitionBy("run_id")
    known = F.coalesce(F.col("role").isin([*ROLES, "system"]), F.lit(False))
    messages = messages.withColumn("__ok", F.every(known).over(run)).where("__ok").drop("__ok")
    if exclude_final:
        last = F.max(F.when(F.col("role") == "assistant", F.col("msg_index"))).over(run)
        messages = messages.withColumn("__last", F.coalesce(last, F.lit(-1))).where("msg_index < __last").drop("__last")
        messages = messages.withColumn("content", F.regexp_replace("content", ANSWER, OMITTED))
    kind = F.when(F.col("role") == "user", "task").when(F.col("role") == "assistant", "assistant").when(F.col("role") == "tool", "tool_result")
    first = F.concat(F.lit("m"), "msg_index")
    none = F.lit(None).cast("string")

    def given(name: str) -> Column:
        """A tool message's name or id; an empty one counts as absent."""
        return F.when(F.col("role") == "tool", F.nullif(F.col(name), F.lit(""))) if name in messages.columns else none

    own = F.array(F.struct(first.alias("id"), kind.alias("kind"), F.coalesce("content", F.lit("")).alias("content"),
                           given("name").alias("tool"), given("tool_call_id").alias("call_id")))
    steps = own
    if "tool_calls" in messages.columns:
        calls = F.transform(calls_of(messages), lambda c, j: F.struct(
            F.concat(first, F.lit("-call"), j).alias("id"), F.lit("tool_call").alias("kind"), F.coalesce(c["function"]["arguments"], F.lit("")).alias("content"),
            c["function"]["name"].alias("tool"), F.coalesce(F.nullif(c["id"], F.lit("")), F.concat(first, F.lit("-call"), j)).alias("call_id")))
        steps = F.concat(own, calls)
    out = messages.where(kind.isNotNull()).select("run_id", "msg_index", F.posexplode(steps).alias("j", "s")).select("run_id", "msg_index", "j", "s.*")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("msg_index", "j"))
    return out.withColumn("pos", place).drop("j").withColumn("status", none)


def prefix_features(messages: DataFrame) -> DataFrame:
    """``run_id, msg_index, feature`` of every assistant message but the run's last.

    A slot without text (a system message) takes a place in the window. Nothing after the message
    itself is read.
    """
    text = F.concat("role", F.lit(" "), part(F.col("content")))
    if "tool_calls" in messages.columns:
        calls = F.transform(calls_of(messages, any_role=True), lambda c: F.concat(F.coalesce(c["function"]["name"], F.lit("")), F.lit(" "), F.substring(F.coalesce(c["function"]["arguments"], F.lit("")), 1, PART_CHARS)))
        text = F.array_join(F.concat(F.array(text), calls), "\n")
    slot = F.when(F.col("role").isin(ROLES), text)
    run = Window.partitionBy("run_id")
    order = run.orderBy("msg_index")
    last = F.max(F.when(F.col("role") == "assistant", F.col("msg_index"))).over(run)
    joined = F.array_join(F.collect_list(slot).over(order.rowsBetween(1 - SLOTS, 0)), "\n")
    made = messages.withColumns({"last": last, "feature": F.right(joined, F.lit(FEATURE_CHARS))})
    return made.where((F.col("role") == "assistant") & (F.col("msg_index") < F.col("last"))).select("run_id", "msg_index", "feature")
