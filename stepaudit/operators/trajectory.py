"""Trajectories from JSON lines: typed message values as text, runs, and labelled targets with their rules.

The type of a value decides its text (a string is itself, anything else JSON text as Python writes it),
so types are read from VARIANT columns. Only values that are no strings go to Python; the rest, which
is nearly all, stays in the JVM. Broken labels are named, not raised, and never become targets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from stepaudit.functions import texts
from stepaudit.operators import envelope, features, redact, rules

#: Fixed value: the task of a run without a question.
DEFAULT_TASK = "Conversation task"
LABELS = [-1, 0, 1]

_CALL = "struct<id:string,function:struct<name:string,arguments:string>>"
_MESSAGE = "role string, content string, name string, tool_call_id string, tool_calls array<string>"


def kind_of(raw: Column, path: str) -> Column:
    """The JSON type of a value by name ('STRING', 'VOID' for null, ...), or null if it is missing or ``raw`` repeats a key."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant"))


def value_text(kind: Column, value: Column, falsy_is_empty: bool = False) -> Column:
    """The text of a value of a type; ``value`` is a string's own text, or the JSON text of anything else."""
    return F.when(kind == "STRING", value).otherwise(texts.json_text_of(F.when(kind != "STRING", value), falsy_is_empty))


@F.pandas_udf(ArrayType(StringType()))
def _texts_of(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [texts.json_text(x) for x in v], na_action="ignore")


def _optional(raw: Column, key: str, value: Column) -> Column:
    """A name or id as text; null where it is missing, null, empty, false or zero."""
    kind = kind_of(raw, f"$.{key}")
    return F.when((kind == "STRING") & (value != ""), value).when((kind != "STRING") & ~value.isin("false", "0", "0.0", "[]", "{}", "null"), value)


def runs_of(rows: DataFrame) -> DataFrame:
    """``run_id, task`` of rows ``subset, query_index, sample_index, line``; without a question, the default task."""
    kind = kind_of(F.col("line"), "$.question")
    asked = value_text(kind, F.from_json("line", "question string")["question"], True)
    return rows.select(run_name(), F.coalesce(F.nullif(asked, F.lit("")), F.lit(DEFAULT_TASK)).alias("task"))


def run_name() -> Column:
    return F.concat_ws("-", "subset", F.col("query_index").cast("string"), F.col("sample_index").cast("string")).alias("run_id")


def messages_of(rows: DataFrame) -> DataFrame:
    """``run_id, msg_index, role, content, name, tool_call_id, tool_calls`` of every message, all values as text.

    A missing or falsy content is an empty text; arguments that are missing are empty, and null is
    "null". ``rows`` has ``subset, query_index, sample_index, line``; other columns go through. A
    message that repeats a key has its role and no content.
    """
    spread = rows.withColumn("run_id", run_name()).select(*[c for c in rows.columns if c != "line"], "run_id", F.posexplode(F.from_json("line", "messages array<string>")["messages"]).alias("msg_index", "m"))
    m = spread.withColumns({"v": F.from_json("m", _MESSAGE), "kind": kind_of(F.col("m"), "$.content")})
    content = F.coalesce(value_text(F.col("kind"), F.col("v.content"), True), F.lit(""))
    calls = F.col("v.tool_calls")

    def told(c: Column) -> Column:
        """Arguments that are text already (a missing one is empty)."""
        k = kind_of(c, "$.function.arguments")
        return F.when(k.isNull(), F.lit("")).when(k == "VOID", F.lit("null")).when(k == "STRING", F.get_json_object(c, "$.function.arguments"))

    # The JSON text of the others, in the order of their keys, and null elsewhere, so that most arrays hold nothing for Python.
    other = F.transform(calls, lambda c: F.when(told(c).isNull(), F.from_json(c, "function struct<arguments:string>")["function"]["arguments"]))
    needs = F.exists(other, lambda x: x.isNotNull())
    m = m.withColumns({"content": content, "other": F.when(needs, _texts_of(F.when(needs, other)))})
    made = F.transform(calls, lambda c, j: F.struct(
        _optional(c, "id", F.get_json_object(c, "$.id")).alias("id"),
        F.struct(F.get_json_object(c, "$.function.name").alias("name"), F.coalesce(told(c), F.get(F.col("other"), j)).alias("arguments")).alias("function")))
    keep = [c for c in rows.columns if c != "line"]
    return m.select(
        *keep, "run_id", "msg_index", F.col("v.role").alias("role"), "content", _optional(F.col("m"), "name", F.col("v.name")).alias("name"),
        _optional(F.col("m"), "tool_call_id", F.col("v.tool_call_id")).alias("tool_call_id"), F.coalesce(made, F.array().cast(f"array<{_CALL}>")).alias("tool_calls"),
    )


def labels_of(rows: DataFrame) -> DataFrame:
    """``run_id, key, label, msg_index`` of every entry of ``step_labels``: label is null unless the value is the integer -1, 0 or 1."""
    entries = rows.select(run_name(), F.explode(F.from_json("line", "step_labels map<string,variant>")["step_labels"]).alias("key", "v"))
    number = F.when(F.schema_of_variant("v") == "BIGINT", F.try_variant_get("v", "$", "bigint"))
    return entries.select("run_id", "key", F.when(number.isin(LABELS), number).cast("int").alias("label"), F.when(F.col("key").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.expr("try_cast(trim(key) AS int)")).alias("msg_index"))


def targets(labels: DataFrame, messages: DataFrame) -> DataFrame:
    """All labels with ``reason`` (null: sound) and ``target``, in the numeric order of their keys.

    Reasons: label-index (no message has it), label-role (not an assistant's), label-value, and
    label-repeated (another key of the run names the same message). A sound label is a target unless it
    is on the run's last assistant message or after it.
    """
    run = Window.partitionBy("run_id")
    last = messages.withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("msg_index"))).over(run)).select("run_id", "msg_index", "role", "last")
    twice = (F.count("msg_index").over(Window.partitionBy("run_id", "msg_index")) > 1) & F.col("msg_index").isNotNull()
    known = labels.withColumn("twice", twice).join(last, ["run_id", "msg_index"], "left")
    reason = F.when(F.col("last").isNull() & F.col("role").isNull(), "label-index").when(~F.col("role").eqNullSafe(F.lit("assistant")), "label-role").when(F.col("label").isNull(), "label-value").when(F.col("twice"), "label-repeated")
    made = known.withColumn("reason", reason)
    return made.select("run_id", "key", "msg_index", "label", "reason", (F.col("reason").isNull() & (F.col("msg_index") < F.col("last"))).alias("target"))


def samples(rows: DataFrame) -> DataFrame:
    """Targets of routed rows (``subset, grp, split, query_index, sample_index, line``) with ``rule, text, support_reason``.

    ``rule``: a flag of the run without its last action leads to the message. ``text`` is the prefix
    feature; a target of a run that no envelope can hold is unsupported, as is one beyond ASCII. Rows
    of a test split must not be among them.
    """
    messages = messages_of(rows)
    found = targets(labels_of(rows), messages).where("target").select("run_id", "msg_index", "label")
    steps = features.adapt(messages, exclude_final=True)
    hit = rules.flagged_messages(rules.flags(steps, redact.masked(F.col("content"))), steps).withColumn("hit", F.lit(True))
    text = features.prefix_features(messages)
    route = rows.select("subset", "grp", "split", run_name()).withColumn("split", F.when(F.col("split") == "test", F.raise_error(F.lit("TEST rows have no samples")).cast("string")).otherwise(F.col("split")))
    odd = envelope.incompatible(messages, runs_of(rows)).select("run_id", F.lit(True).alias("odd"))
    made = found.join(route, "run_id").join(text, ["run_id", "msg_index"]).join(hit, ["run_id", "msg_index"], "left").join(odd, "run_id", "left")
    reason = F.when(F.coalesce("odd", F.lit(False)), "incompatible-envelope").when(F.col("feature").rlike(r"[^\x00-\x7F]"), "unsupported-unicode")
    return made.select("run_id", "msg_index", "subset", "grp", "split", "label", F.coalesce("hit", F.lit(False)).alias("rule"), F.col("feature").alias("text"), reason.alias("support_reason"))
