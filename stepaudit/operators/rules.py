"""Review flags of ordered steps: unmatched and missing results, repeated calls, error-like results.

Two window sorts serve all rules: one by run and call id, one by run and call signature (a hash of
its content, so that long contents stay out of the shuffle key). The flags of a step are exploded
from one array, so the steps are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The words of an error-like result.
WHOLE_WORDS = ["error", "exception", "traceback", "failed", "failure"]
PHRASES = ["permission denied", "not found"]
ERROR = rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(WHOLE_WORDS)})(?![A-Za-z0-9_])|{'|'.join(PHRASES)}"
_AROUND = r"[^\n\r\x{2028}\x{2029}]{0,45}"
SNIPPET = rf"(?i){_AROUND}(?:{'|'.join(WHOLE_WORDS + PHRASES)}){_AROUND}"
REPEATS = 3
#: The rules in the order in which a step emits them, their titles and their caveats.
TITLES = {
    "repeated_call": "Repeated identical tool call",
    "unmatched_result": "Result without preceding matching call",
    "tool_error": "Tool result reports a possible error",
    "missing_result": "Call without matching result",
}
CAVEATS = {
    "repeated_call": "Retries, polling, or deliberate verification can be valid. Repetition alone does not establish a mistake.",
    "unmatched_result": "The export may omit calls or use a different identifier convention.",
    "tool_error": "Expected failures, quoted error text, and useful exploration can be benign. Review the surrounding steps.",
    "missing_result": "The log may be incomplete or this tool may not emit a result.",
}
SEVERITY = "review"
BY_STATUS = "status error"


def _queue(steps: DataFrame) -> DataFrame:
    """Adds ``unmatched`` and ``missing``: first-in-first-out matching as a floored running sum.

    With S the running sum of calls minus results, a result has no call left iff S falls below
    every earlier S and 0. The depth at the end is what remains above the least of them; the
    calls that remain are the last ones.
    """
    whole = Window.partitionBy("run_id", "call_id")
    order = whole.orderBy("pos")
    live = F.coalesce(F.col("call_id") != "", F.lit(False))
    call, result = live & (F.col("kind") == "tool_call"), live & (F.col("kind") == "tool_result")
    x = F.when(call, 1).when(result, -1).otherwise(0)
    s = steps.withColumn("s", F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    floor = F.least(F.lit(0), F.min("s").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    depth = F.sum(x).over(whole) - F.least(F.lit(0), F.min("s").over(whole))
    behind = F.sum(call.cast("int")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return s.withColumns(
        {"unmatched": result & (F.col("s") < F.coalesce(floor, F.lit(0))), "missing": call & (behind <= depth), "first_pos": F.min("pos").over(whole)}
    ).drop("s")


def flags(steps: DataFrame, safe: Column | None = None) -> DataFrame:
    """``run_id, pos, step_id, rule, evidence, phase, place, ordinal`` of every flag.

    ``steps`` has ``run_id, pos, id, kind, content, tool, call_id, status``; ``safe`` is the redacted
    content for snippets. Flags of a run are in order by ``phase, place, ordinal, pos``: missing results
    come after all others, by the first step of their call id. Steps without a call id, or with an
    empty one, are not matched; a null content or tool counts as empty.
    """
    content = F.coalesce("content", F.lit(""))
    same = Window.partitionBy("run_id", "kind", "signature").orderBy("pos")
    made = _queue(steps).withColumn("signature", F.sha2(F.to_json(F.array(F.coalesce("tool", F.lit("")), content)), 256))
    made = made.withColumns({"nth": F.row_number().over(same), "ids": F.collect_list("id").over(same.rowsBetween(1 - REPEATS, 0))})
    result = F.col("kind") == "tool_result"
    by_status = F.coalesce(F.col("status") == "error", F.lit(False))
    snippet = F.regexp_extract(content if safe is None else safe, SNIPPET, 0)
    snippet = F.when(snippet == "", "error term").otherwise(snippet)

    def flag(test: Column, rule: str, evidence: Column, phase: int, place: Column) -> Column:
        return F.when(test, F.struct(F.lit(rule).alias("rule"), evidence.alias("evidence"), F.lit(phase).alias("phase"), place.cast("long").alias("place")))

    pos = F.col("pos")
    found = F.array_compact(F.array(
        flag((F.col("kind") == "tool_call") & (F.col("nth") == REPEATS), "repeated_call", F.array_join("ids", ", "), 0, pos),
        flag(F.col("unmatched"), "unmatched_result", F.col("call_id"), 0, pos),
        flag(result & (by_status | content.rlike(ERROR)), "tool_error", F.when(by_status, F.lit(BY_STATUS)).otherwise(snippet), 1, pos),
        flag(F.col("missing"), "missing_result", F.col("call_id"), 2, F.col("first_pos")),
    ))
    out = made.select("run_id", "pos", F.col("id").alias("step_id"), F.explode(found).alias("f")).select("run_id", "pos", "step_id", "f.*")
    order = F.when(F.col("phase") == 2, F.col("place")).otherwise(F.col("pos"))
    ordinal = F.array_position(F.array(*map(F.lit, TITLES)), F.col("rule")).cast("int")
    return out.withColumns({"place": order, "phase": F.when(F.col("phase") == 2, 1).otherwise(0), "ordinal": ordinal})


def _by_rule(values: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("rule") == rule, v) for rule, v in values.items()])


def records(found: DataFrame) -> DataFrame:
    """Flags as a reviewer reads them: ``flag_id, severity, title, sentence, uncertainty`` are added."""
    e = F.col("evidence")
    sentence = _by_rule(
        {
            "repeated_call": F.concat(F.lit("The same tool and input appear at steps "), e, F.lit(".")),
            "unmatched_result": F.concat(F.lit("Result references call_id "), e, F.lit(", with no unmatched preceding call.")),
            "tool_error": F.when(e == BY_STATUS, 'The result has status "error".').otherwise(F.concat(F.lit("Matched error-like text: "), e)),
            "missing_result": F.concat(F.lit("No later tool result matches call_id "), e, F.lit(".")),
        }
    )
    return found.withColumns(
        {
            "flag_id": F.concat_ws(":", "rule", "step_id"), "severity": F.lit(SEVERITY), "title": _by_rule({k: F.lit(v) for k, v in TITLES.items()}),
            "sentence": sentence, "uncertainty": _by_rule({k: F.lit(v) for k, v in CAVEATS.items()}),
        }
    )


def timeline(steps: DataFrame, found: DataFrame, kind: str | None = None, flagged: bool = False, text: str = "") -> DataFrame:
    """Redacted steps of a kind, with a flag, that hold ``text`` in id, content, tool or flag titles, in lower case.

    ``steps`` are those to be shown (see :func:`stepaudit.operators.redact.redact_steps`); flags are
    matched by position, as redacted ids may collide. ``titles`` are in the order of emission.
    """
    named = found.select("run_id", "pos", F.struct("phase", "place", "ordinal", "pos", _by_rule({k: F.lit(v) for k, v in TITLES.items()}).alias("title")).alias("t"))
    per_step = named.groupBy("run_id", "pos").agg(F.sort_array(F.collect_list("t")).alias("t"), F.count("*").alias("n_flags"))  # four flags a step at most
    per_step = per_step.select("run_id", "pos", F.array_join(F.col("t.title"), " ").alias("titles"), "n_flags")
    out = (steps if kind is None else steps.where(F.col("kind") == kind)).join(per_step, ["run_id", "pos"], "inner" if flagged else "left")
    words = F.concat_ws(" ", "id", F.coalesce("content", F.lit("")), F.coalesce("tool", F.lit("")), F.coalesce("titles", F.lit("")))
    return out.where(F.contains(F.lower(words), F.lit(text.lower()))).withColumn("n_flags", F.coalesce("n_flags", F.lit(0).cast("long")))


def flagged_messages(found: DataFrame, steps: DataFrame) -> DataFrame:
    """``run_id, msg_index`` that flags lead to: a result's by the last call of its call id, others by their own."""
    calls = steps.where("kind = 'tool_call' AND call_id IS NOT NULL").groupBy("run_id", "call_id").agg(F.max_by("msg_index", "pos").alias("call_msg"))
    at = found.select("run_id", "pos").distinct().join(steps.select("run_id", "pos", "kind", "call_id", "msg_index"), ["run_id", "pos"])
    linked = at.join(calls, ["run_id", "call_id"], "left")
    msg = F.when(F.col("kind") == "tool_result", F.col("call_msg")).when(F.col("kind") != "task", F.col("msg_index"))
    return linked.select("run_id", msg.alias("msg_index")).where("msg_index IS NOT NULL").distinct()
