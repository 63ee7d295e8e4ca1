"""Envelopes: a run with its original message groups, checked, built, and scored action by action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepaudit.operators import features, tfidf, validate

#: Keys, roles with the kind of their first step, and the most groups.
KEYS, GROUP_KEYS = ["envelope_version", "run", "messages"], ["role", "step_ids"]
FIRST_KIND = {"user": "task", "assistant": "assistant", "tool": "tool_result"}
EXCLUDED, MAX_GROUPS = "excluded", 2000
_GROUP = "struct<role:string,step_ids:array<string>>"
_STEPS = f"array<{validate.STEP}>"


def _exact(raw: Column, keys: list[str]) -> Column:
    return F.array_sort(F.json_object_keys(raw)) == F.array(*map(F.lit, sorted(keys)))


def check(rows: DataFrame, raw_col: str = "raw") -> DataFrame:
    """All rows with ``reason``: null for a valid envelope, else the first broken rule.

    Rules in order: size, the three keys, the version, the run's own rules, 1 to 2000 groups, their
    keys and roles, and the mapping: groups name every step once, in order, with the kinds that
    their role asks for; an excluded group names none, a user's or a tool's exactly one; an
    assistant's calls have a tool; there is an assistant.
    """
    raw = F.col(raw_col)
    inner = validate.check(rows.withColumn("__run", F.get_json_object(raw, "$.run")), "__run").withColumnRenamed("reason", "__run_reason")
    parts = F.from_json(F.get_json_object(raw, "$.messages"), "array<string>")
    groups = F.from_json(F.get_json_object(raw, "$.messages"), f"array<{_GROUP}>")
    named = inner.withColumns({"__p": parts, "__g": groups, "__s": F.from_json("__run", f"steps {_STEPS}")["steps"]})
    g, s = F.col("__g"), F.col("__s")

    def fits(x: Column) -> Column:
        n = F.size(x["step_ids"])
        return F.when(x["role"] == EXCLUDED, n == 0).when(x["role"] == "assistant", n >= 1).otherwise(n == 1)

    kinds = F.flatten(F.transform(g, lambda x: F.transform(x["step_ids"], lambda i, k: F.when(k > 0, "tool_call").otherwise(
        F.element_at(F.create_map(*[F.lit(v) for kv in FIRST_KIND.items() for v in kv]), x["role"])))))
    tools = F.forall(s, lambda x: (x["kind"] != "tool_call") | F.coalesce(x["tool"] != "", F.lit(False)))
    ids = F.flatten(F.transform(g, lambda x: x["step_ids"]))
    mapped = (ids == F.transform(s, lambda x: x["id"])) & (kinds == F.transform(s, lambda x: x["kind"])) & tools
    known = F.array(*map(F.lit, [*FIRST_KIND, EXCLUDED]))
    rules = [
        ("too-large", F.octet_length(raw) <= validate.MAX_BYTES),
        ("envelope-keys", _exact(raw, KEYS)),
        ("envelope-version", F.get_json_object(raw, "$.envelope_version") == "1"),
    ]
    more = [
        ("group-count", F.size("__p").between(1, MAX_GROUPS)),
        ("group-keys", F.forall("__p", lambda x: F.coalesce(_exact(x, GROUP_KEYS), F.lit(False)))),
        ("group-role", F.forall(g, lambda x: F.array_contains(known, x["role"]) & x["step_ids"].isNotNull())),
        ("group-length", F.forall(g, fits)),
        ("mapping", mapped),
        ("no-assistant", F.exists(g, lambda x: x["role"] == "assistant")),
    ]
    reason = F.lit(None).cast("string")
    for name, ok in reversed(more):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    reason = F.when(F.col("__run_reason").isNotNull(), F.concat(F.lit("run:"), "__run_reason")).otherwise(reason)
    for name, ok in reversed(rules):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    return named.withColumn("reason", reason).drop("__run", "__run_reason", "__p", "__g", "__s")


def groups_of(valid: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``run_id, msg_index, role, pos, steps`` of each group of valid envelopes; ``pos`` is its first step's, from 1."""
    e = valid.select(F.from_json(raw_col, f"run struct<run_id:string,steps:{_STEPS}>, messages array<{_GROUP}>").alias("e")).select(F.col("e.run.run_id").alias("run_id"), F.col("e.run.steps").alias("steps"), F.posexplode("e.messages").alias("msg_index", "g"))
    n = F.size("g.step_ids")
    before = F.coalesce(F.sum(n).over(Window.partitionBy("run_id").orderBy("msg_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    made = e.withColumns({"n": n, "before": before})
    return made.select("run_id", "msg_index", F.col("g.role").alias("role"), F.when(F.col("n") > 0, F.col("before") + 1).alias("pos"), F.slice("steps", F.col("before") + 1, F.col("n")).alias("steps"))


def build(messages: DataFrame) -> DataFrame:
    """``run_id, msg_index, role, step_ids`` of every original message; a system message is an excluded slot."""
    steps = features.adapt(messages).groupBy("run_id", "msg_index").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("s"))  # one message's calls
    kept = messages.join(features.unsupported(messages).select("run_id"), "run_id", "left_anti").select("run_id", "msg_index", "role")
    role = F.when(F.col("role") == "system", EXCLUDED).otherwise(F.col("role"))
    return kept.join(steps, ["run_id", "msg_index"], "left").select("run_id", "msg_index", role.alias("role"), F.coalesce(F.col("s.id"), F.array().cast("array<string>")).alias("step_ids"))


def groups_from(messages: DataFrame) -> DataFrame:
    """The groups of :func:`groups_of`, straight from messages: every original message with its steps."""
    step = F.struct("id", "kind", "content", "tool", "call_id", "status")
    steps = features.adapt(messages).groupBy("run_id", "msg_index").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", step.alias("s")))).alias("s"))  # one message's calls
    kept = messages.join(features.unsupported(messages).select("run_id"), "run_id", "left_anti").select("run_id", "msg_index", "role")
    role = F.when(F.col("role") == "system", EXCLUDED).otherwise(F.col("role"))
    return kept.join(steps, ["run_id", "msg_index"], "left").select("run_id", "msg_index", role.alias("role"), "pos", F.coalesce(F.col("s.s"), F.array().cast(_STEPS)).alias("steps"))


def incompatible(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, reason`` of runs that no envelope can hold: group-count, step-count, step-text, step-option or too-large.

    The envelope's bytes are summed step by step, so no run is ever one value. ``runs`` has ``run_id, task``.
    """
    groups, calls = groups_from(messages), F.slice("steps", F.lit(2), F.size("steps"))
    said = F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(F.to_json(x)) + 1)
    own = F.octet_length(F.to_json(F.struct("role", F.transform("steps", lambda x: x["id"]).alias("step_ids")))) + 1
    long = F.exists("steps", lambda x: validate.utf16_length(x["content"]) > validate.LIMITS["content"])
    odd = F.exists("steps", lambda x: (validate.utf16_length(F.coalesce(x["tool"], F.lit(""))) > validate.LIMITS["tool"]) | (validate.utf16_length(F.coalesce(x["call_id"], F.lit(""))) > validate.LIMITS["call_id"]))
    bare = F.exists(calls, lambda x: F.coalesce(x["tool"], F.lit("")) == "")
    per = groups.groupBy("run_id").agg(F.count("*").alias("groups"), F.sum(F.size("steps")).alias("n"), F.sum(said + own).alias("bytes"), F.bool_or(long).alias("long"), F.bool_or(odd | bare).alias("odd"))
    head = F.octet_length(F.to_json(F.struct(F.lit(1).alias("envelope_version"), F.struct(F.lit(1).alias("schema_version"), "run_id", "task", F.lit("completed").alias("status"), F.array().alias("steps")).alias("run"), F.array().alias("messages"))))
    sized = per.join(runs.select("run_id", "task"), "run_id")
    reason = (
        F.when(F.col("groups") > MAX_GROUPS, "group-count").when(~F.col("n").between(1, validate.MAX_STEPS), "step-count").when(F.col("long"), "step-text")
        .when(F.col("odd"), "step-option").when(F.col("bytes") - 2 + head > validate.MAX_BYTES, "too-large")
    )
    return sized.select("run_id", reason.alias("reason")).where("reason IS NOT NULL")


def _text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), features.ANSWER, features.OMITTED)


def actions(groups: DataFrame) -> DataFrame:
    """Every scorable action: ``run_id, msg_index, pos, feature, field_removed, joined_removed, context``.

    An action is an assistant group before the run's last one. ``field_removed`` and
    ``joined_removed`` count the characters that the limits of a part and of a feature cut off;
    ``context`` is the step with the tool calls that follow it in its group.
    """
    run = Window.partitionBy("run_id")
    main, calls = F.get("steps", F.lit(0)), F.slice("steps", F.lit(2), F.size("steps"))
    n = features.PART_CHARS
    own = F.concat("role", F.lit(" "), F.substring(_text(main["content"]), 1, n))
    parts = F.concat(F.array(own), F.transform(calls, lambda c: F.concat(c["tool"], F.lit(" "), F.substring(F.coalesce(c["content"], F.lit("")), 1, n))))
    cut = F.greatest(F.length(_text(main["content"])) - n, F.lit(0)) + F.aggregate(calls, F.lit(0), lambda a, c: a + F.greatest(F.length(c["content"]) - n, F.lit(0)))
    live = F.col("role") != EXCLUDED
    frame = run.orderBy("msg_index").rowsBetween(1 - features.SLOTS, 0)
    slot = groups.withColumns({"part": F.when(live, F.array_join(parts, "\n")), "cut": F.when(live, cut).otherwise(0)})
    joined = F.array_join(F.collect_list("part").over(frame), "\n")
    made = slot.withColumns({"joined": joined, "field_removed": F.sum("cut").over(frame), "last": F.max(F.when(F.col("role") == "assistant", F.col("msg_index"))).over(run)})
    shown = F.array_join(F.transform("steps", lambda s: F.concat_ws(" ", F.nullif(s["tool"], F.lit("")), F.coalesce(F.nullif(s["content"], F.lit("")), F.lit("(empty assistant text)")))), "\n")
    made = made.where((F.col("role") == "assistant") & (F.col("msg_index") < F.col("last")))
    return made.select(
        "run_id", "msg_index", "pos", F.right("joined", F.lit(features.FEATURE_CHARS)).alias("feature"), "field_removed",
        F.greatest(F.length("joined") - features.FEATURE_CHARS, F.lit(0)).cast("long").alias("joined_removed"), shown.alias("context"),
    )


def scored_actions(groups: DataFrame, model: DataFrame, intercept: list[float], threshold: float) -> DataFrame:
    """:func:`actions` with ``score, p0, p1, p2, reason, suggestion`` of the model; unsupported ones have no score."""
    made = actions(groups).withColumn("__k", F.struct("run_id", "msg_index", "pos", "field_removed", "joined_removed", "context"))
    got = tfidf.score(made, model, intercept, threshold, "__k", "feature")
    over = F.coalesce((F.col("score") > threshold) & (F.abs(F.col("score") - threshold) > 1e-6), F.lit(False))
    return got.select("doc_id.*", "score", "p0", "p1", "p2", "reason", over.alias("suggestion"))


def review_coverage(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """``run_id, eligible, scored, unsupported, truncated, final_excluded, unicode, unknown`` of each run."""
    by = scored.groupBy("run_id").agg(
        F.count("*").alias("eligible"), F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("unsupported"),
        F.count_if((F.col("field_removed") > 0) | (F.col("joined_removed") > 0)).alias("truncated"),
        F.count_if(F.col("reason") == "unsupported-unicode").alias("unicode"), F.count_if(F.col("reason") == "no-known-features").alias("unknown"),
    )
    runs = groups.groupBy("run_id").agg(F.max((F.col("role") == "assistant").cast("long")).alias("final_excluded"))
    return runs.join(by, "run_id", "left").na.fill(0)
