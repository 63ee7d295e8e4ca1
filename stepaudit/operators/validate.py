"""Closed-schema checks of raw runs; a bad run goes to quarantine with the first rule that it breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed keys, kinds, statuses and limits (UTF-16 units for texts).
RUN_KEYS = ["schema_version", "run_id", "task", "status", "steps"]
STEP_KEYS = ["id", "kind", "content", "tool", "call_id", "status"]
KINDS = ["task", "assistant", "tool_call", "tool_result"]
STATUSES = ["ok", "error"]
MAX_BYTES, MAX_STEPS = 2 * 1024 * 1024, 2000
LIMITS = {"run_id": 200, "task": 20_000, "id": 200, "content": 100_000, "tool": 200, "call_id": 200}
STEP = "struct<id:string,kind:string,content:string,tool:string,call_id:string,status:string>"
_BLANK = r"^[\s\x{feff}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$"


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _text(raw: Column, key: str, blank: bool = False) -> Column:
    """Whether ``key`` of the JSON object ``raw`` is a string within its limit."""
    value = F.get_json_object(raw, f"$.{key}")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{key}", "variant"))
    ok = (kind == "STRING") & (utf16_length(value) <= LIMITS[key])
    return F.coalesce(ok if blank else ok & ~value.rlike(_BLANK), F.lit(False))


def _closed(raw: Column, keys: list[str]) -> Column:
    return F.size(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, keys)))) == 0


def _has(raw: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(raw), key)


def check(runs: DataFrame, raw_col: str = "raw") -> DataFrame:
    """All rows with ``reason``: null for a valid run, else the first broken rule.

    Rules in order: too large, not an object, exported report, unknown key, version, status,
    run_id, task, steps (1 to 2000), then for steps: keys, texts, repeated id, kind, optional texts,
    status. Objects with repeated keys count as not an object.
    """
    raw = F.col(raw_col)
    variant = F.try_parse_json(raw)
    kind = F.schema_of_variant(variant)
    parsed = F.from_json(raw, "steps array<string>")["steps"]
    data = runs.withColumns({"__kind": kind, "__steps": parsed})
    steps, top = F.col("__steps"), F.col("__kind")

    def every(test) -> Column:
        return F.coalesce(F.forall(steps, lambda s: F.coalesce(test(s), F.lit(False))), F.lit(False))

    def optional(s: Column, key: str) -> Column:
        return ~_has(s, key) | _text(s, key)

    def one_of(s: Column, key: str, allowed: list[str]) -> Column:
        return F.get_json_object(s, f"$.{key}").isin(allowed)

    ids = F.transform(steps, lambda s: F.get_json_object(s, "$.id"))
    rules = [
        ("too-large", F.octet_length(raw) <= MAX_BYTES),
        ("not-an-object", top.startswith("OBJECT")),
        ("exported-report", ~_has(raw, "report_version")),
        ("unknown-run-key", _closed(raw, RUN_KEYS)),
        ("schema-version", F.try_variant_get(variant, "$.schema_version", "double") == 1),
        ("status", F.get_json_object(raw, "$.status") == "completed"),
        ("run-id", _text(raw, "run_id")),
        ("task", _text(raw, "task")),
        ("step-count", F.size(steps).between(1, MAX_STEPS)),
        ("unknown-step-key", every(lambda s: _closed(s, STEP_KEYS))),
        ("step-text", every(lambda s: _text(s, "id") & _text(s, "content", True))),
        ("repeated-id", F.size(F.array_distinct(ids)) == F.size(ids)),
        ("kind", every(lambda s: one_of(s, "kind", KINDS))),
        ("step-option", every(lambda s: optional(s, "tool") & optional(s, "call_id"))),
        ("step-status", every(lambda s: ~_has(s, "status") | one_of(s, "status", STATUSES))),
    ]
    reason = reduce(lambda rest, rule: F.when(~F.coalesce(rule[1], F.lit(False)), rule[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    return data.withColumn("reason", reason).drop("__kind", "__steps")


def steps_of(valid: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``run_id, pos`` and the fields of every step of valid runs; ``pos`` counts from 1."""
    run = F.from_json(raw_col, f"run_id string, steps array<{STEP}>")
    return valid.select(run.alias("r")).select("r.run_id", F.posexplode("r.steps").alias("p", "s")).select("run_id", (F.col("p") + 1).alias("pos"), "s.*")
