"""Queries over the tables with planted cases that their own rows never hold: error texts, secrets, broken envelopes, changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepaudit.operators import envelope, features, redact, rules
from stepaudit.plans import queries as plans
from stepaudit.plans import views
from stepaudit.plans.cases import MASKS, values
from stepaudit.plans.views import STEPS, table
from stepaudit.sources import files

#: Beginnings of a step's content by its event modulo 7; the others have none.
ERRORS = {0: "an Error: late ", 1: "errors and failures ", 2: "it is Permission denied, as I said, and then a long tail of words ", 3: "the page was not founded ", 4: "no exceptional traceback "}
_CONTENT = "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ERRORS.items()) + " ELSE '' END || props"
#: Masks that end within their own text.
PLANTED = [m for m in MASKS if m[0] and not m[0].startswith("secret='")]


def planted_flags(spark: SparkSession, folder: str) -> DataFrame:
    """R1 to R6, F1 and F2 on runs whose results tell errors in words, with titles, sentences and order."""
    steps = views.steps(spark, folder)
    n = F.substr("id", F.lit(2)).cast("long") % 7
    head = F.coalesce(*[F.when(n == k, v) for k, v in ERRORS.items()], F.lit(""))
    steps = steps.withColumns({"content": F.concat(head, "content"), "status": F.when(F.col("pos") % 2 == 0, F.col("status"))})
    made = rules.records(rules.flags(steps, redact.masked(F.col("content"))))
    return made.select("run_id", "pos", "rule", "phase", "place", "ordinal", "flag_id", "severity", "title", "sentence", "uncertainty")


_PLANTED_FLAGS = f"""WITH {STEPS.replace("props AS content", f"{_CONTENT} AS content").replace("s AS (", "s0 AS (", 1)}, s AS (SELECT * REPLACE (CASE WHEN pos % 2 = 0 THEN status END AS status) FROM s0), {plans.FLAG_RULES}
SELECT run_id, pos, f.rule, phase, place, ordinal + 1 AS ordinal, f.rule || ':' || step_id AS flag_id, 'review' AS severity, title, uncertainty,
  CASE f.rule WHEN 'repeated_call' THEN 'The same tool and input appear at steps ' || evidence || '.' WHEN 'unmatched_result' THEN 'Result references call_id ' || evidence || ', with no unmatched preceding call.'
    WHEN 'missing_result' THEN 'No later tool result matches call_id ' || evidence || '.' WHEN 'tool_error' THEN CASE WHEN evidence = 'status error' THEN 'The result has status "error".' ELSE 'Matched error-like text: ' || evidence END END AS sentence
FROM f JOIN {plans.TITLES} USING (rule) JOIN {values("rule, uncertainty", list(rules.CAVEATS.items())).replace(") t(", ") c(")} USING (rule)"""


def planted_masks(spark: SparkSession, folder: str) -> DataFrame:
    """A secret before and after every document."""
    secret = F.element_at(F.array(*[F.lit(m[0]) for m in PLANTED]), (F.pmod("doc_id", F.lit(len(PLANTED))) + 1).cast("int"))
    text = F.concat(secret, F.lit(" | "), F.coalesce("text", F.lit("")), F.lit(" | "), secret)
    d = table(spark, folder, "documents").select("doc_id", text.alias("t"))
    return d.select("doc_id", F.md5(redact.masked(F.col("t"))).alias("masked"), redact.mask_count(F.col("t")).cast("long").alias("n"))


_PLANTED_MASKS = f"""WITH r AS ({plans._REDACTED}), p AS (SELECT * FROM {values("k, own, n", [(k, m[1], m[2]) for k, m in enumerate(PLANTED)])})
SELECT doc_id, md5(own || ' | ' || coalesce(text, '') || ' | ' || own) AS masked, n_masked + 2 * n AS n FROM r JOIN p ON p.k = doc_id % {len(PLANTED)}"""

#: What is wrong with the envelope of a conversation, by its number modulo 13: the reason, and the change to its JSON.
FAULTS = {
    1: ("envelope-keys", r"^\{", '{"x":1,'), 2: ("envelope-version", '"envelope_version":1', '"envelope_version":2'), 3: ("run:status", '"completed"', '"x"'), 4: ("group-count", r'(?s)"messages":\[.*$', '"messages":[]}'),
    5: ("group-keys", '"role":"user",', '"extra":1,"role":"user",'), 6: ("group-role", '"role":"user"', '"role":"system"'), 7: ("group-length", r'"role":"user","step_ids":\["m(\d+)"\]', '"role":"user","step_ids":["m$1","m$1"]'),
    8: ("mapping", '"role":"user"', '"role":"tool"'), 9: ("run:kind", '"kind":"task"', '"kind":"note"'), 10: ("mapping", r'"id":"m0"', '"id":"m00"'),
}


def raw_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, raw``: the envelope of every conversation as JSON text, some broken by :data:`FAULTS`."""
    messages = views.messages(spark, folder)
    fields = ["id", "kind", "content"]
    steps = features.adapt(messages).groupBy("run_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", *fields))), lambda s: F.struct(*[s[c].alias(c) for c in fields]))).alias("steps"))
    groups = envelope.build(messages).groupBy("run_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("msg_index", "role", "step_ids"))), lambda g: F.struct(g["role"].alias("role"), g["step_ids"].alias("step_ids")))).alias("groups"))
    raw = F.concat(
        F.lit('{"envelope_version":1,"run":{"schema_version":1,"run_id":"r'), "run_id", F.lit('","task":"t","status":"completed","steps":'), F.coalesce("steps", F.lit("[]")), F.lit('},"messages":'), "groups", F.lit("}")
    )
    made = groups.join(steps, "run_id", "left").select(F.col("run_id").alias("conv_id"), raw.alias("raw"))
    out: Column = F.col("raw")
    for k, (_, old, new) in FAULTS.items():
        out = F.when(F.col("conv_id") % 13 == k, F.regexp_replace("raw", old, new)).otherwise(out)
    return made.select("conv_id", out.alias("raw"))


def checked_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The first broken rule of every conversation's envelope."""
    return envelope.check(raw_envelopes(spark, folder)).select("conv_id", "reason")


_ENVELOPES = f"""WITH c AS (SELECT conv_id, conv_id % 13 AS k, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, bool_or(turn = 0 AND role <> 'system') AS first FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE {" ".join(f"WHEN k = {k} {'AND first ' if k == 10 else 'AND users > 0 ' if k >= 5 else ''}THEN '{why}'" for k, (why, *_) in FAULTS.items())} WHEN assistants = 0 THEN 'no-assistant' END AS reason FROM c"""


def text_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """What differs between texts and a manifest of their digests: lost, new and changed ones."""
    d = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("t"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("t", F.lit("x"))).otherwise(F.col("t"))
    return files.inventory(d.where("doc_id % 3 != 0").select("file", F.sha2("t", 256).alias("sha256")), d.where("doc_id % 5 != 0").select("file", F.sha2(changed, 256).alias("sha256")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (planted_flags, planted_masks, checked_envelopes, text_inventory)}


def oracle_sql() -> dict[str, str]:
    return {
        "planted_flags": _PLANTED_FLAGS,
        "planted_masks": _PLANTED_MASKS,
        "checked_envelopes": _ENVELOPES,
        "text_inventory": """SELECT 'd' || doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'unexpected' ELSE 'digest' END AS problem FROM documents
          WHERE (doc_id % 3 = 0) <> (doc_id % 5 = 0) OR (doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 = 0)""",
    }
