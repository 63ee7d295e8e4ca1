"""Queries over trajectories with typed message values, made from conversations: steps, runs, labels, and metrics of their targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepaudit.operators import features, policy, tfidf, trajectory
from stepaudit.plans import queries as plans
from stepaudit.plans.views import table
from stepaudit.session import ship

#: Extra labels of a conversation by its number modulo 11: index, role, values of wrong types, and a key that repeats an index.
LABEL_FAULTS = {1: '"99":1', 2: '"0":1', 3: '"1":2', 4: '"1":true', 5: '" 1":1', 6: '"1":"1"', 7: '"x":1', 8: '"1":1.0'}


def _json(text: Column) -> Column:
    """A JSON string in which every "e" is escaped."""
    quoted = F.to_json(F.struct(text.alias("t")))
    return F.regexp_replace(F.substring(quoted, F.lit(6), F.length(quoted) - 6), "e", r"\\u0065")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """``subset, grp, split, query_index, sample_index, line`` of every conversation; the kind of a content goes by its turn."""
    c = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    role = F.when((F.col("role") == "user") & (F.col("turn") % 3 == 2), "tool").otherwise(F.col("role"))
    k, t = F.col("turn") % 5, _json(F.col("text"))
    content = F.when(k == 0, t).when(k == 1, F.concat(F.lit('{"b":'), t, F.lit(',"a":[true,null,1.5]}'))).when(k == 2, "null").when(k == 3, F.concat(F.lit("["), t, F.lit("]"))).otherwise(F.lit("12.0"))
    calls = F.concat(
        F.lit(',"tool_calls":[{"id":"","function":{"name":"get","arguments":{"z":'), t, F.lit(',"y":{}}}},{"function":{"name":"put","arguments":null}},'),
        F.lit(r'{"id":"k1","function":{"name":"ls","arguments":"{\"raw\": 1}"}},{"function":{"name":"noargs"}}]'),
    )
    names = F.when(role != "tool", F.lit("")).when(k == 2, F.lit(',"name":"","tool_call_id":""')).otherwise(F.lit(',"name":"get","tool_call_id":"k1"'))
    message = F.concat(F.lit('{"content":'), content, F.lit(',"role":"'), role, F.lit('"'), names, F.when(k == 3, calls).otherwise(F.lit("")), F.lit("}"))
    label = F.when(F.col("role") == "assistant", F.concat(F.lit('"'), "turn", F.lit('":'), (F.col("turn") + F.col("conv_id")) % 3 - 1))
    per = c.select("conv_id", F.struct("turn", message.alias("m"), label.alias("l")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    fault = F.element_at(F.create_map(*[F.lit(v) for p in LABEL_FAULTS.items() for v in p]), (F.col("conv_id") % 11).cast("int"))
    # A fault on an existing key takes the place of that label; JSON objects here never repeat a key.
    own = F.filter("x.l", lambda s: s.isNotNull() & ~F.coalesce(F.substring_index(s, ":", 1) == F.substring_index(fault, ":", 1), F.lit(False)))
    labels = F.array_join(F.concat(own, F.array_compact(F.array(fault))), ",")
    q = F.col("conv_id") % 3
    question = F.when(q == 0, F.lit('""')).when(q == 1, F.lit('{"q":1,"p":"\\u00e9"}')).otherwise(F.concat(F.lit('"Which '), "conv_id", F.lit('?"')))
    line = F.concat(F.lit('{"query_index":'), "conv_id", F.lit(',"sample_index":0,"ground_truth":"poison","question":'), question, F.lit(',"step_labels":{'), labels, F.lit('},"messages":['), F.array_join("x.m", ","), F.lit("]}"))
    subset = F.concat(F.lit("s"), F.col("conv_id") % 4)
    split = F.when(F.col("conv_id") % 5 < 3, "train").when(F.col("conv_id") % 5 == 3, "validation").otherwise("test")
    return per.select(subset.alias("subset"), F.concat(subset, F.lit(":"), "conv_id").alias("grp"), split.alias("split"), F.col("conv_id").alias("query_index"), F.lit(0).cast("long").alias("sample_index"), line.alias("line"))


def typed_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of messages whose contents and arguments are strings, objects, arrays, numbers or null."""
    return features.adapt(trajectory.messages_of(lines(ship(spark), folder))).select("run_id", "pos", "id", "kind", "content", "tool", "call_id")


def typed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run ids and tasks."""
    return trajectory.runs_of(lines(ship(spark), folder))


def label_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Every label with what is wrong with it, and whether it is a target."""
    rows = lines(ship(spark), folder)
    return trajectory.targets(trajectory.labels_of(rows), trajectory.messages_of(rows))


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return trajectory.samples(lines(ship(spark), folder).where("split != 'test'"))


def target_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Targets with their rules and features; no test row comes near."""
    return _samples(spark, folder).select("run_id", "msg_index", "subset", "split", "label", "rule", F.md5("text").alias("text"), "support_reason")


def target_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """A3 and A4 on targets: the rules that hit them, by split and subset."""
    counts = _samples(spark, folder).groupBy("split", "subset").agg(*policy.confusion(F.col("rule"), F.col("label")))
    return policy.with_rates(counts).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def target_gate(spark: SparkSession, folder: str) -> DataFrame:
    """M5, M7 and T6 on targets: the gate over scores of their features, rules from their own runs."""
    found = _samples(spark, folder).where("split = 'validation'").withColumn("key", F.struct("run_id", "msg_index"))
    made = [(t, 1 + k / 10, *[((k + 1) * (j + 2) % 7 - 3) / 4 for j in range(3)]) for k, t in enumerate(TERMS)]
    scores = tfidf.score(found, spark.createDataFrame(made, tfidf.MODEL), [0.1, -0.2, 0.3], 0.5, "key", "text").select(F.col("doc_id.*"), "score")
    return policy.gate(found.drop("key").join(scores, ["run_id", "msg_index"])).withColumn("model_recall", F.round("model_recall", 9))


#: Terms of the model that scores targets: words of the messages' own frame.
TERMS = ["assistant", "user", "tool", "true", "null", "12", "user 12", "raw", "noargs", "put null", "get"]


def target_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """A10: coverage of targets with their unsupported reasons, zeros for labels that no target has."""
    return policy.full_coverage(_samples(spark, folder)).withColumn("reasons", F.to_json("reasons"))


_M = """c AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 = 2 THEN 'tool' ELSE role END AS role, turn % 5 AS k, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS q, coalesce(text, '') AS t, role AS old FROM conversations),
m AS (SELECT 's' || conv_id % 4 || '-' || conv_id || '-0' AS run_id, conv_id, turn AS i, role, old, k, q,
  CASE k WHEN 0 THEN t WHEN 1 THEN '{"b": ' || q || ', "a": [true, null, 1.5]}' WHEN 2 THEN '' WHEN 3 THEN '[' || q || ']' ELSE '12.0' END AS content FROM c),
b AS (SELECT run_id, i, unnest(range(4)) AS j, unnest(['get', 'put', 'ls', 'noargs']) AS tool, unnest(['{"z": ' || q || ', "y": {}}', 'null', '{"raw": 1}', '']) AS content, role FROM m WHERE k = 3)"""
_STEPS = """u AS (SELECT run_id, i, -1 AS j, 'm' || i AS id, CASE role WHEN 'user' THEN 'task' WHEN 'tool' THEN 'tool_result' ELSE 'assistant' END AS kind, content,
  CASE WHEN role = 'tool' AND k <> 2 THEN 'get' END AS tool, CASE WHEN role = 'tool' AND k <> 2 THEN 'k1' END AS call_id FROM m WHERE role <> 'system'
  UNION ALL SELECT run_id, i, j, 'm' || i || '-call' || j, 'tool_call', content, tool, CASE WHEN j = 2 THEN 'k1' ELSE 'm' || i || '-call' || j END FROM b WHERE role = 'assistant')"""
_NUMBERED = "CAST(row_number() OVER (PARTITION BY run_id ORDER BY i, j) AS INT) AS pos"
_LABELS = f"""f(k, key, label, raw) AS (VALUES {", ".join(f"({k}, '{v[1 : v.index(':') - 1]}', {dict(zip((1, 2, 5, 7), (1,) * 4)).get(k, 'NULL')}::INT, 0)" for k, v in LABEL_FAULTS.items())}),
e AS (SELECT run_id, conv_id, CAST(i AS VARCHAR) AS key, CAST((i + conv_id) % 3 - 1 AS INT) AS label FROM m WHERE old = 'assistant' AND NOT EXISTS (SELECT 1 FROM f WHERE f.k = conv_id % 11 AND f.key = CAST(i AS VARCHAR))
  UNION ALL SELECT DISTINCT run_id, conv_id, f.key, f.label FROM m JOIN f ON f.k = conv_id % 11),
lx AS (SELECT *, CASE WHEN key <> 'x' THEN CAST(trim(key) AS INT) END AS msg_index FROM e), ln AS (SELECT *, count(msg_index) OVER (PARTITION BY run_id, msg_index) AS n FROM lx),
ly AS (SELECT ln.*, m.role, (SELECT max(i) FROM m m2 WHERE m2.role = 'assistant' AND m2.run_id = ln.run_id) AS last FROM ln LEFT JOIN m ON m.run_id = ln.run_id AND m.i = ln.msg_index),
l AS (SELECT run_id, conv_id, key, msg_index, label, CASE WHEN role IS NULL THEN 'label-index' WHEN role <> 'assistant' THEN 'label-role' WHEN label IS NULL THEN 'label-value' WHEN n > 1 THEN 'label-repeated' END AS reason, last FROM ly),
g0 AS (SELECT *, coalesce(reason IS NULL AND msg_index < last, false) AS target FROM l)"""
_SAMPLES = f"""{_M}, {_LABELS}, {_STEPS}, h AS (SELECT run_id, max(i) AS last FROM m WHERE role = 'assistant' GROUP BY run_id),
s AS (SELECT u.run_id, {_NUMBERED.replace("run_id", "u.run_id")}, id, kind, content, tool, call_id, NULL AS status, i FROM u JOIN h ON h.run_id = u.run_id AND u.i < h.last), {plans.FLAG_RULES.replace("f AS (", "fl AS (")},
lc AS (SELECT run_id, call_id, max_by(i, pos) AS i FROM s WHERE kind = 'tool_call' AND call_id IS NOT NULL GROUP BY ALL),
hit AS (SELECT DISTINCT fl.run_id, CASE WHEN s.kind = 'tool_result' THEN lc.i WHEN s.kind <> 'task' THEN s.i END AS i FROM fl JOIN s ON s.run_id = fl.run_id AND s.pos = fl.pos LEFT JOIN lc ON lc.run_id = s.run_id AND lc.call_id = s.call_id),
a AS (SELECT m.run_id, m.i, CASE WHEN role <> 'system' THEN role || ' ' || left(content, 4000) || coalesce(chr(10) || (SELECT string_agg(tool || ' ' || left(b.content, 4000), chr(10) ORDER BY j) FROM b WHERE b.run_id = m.run_id AND b.i = m.i), '') END AS part FROM m),
w AS (SELECT run_id, i, right(array_to_string(list_filter(array_agg(part) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), lambda p: p IS NOT NULL), chr(10)), 12000) AS text FROM a),
p0 AS (SELECT g0.run_id, msg_index, conv_id, 's' || conv_id % 4 AS subset, CASE WHEN conv_id % 5 < 3 THEN 'train' ELSE 'validation' END AS split, label, hit.i IS NOT NULL AS rule, text,
  CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'unsupported-unicode' END AS support_reason
  FROM g0 JOIN w ON w.run_id = g0.run_id AND w.i = msg_index LEFT JOIN hit ON hit.run_id = g0.run_id AND hit.i = msg_index WHERE target AND conv_id % 5 <> 4)"""
_MODEL = ", ".join(f"('{t}', {1 + k / 10}::DOUBLE, {', '.join(f'{((k + 1) * (j + 2) % 7 - 3) / 4}::DOUBLE' for j in range(3))})" for k, t in enumerate(TERMS))
_SCORED = f"""{_SAMPLES}, tw AS (SELECT run_id, msg_index, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS ws FROM p0 WHERE support_reason IS NULL),
tm AS (SELECT run_id, msg_index, unnest(ws || list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM tw), tf AS (SELECT run_id, msg_index, term, count(*) AS tf FROM tm GROUP BY ALL),
mo(term, idf, w0, w1, w2) AS (VALUES {_MODEL}), v AS (SELECT run_id, msg_index, (1 + ln(tf)) * idf AS v, w0, w1, w2 FROM tf JOIN mo USING (term)),
zz AS (SELECT run_id, msg_index, sum(v * w0) / sqrt(sum(v * v)) + 0.1 AS z0, sum(v * w1) / sqrt(sum(v * v)) - 0.2 AS z1, sum(v * w2) / sqrt(sum(v * v)) + 0.3 AS z2 FROM v GROUP BY ALL),
m AS (SELECT p0.*, exp(z0) / (exp(z0) + exp(z1) + exp(z2)) AS score FROM p0 LEFT JOIN zz ON zz.run_id = p0.run_id AND zz.msg_index = p0.msg_index)"""


def _gate() -> str:
    """The gate's SQL over scored targets; its own tables get names that are free."""
    sql = plans._GATE.replace("FROM m, t WHERE", "FROM scored, t WHERE")
    for k in "pbae":
        sql = sql.replace(f"\n{k} AS (", f"\ngate_{k} AS (")
        for end in (" GROUP", " WHERE eligible", ")"):
            sql = sql.replace(f"FROM {k}{end}", f"FROM gate_{k}{end}")
    sql = sql.removesuffix("FROM e") + "FROM gate_e"
    return sql.replace(f"WITH {plans.SAMPLES}, t AS", "WITH " + _SCORED.replace("\nm AS (SELECT p0", "\nscored AS (SELECT p0") + ", t AS")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (typed_steps, typed_runs, label_targets, target_samples, target_confusion, target_gate, target_coverage)}


def oracle_sql() -> dict[str, str]:
    measures = """count(*) AS steps, count(DISTINCT conv_id) AS groups, count(*) FILTER (support_reason IS NULL) AS supported, count(DISTINCT conv_id) FILTER (support_reason IS NULL) AS supported_groups,
  count(*) FILTER (support_reason IS NOT NULL) AS unsupported, count(DISTINCT conv_id) FILTER (support_reason IS NOT NULL) AS unsupported_groups"""
    names = ("steps", "groups", "supported", "supported_groups", "unsupported", "unsupported_groups")
    return {
        "typed_steps": f"WITH {_M}, {_STEPS} SELECT run_id, {_NUMBERED}, id, kind, content, tool, call_id FROM u",
        "typed_runs": """SELECT DISTINCT 's' || conv_id % 4 || '-' || conv_id || '-0' AS run_id, CASE conv_id % 3 WHEN 0 THEN 'Conversation task' WHEN 1 THEN '{"q": 1, "p": "é"}' ELSE 'Which ' || conv_id || '?' END AS task FROM conversations""",
        "label_targets": f"WITH {_M}, {_LABELS} SELECT run_id, key, msg_index, label, reason, target FROM g0",
        "target_samples": f"WITH {_SAMPLES} SELECT run_id, CAST(msg_index AS INT) AS msg_index, subset, split, label, rule, md5(text) AS text, support_reason FROM p0",
        "target_confusion": f"""WITH {_SAMPLES}, k AS (SELECT split, subset, count(*) FILTER (rule AND label = -1) AS tp, count(*) FILTER (rule AND label <> -1) AS fp,
          count(*) FILTER (NOT rule AND label = -1) AS fn, count(*) FILTER (NOT rule AND label <> -1) AS tn FROM p0 GROUP BY ALL)
          SELECT *, {plans._share("tp", "tp + fp")} AS precision, {plans._share("tp", "tp + fn")} AS recall, {plans._share("2 * tp", "2 * tp + fp + fn")} AS f1 FROM k""",
        "target_gate": _gate(),
        "target_coverage": f"""WITH {_SAMPLES}, n AS (SELECT split, label, subset, {measures}, count(*) FILTER (support_reason = 'unsupported-unicode') AS bad FROM p0
          GROUP BY GROUPING SETS ((split), (split, label), (split, subset), (split, label, subset))),
          cells AS (SELECT DISTINCT split, subset, label FROM (SELECT split, subset, unnest([NULL, -1, 0, 1]) AS label FROM n WHERE label IS NULL))
          SELECT cells.split, cells.label, cells.subset, {', '.join(f"coalesce({c}, 0) AS {c}" for c in names)}, CASE WHEN coalesce(bad, 0) = 0 THEN '{{}}' ELSE '{{"unsupported-unicode":' || bad || '}}' END AS reasons
          FROM cells LEFT JOIN n ON n.split = cells.split AND n.subset IS NOT DISTINCT FROM cells.subset AND n.label IS NOT DISTINCT FROM cells.label""",
    }
