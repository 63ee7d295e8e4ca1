"""Queries over JSON logs that are made from the tables: written once, verified and read back, or published with a quarantine."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepaudit import governance
from stepaudit.operators import report, split, validate
from stepaudit.plans import views
from stepaudit.plans.views import STEPS, table
from stepaudit.scratch import folder as shared
from stepaudit.session import ship
from stepaudit.sources import files, verified

#: Groups of the made manifest, and questions that they share.
GROUPS, QUESTIONS = 200, 149


def _made(spark: SparkSession, folder: str, name: str) -> str:
    """A place in the shared folder for what is made of one folder's tables in this application."""
    return f"{shared(spark)}/{name}-{hashlib.md5(folder.encode()).hexdigest()}-{spark.sparkContext.applicationId}"


def _group(n: Column) -> Column:
    return F.concat(F.lit("s"), n % 4, F.lit(":"), n)


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """``folder, file, line``: a JSON line a conversation, with attempts that leave the range, repeat or lack."""
    n = F.col("conv_id") % GROUPS
    turn = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))
    per = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    # The nested key of the same name must not be taken for the routing key.
    note = F.struct((F.col("conv_id") + 1).alias("query_index"))
    row = F.struct(messages.alias("messages"), note.alias("note"), n.alias("query_index"), (F.floor(F.col("conv_id") / GROUPS) % 7).alias("sample_index"), F.concat(F.lit(" Which  ONE "), n % QUESTIONS).alias("question"))
    return per.select(F.lit("rows").alias("folder"), F.concat(F.lit("s"), n % 4, F.lit(".jsonl")).alias("file"), F.to_json(row).alias("line"))


def _manifest(spark: SparkSession, folder: str) -> tuple[str, DataFrame, DataFrame]:
    """The folder of the written lines, its frozen groups and its files' digests."""
    path = _made(spark, folder, "trajectories")
    verified.write_committed(trajectories(spark, folder).repartition(4, "file"), path, "first")
    listed = verified.committed_files(spark, path)
    groups = spark.range(GROUPS + 1).select(_group(F.col("id")).alias("grp"), F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "validation").otherwise("test").alias("split"))
    return f"{path}/first/rows", groups, listed.select(F.regexp_extract("name", "([^/]+)$", 1).alias("file"), "sha256")


def verified_trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of verified byte ranges; TEST rows are dropped in the reader."""
    path, groups, digests = _manifest(ship(spark), folder)
    got = files.read_verified(spark, path, groups, digests, range_bytes=1 << 20)
    said = F.transform("messages", lambda m: F.concat_ws(":", m["role"], F.coalesce(m["content"], F.lit(""))))
    return got.select("subset", "grp", "split", "query_index", "sample_index", F.size("messages").alias("n_messages"), F.md5(F.array_join(said, "\n")).alias("messages"))


def routing_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What an audit of the routing columns of all rows finds wrong, TEST rows too."""
    path, groups, digests = _manifest(ship(spark), folder)
    rows = files.read_routed(spark, path, groups, digests, range_bytes=1 << 20)
    question = F.sha2(split.normalized(F.col("question")), 256)
    rows = rows.select("grp", "query_index", "sample_index", F.min("grp").over(Window.partitionBy(question)).alias("component"))
    return governance.split_problems(rows, groups)


_TRAJECTORIES = f"""r AS (SELECT conv_id, conv_id % {GROUPS} AS n, conv_id // {GROUPS} % 7 AS sample_index, count(*) AS n_messages,
  md5(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn)) AS messages FROM conversations GROUP BY conv_id),
t AS (SELECT *, 's' || n % 4 AS subset, 's' || n % 4 || ':' || n AS grp, CASE WHEN n % 5 < 3 THEN 'train' WHEN n % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM r)"""

_AUDIT = f"""WITH {_TRAJECTORIES}, g AS (SELECT 's' || i % 4 || ':' || i AS grp, CASE WHEN i % 5 < 3 THEN 'train' WHEN i % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM range({GROUPS + 1}) x(i)),
c AS (SELECT min(grp) AS grp, count(DISTINCT split) AS k FROM t GROUP BY n % {QUESTIONS}), p AS (SELECT grp, count(*) AS n, count(DISTINCT sample_index) AS d FROM t GROUP BY grp)
SELECT grp, 'unseen-group' AS problem FROM g WHERE grp NOT IN (SELECT grp FROM t) UNION SELECT grp, 'attempt-range' FROM t WHERE sample_index > 4
UNION SELECT grp, 'repeated-attempt' FROM p WHERE n > d UNION SELECT grp, 'incomplete-attempts' FROM p WHERE d < 5 UNION SELECT grp, 'component-crosses-splits' FROM c WHERE k > 1"""

#: What is wrong with the run of a user, by its number modulo 17: the reason, and the change to its JSON (run or steps).
FAULTS = {
    1: ("unknown-run-key", "run", r'^\{', '{"extra":0,'), 2: ("schema-version", "run", '"schema_version":1', '"schema_version":2'), 3: ("status", "run", '"completed"', '"running"'),
    4: ("run-id", "run", r'"run_id":"r\d+"', '"run_id":5'), 5: ("task", "run", '"task":"review"', '"task":"  "'), 6: ("step-count", "steps", r"(?s)^\[.*\]$", "[]"),
    7: ("unknown-step-key", "steps", '"kind":', '"x":0,"kind":'), 8: ("repeated-id", "steps", r'"id":"e\d+"', '"id":"e"'), 9: ("kind", "steps", '"kind":"[a-z_]+"', '"kind":"note"'),
    10: ("step-option", "steps", '"tool":"[a-z]+"', '"tool":" "'), 11: ("step-status", "steps", '"status":"[a-z]+"', '"status":"odd"'), 12: ("exported-report", "run", r'^\{', '{"report_version":1,'),
    13: ("not-an-object", "run", r"(?s)^(.*)$", "[$1]"), 14: ("step-text", "steps", r'"id":"e\d+"', '"id":7'), 15: ("not-an-object", "run", r'^\{', '{"status":"completed",'),
}


def raw_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``raw``: the run of every user as JSON text, some broken by :data:`FAULTS`."""
    fields = ["id", "kind", "content", "tool", "call_id", "status"]
    per = views.steps(spark, folder).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("s"))
    steps = F.to_json(F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in fields])))

    def changed(what: str, raw: Column) -> Column:
        out = raw
        for k, (_, part, old, new) in FAULTS.items():
            if part == what:
                out = F.when(F.col("run_id") % 17 == k, F.regexp_replace(raw, old, new)).otherwise(out)
        return out

    made = per.select("run_id", changed("steps", steps).alias("steps"))
    run = F.concat(F.lit('{"schema_version":1,"run_id":"r'), "run_id", F.lit('","task":"review","status":"completed","steps":'), "steps", F.lit("}"))
    return made.withColumn("run", run).select(changed("run", F.col("run")).alias("raw"))


def published_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs validated and published in one scan, both parts read back."""
    path = _made(ship(spark), folder, "published")
    report.write_valid(validate.check(raw_runs(spark, folder)), path, "first")
    name = r'"run_id":"(r\d+)"'
    good = verified.read_committed(spark, path, "runs").select(F.lit("runs").alias("part"), F.lit(None).cast("string").alias("reason"), F.col("value").alias("raw"))
    bad = verified.read_committed(spark, path, "quarantine").select(F.from_json("value", "reason string, raw string").alias("q")).select(F.lit("quarantine").alias("part"), "q.reason", "q.raw")
    n = F.size(F.from_json("raw", f"steps array<{validate.STEP}>")["steps"])
    return good.unionByName(bad).select("part", "reason", F.nullif(F.regexp_extract("raw", name, 1), F.lit("")).alias("run_id"), F.when(F.col("part") == "runs", n).alias("n_steps"))


_PUBLISHED = f"""WITH {STEPS}, u AS (SELECT run_id, run_id % 17 AS k, count(*) AS n, count(status) AS results FROM s GROUP BY run_id),
r AS (SELECT *, CASE {" ".join(f"WHEN k = {k} {'AND n > 1 ' if why == 'repeated-id' else 'AND results > 0 ' if why == 'step-status' else ''}THEN '{why}'" for k, (why, *_) in FAULTS.items())} END AS reason FROM u)
SELECT CASE WHEN reason IS NULL THEN 'runs' ELSE 'quarantine' END AS part, reason, CASE WHEN k <> 4 THEN 'r' || run_id END AS run_id, CASE WHEN reason IS NULL THEN CAST(n AS INT) END AS n_steps FROM r"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (verified_trajectories, routing_audit, published_runs)}


def oracle_sql() -> dict[str, str]:
    return {
        "verified_trajectories": f"WITH {_TRAJECTORIES} SELECT subset, grp, split, n AS query_index, sample_index, CAST(n_messages AS INT) AS n_messages, messages FROM t WHERE split <> 'test'",
        "routing_audit": _AUDIT,
        "published_runs": _PUBLISHED,
    }
