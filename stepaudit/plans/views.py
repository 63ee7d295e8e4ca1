"""The review engine's inputs, derived from the test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Events as steps: a user is a run, clicks and views are calls, the rest results."""
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "props")
    kind = F.when(F.col("event_type").isin("click", "view"), "tool_call").otherwise("tool_result")
    status = F.when(F.col("event_type") == "error", "error").when(kind == "tool_result", "ok")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"),
        F.concat(F.lit("e"), "event_id").alias("id"), kind.alias("kind"), F.col("props").alias("content"), F.col("event_type").alias("tool"),
        F.concat(F.lit("c"), k % 10).alias("call_id"), status.alias("status"),
    )


STEPS = """s AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos, 'e' || event_id AS id,
  CASE WHEN event_type IN ('click', 'view') THEN 'tool_call' ELSE 'tool_result' END AS kind, props AS content, event_type AS tool,
  'c' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS call_id,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type NOT IN ('click', 'view') THEN 'ok' END AS status FROM events)"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("msg_index"), "role", F.col("text").alias("content"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as scored steps: a stand-in without meaning of its own."""
    d = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    y = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    score = (F.col("doc_id") * 37 % 101) / F.lit(101.0)
    plain = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x7F]")
    return d.join(y, "doc_id").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("subset"), (F.col("doc_id") % 20).alias("grp"),
        F.when(F.col("doc_id") % 5 < 3, "train").when(F.col("doc_id") % 5 == 3, "validation").otherwise("test").alias("split"),
        F.when(F.col("quality") == 0, -1).when(F.col("toxic") == 1, 0).otherwise(1).alias("label"),
        (F.col("n_chars") % 3 == 0).alias("rule"), F.when(plain, score).alias("score"), F.when(~plain, "unsupported-unicode").alias("support_reason"),
    )


SAMPLES = r"""m AS (SELECT d.doc_id, coalesce(source, '') AS subset, d.doc_id % 20 AS grp,
  CASE WHEN d.doc_id % 5 < 3 THEN 'train' WHEN d.doc_id % 5 = 3 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN quality = 0 THEN -1 WHEN toxic = 1 THEN 0 ELSE 1 END AS label, n_chars % 3 = 0 AS rule,
  CASE WHEN regexp_matches(coalesce(text, ''), '[^\x00-\x7F]') THEN NULL ELSE (d.doc_id * 37 % 101) / 101.0::DOUBLE END AS score,
  CASE WHEN regexp_matches(coalesce(text, ''), '[^\x00-\x7F]') THEN 'unsupported-unicode' END AS support_reason
  FROM documents d JOIN labels y ON y.doc_id = d.doc_id)"""
