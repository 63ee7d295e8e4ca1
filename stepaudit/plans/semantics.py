"""Queries of the semantic inputs over real token ids: a vocabulary, tokens and offsets of the table's texts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepaudit.functions import wordpiece
from stepaudit.operators import semantic, vectors
from stepaudit.plans.views import table
from stepaudit.scratch import folder as shared
from stepaudit.scratch import remove, written
from stepaudit.session import ship

#: Pieces of the queries' vocabulary, and numbers in a vector of their made encoder.
SIZE, WIDTH = 2000, 8


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as messages; some assistant turns call tools, whose names and arguments are cut from their texts."""
    text = F.coalesce("text", F.lit(""))
    call = F.struct(F.lit(None).cast("string").alias("id"), F.struct(F.substring(text, 1, 40).alias("name"), F.substring(text, 20, 4100).alias("arguments")).alias("function"))
    calls = F.when(F.col("role") == "assistant", F.array_repeat(call, (F.col("conv_id") % 7).cast("int"))).otherwise(F.array_repeat(call, 0))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("msg_index"), "role", F.repeat(text, 3).alias("content"), F.concat(F.lit("Which answer is due for "), "conv_id").alias("question"), calls.alias("tool_calls")
    )


def vocabulary(spark: SparkSession, folder: str) -> list[str]:
    return wordpiece.build_vocabulary(table(spark, folder, "conversations"), "text", SIZE)


def token_streams(spark: SparkSession, folder: str) -> DataFrame:
    """M9, F15 and F26 on real ids: streams of every action, their reasons and unknown tokens."""
    words = vocabulary(ship(spark), folder)
    got = semantic.streams(wordpiece.tokenize(semantic.prepare(messages(spark, folder)), words), wordpiece.CLS, wordpiece.SEP, wordpiece.UNK)
    ids = [F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c) for c in ("context", "action")]
    return got.select("run_id", "msg_index", F.size("context").alias("n_context"), F.size("action").alias("n_action"), *ids, "support_reason", "truncated", "unknown_before")


def span_audit(spark: SparkSession, folder: str) -> DataFrame:
    """F27 on real offsets: of each message, the tokens that meet its longest run of letters, in all and in the first 94."""
    words = vocabulary(ship(spark), folder)
    m = table(spark, folder, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    longest = F.reduce(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    spans = m.select("conv_id", "turn", wordpiece.tokens_of(words)(F.col("text")).alias("o"), longest.alias("w"), (F.instr("text", longest) - 1).alias("at"))
    s = semantic.span_overlap(F.col("o"), F.col("at"), F.col("at") + F.length("w"), 94)
    return spans.select("conv_id", "turn", F.size("o").alias("n_tokens"), s.alias("s")).select("conv_id", "turn", "n_tokens", "s.before", "s.retained", "s.gone")


def _encoder():
    """A made encoder: unit vectors that depend on a stream's ids and their order."""

    def run(streams: list[list[int]]) -> np.ndarray:
        made = np.array([[sum(math.sin(t * (k + 1) + p) for p, t in enumerate(s)) + 0.01 for k in range(WIDTH)] for s in streams])
        return made / np.linalg.norm(made, axis=1, keepdims=True)

    return run


def encoded_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Streams encoded through a lasting cache, first of every second conversation, then of all, then again."""
    words = vocabulary(ship(spark), folder)
    m = table(spark, folder, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("msg_index"), "role", F.col("text").alias("content"), F.lit("why").alias("question"))
    m = m.withColumn("tool_calls", F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>"))
    prepared = semantic.prepare(m).withColumn("key", semantic.cache_key("made-encoder", F.lit("train"), F.col("task"), F.col("prefix"), F.col("text")))
    got = written(semantic.streams(wordpiece.tokenize(prepared, words), wordpiece.CLS, wordpiece.SEP, wordpiece.UNK).select("run_id", "key", "context", "action"), "streams")
    cache, rows = f"{shared(spark)}/cache-{uuid.uuid4().hex}", []
    for k, part in enumerate((got.where("run_id % 2 = 0"), got, got)):
        pairs, counts = semantic.encode_cached(part, "key", _encoder, WIDTH, cache)
        size, unit = pairs.agg(F.count("*"), F.count_if((F.size("pair") == 2 * WIDTH) & (F.abs(vectors.dot(F.col("pair").cast("array<double>"), F.col("pair").cast("array<double>")) - 2) < 1e-4))).first()
        rows.append((k, counts["keys"], counts["hits"], counts["encoded"], size, unit))
    remove(got)
    return spark.createDataFrame(rows, "call int, n_keys bigint, hits bigint, encoded bigint, pairs bigint, unit_pairs bigint")


_CALLS = """WITH p AS (SELECT conv_id, turn, role, coalesce(text, '') AS c FROM conversations),
w AS (SELECT *, coalesce(array_to_string(list_filter(array_agg(CASE WHEN role <> 'system' THEN role || ' ' || left(c, 4000) END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), chr(10)), '') AS pre,
  max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM p),
k AS (SELECT conv_id, right(pre, 12000) AS pre, left(c, 4000) AS c FROM w WHERE role = 'assistant' AND turn < last),
n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT pre, c FROM k)) AS n, (SELECT count(*) FROM (SELECT DISTINCT pre, c FROM k WHERE conv_id % 2 = 0)) AS half)
SELECT CAST(call AS INT) AS call, CASE call WHEN 0 THEN half ELSE n END AS n_keys, CASE call WHEN 0 THEN 0 WHEN 1 THEN half ELSE n END AS hits, CASE call WHEN 0 THEN half WHEN 1 THEN n - half ELSE 0 END AS encoded,
  CASE call WHEN 0 THEN half ELSE n END AS pairs, CASE call WHEN 0 THEN half ELSE n END AS unit_pairs FROM n, range(3) r(call)"""


def vocabulary_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The counted vocabulary by id."""
    return spark.createDataFrame(list(enumerate(vocabulary(ship(spark), folder))), "id int, piece string")


_VOCABULARY = rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) AS w FROM conversations), c AS (SELECT w, count(*) AS n FROM w GROUP BY w),
l AS (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM c), b AS (SELECT c AS piece, row_number() OVER (ORDER BY c) * 2 AS o FROM l UNION ALL SELECT '##' || c, row_number() OVER (ORDER BY c) * 2 + 1 FROM l),
p AS (SELECT piece, sum(n) AS n FROM (SELECT w AS piece, n FROM c UNION ALL SELECT '##' || right(w, k), n FROM c, range(2, 7) r(k) WHERE length(w) > k) GROUP BY piece),
t AS (SELECT piece, n FROM p WHERE length(regexp_replace(piece, '^##', '')) > 1 ORDER BY n DESC, piece LIMIT {SIZE} - 4 - (SELECT count(*) FROM b)),
u AS (SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]']) AS piece, 0 AS part, 0 AS o, unnest(range(4)) AS k UNION ALL SELECT piece, 1, o, 0 FROM b UNION ALL SELECT piece, 2, -n, 0 FROM t)
SELECT CAST(row_number() OVER (ORDER BY part, o, k, piece) - 1 AS INT) AS id, piece FROM u"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (vocabulary_pieces, token_streams, span_audit, encoded_streams)}


def oracle_sql() -> dict[str, str]:
    return {"vocabulary_pieces": _VOCABULARY, "encoded_streams": _CALLS}
