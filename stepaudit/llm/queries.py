"""The queries of this folder's operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepaudit.llm import bpe, chat, flac, hard_negatives, language_id, line_dedup, lm_score, minhash, packing, spelling, suffix_dedup, token_counts, topk
from stepaudit.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=4)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(bpe.together(_table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(flac.to_media(_table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Packing with the production tokenizer."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), damage_every=31)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    made = [op1_line_dedup, op2_minhash, op3_chat, op4_bpe, op5_flac, op6_packing, op7_token_counts, op8_lm_score, op9_topk, op10_language_id, op11_spelling, op12_suffix_dedup, op13_hard_negatives]
    return {f.__name__: f for f in made} | {"pipeline": corpus_pipeline.run}


_LINES = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, p, ls[p:p+2] AS win FROM l, unnest(range(1, len(ls) - 1)) t(p)
      WHERE text IS NOT NULL AND len(list_filter(ls[p:p+2], lambda x: trim(x) <> '')) > 0),
f AS (SELECT win, min({'d': doc_id, 'p': p}) AS first FROM w GROUP BY win HAVING count(*) > 1),
later AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.win = f.win WHERE w.doc_id <> f.first.d OR w.p <> f.first.p),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM later, range(3) r(k)),
kept AS (SELECT l.doc_id, string_agg(l.ls[u.i], chr(10) ORDER BY u.i) AS text
         FROM l, unnest(range(1, len(ls) + 1)) u(i) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = u.i
         WHERE g.i IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL WHEN n.n IS NULL THEN l.text ELSE coalesce(k.text, '') END AS text,
       CAST(len(l.ls) AS INT) AS n_lines,
       CASE WHEN l.text IS NOT NULL THEN CAST(coalesce(n.n, 0) AS INT) END AS n_removed
FROM l LEFT JOIN kept k ON k.doc_id = l.doc_id LEFT JOIN n ON n.doc_id = l.doc_id
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT e.a, e.b FROM e JOIN n x ON x.doc_id = e.a JOIN n y ON y.doc_id = e.b WHERE 100 * e.c >= 80 * (x.n + y.n - e.c)),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

_CHAT = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unnamed') AS name, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'),
m AS (SELECT t.conv_id, speaker, turn, name, text,
        CASE WHEN name = 'system' THEN 'system' WHEN name = speaker THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN name = 'system' THEN '<|system|>' || chr(10) WHEN name = speaker THEN '<|assistant|>' || chr(10)
             ELSE '<|user:' || name || '|>' || chr(10) END AS head
      FROM t JOIN p ON p.conv_id = t.conv_id),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM m),
o AS (SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn, name, text
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g)
SELECT conv_id, speaker, turn, role, segment, start, length(segment) AS length,
       CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN length(segment) - length(head) END AS mask_length
FROM o
"""

_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM d, range(0, n - 99) t(i)),
f AS (SELECT s, min({'d': doc_id, 'i': i}) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.i, w.i - lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS step
      FROM w JOIN f ON f.s = w.s WHERE w.doc_id <> f.first.d OR w.i <> f.first.i),
g AS (SELECT doc_id, i, count_if(coalesce(step, 101) > 100) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
p AS (SELECT s.*, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT p.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h,
             sum(b - a) AS gone, count(*) AS spans FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed,
       coalesce(k.spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS own, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINES, "op2_minhash": _NEAR, "op3_chat": _CHAT, "op9_topk": _TOPK, "op12_suffix_dedup": _REPEATS, "op13_hard_negatives": _NEGATIVES}
