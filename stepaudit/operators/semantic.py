"""Semantic inputs: character limits and their audits, token budgets, support reasons, spans, encoding and the head."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepaudit.operators import features, vectors
from stepaudit.session import ship

#: Characters of a task, part, prefix and tool name; calls; tokens of a whole action; pair of streams a batch.
TASK_CHARS, PART_CHARS, PREFIX_CHARS, NAME_CHARS = 4000, 4000, 12_000, 128
MAX_CALLS, ACTION_ALONE, STREAM_TOKENS, BATCH = 4, 253, 256, 8
PREFIX_SLOTS = 2


def counts(length: Column, cap: int) -> Column:
    """``before, retained, removed`` of a length under a limit."""
    n = length.cast("long")
    return F.struct(n.alias("before"), F.least(n, F.lit(cap)).alias("retained"), F.greatest(n - cap, F.lit(0)).cast("long").alias("removed"))


def ends(text: Column, most: int = PART_CHARS) -> Column:
    """The text, or its first and last half of ``most`` characters."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.right(text, F.lit(half))))


def clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), features.ANSWER, features.OMITTED)


def prepare(messages: DataFrame) -> DataFrame:
    """The input of every scorable action: ``run_id, msg_index, task, prefix, text, calls, call_count, name_overflow, audit``.

    ``messages`` has ``run_id, msg_index, question, role, content, tool_calls``. The prefix is that of the
    two slots before; nothing after the action is read. Answer tags go from every field, names and
    arguments included.
    """
    run = Window.partitionBy("run_id")
    calls = F.transform(features.calls_of(messages, any_role=True), lambda c: F.struct(clean(c["function"]["name"]).alias("name"), clean(c["function"]["arguments"]).alias("arguments")))
    live = F.col("role").isin(features.ROLES)
    base = messages.withColumns({"c": F.when(live, calls), "t": clean(F.col("content"))})
    part = F.concat_ws("\n", F.concat("role", F.lit(" "), F.substring("t", 1, PART_CHARS)), F.transform("c", lambda c: F.concat(c["name"], F.lit(" "), F.substring(c["arguments"], 1, PART_CHARS))))
    cut = F.greatest(F.length("t") - PART_CHARS, F.lit(0)) + F.aggregate("c", F.lit(0), lambda a, c: a + F.greatest(F.length(c["arguments"]) - PART_CHARS, F.lit(0)))
    base = base.withColumns({"part": F.when(live, part), "cut": F.when(live, cut).otherwise(0)})
    before = run.orderBy("msg_index").rowsBetween(-PREFIX_SLOTS, -1)
    base = base.withColumns({
        "prefix_all": F.array_join(F.collect_list("part").over(before), "\n"), "cut": F.coalesce(F.sum("cut").over(before), F.lit(0)),
        "last": F.max(F.when(F.col("role") == "assistant", F.col("msg_index"))).over(run), "task_all": clean(F.col("question")),
    })
    acts = base.where((F.col("role") == "assistant") & (F.col("msg_index") < F.col("last")))
    kept = F.transform(F.slice("c", 1, MAX_CALLS), lambda c: F.struct(F.substring(c["name"], 1, NAME_CHARS).alias("name"), ends(c["arguments"]).alias("arguments")))
    audit = F.struct(
        counts(F.length("task_all"), TASK_CHARS).alias("task"), counts(F.length("prefix_all"), PREFIX_CHARS).alias("prefix"), counts(F.length("t"), PART_CHARS).alias("text"),
        F.col("cut").cast("long").alias("previous_removed"),
        F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + F.greatest(F.length(c["arguments"]) - PART_CHARS, F.lit(0)) + F.greatest(F.length(c["name"]) - NAME_CHARS, F.lit(0))).alias("calls_removed"),
    )
    return acts.select(
        "run_id", "msg_index", F.substring("task_all", 1, TASK_CHARS).alias("task"), F.right("prefix_all", F.lit(PREFIX_CHARS)).alias("prefix"),
        F.concat(F.lit("assistant "), F.substring("t", 1, PART_CHARS)).alias("text"), kept.alias("calls"), F.size("c").alias("call_count"),
        F.exists("c", lambda c: F.length(c["name"]) > NAME_CHARS).alias("name_overflow"), audit.alias("audit"),
    )


def _unknown(ids: Column, unk: int) -> Column:
    """Empty, or nothing but the unknown token."""
    return F.forall(ids, lambda x: x == unk)


def streams(tokens: DataFrame, cls: int, sep: int, unk: int) -> DataFrame:
    """Adds ``context, action, support_reason, truncated, unknown_before`` to token ids.

    ``tokens`` has ``task, prefix, text, content`` (ids; ``content`` is the text without its role), ``calls``
    (``name, arguments`` ids and ``has_arguments``), ``call_count`` and ``name_overflow``. More than four calls
    replace a long name as reason; of the others the first counts, by call, then by check.
    """
    few = F.col("call_count") > 0
    text = F.when(few, vectors.head(F.col("text"), vectors.TEXT)).otherwise(vectors.head(F.col("text"), vectors.TEXT_ALONE))
    body = F.flatten(F.transform("calls", lambda c: F.concat(vectors.head(c["name"], vectors.NAME), vectors.arguments(c["arguments"]), F.array(F.lit(sep)))))
    one, end = F.array(F.lit(cls)), F.array(F.lit(sep))

    def call_reason(c: Column) -> Column:
        name, args = vectors.head(c["name"], vectors.NAME), vectors.arguments(c["arguments"])
        return (
            F.when(F.size(c["name"]) > vectors.NAME, "tool-name-exceeds-eight-tokens").when(_unknown(name, unk), "unknown-or-empty-tool-name")
            .when(c["has_arguments"] & _unknown(args, unk), "unknown-only-tool-arguments")
        )

    first = F.get(F.filter(F.transform("calls", call_reason), lambda r: r.isNotNull()), F.lit(0))
    bare = F.when(~few & _unknown(vectors.head(F.col("content"), ACTION_ALONE), unk), "empty-or-unknown-only-action")
    reason = F.when(F.col("call_count") > MAX_CALLS, "more-than-four-current-calls").when(F.col("name_overflow"), "tool-name-exceeds-128-characters")
    caps = {"task": F.lit(vectors.TASK), "prefix": F.lit(vectors.PREFIX), "text": F.when(few, vectors.TEXT).otherwise(vectors.TEXT_ALONE)}
    cut = F.exists("calls", lambda c: (F.size(c["name"]) > vectors.NAME) | (F.size(c["arguments"]) > vectors.ARGS_HEAD + vectors.ARGS_TAIL))
    for k, cap in caps.items():
        cut |= F.size(k) > cap
    seen = F.aggregate("calls", F.lit(0), lambda a, c: a + F.size(F.filter(F.concat(c["name"], c["arguments"]), lambda x: x == unk)))
    for k in caps:
        seen += F.size(F.filter(k, lambda x: x == unk))
    return tokens.withColumns({
        "context": F.concat(one, vectors.head(F.col("task"), vectors.TASK), vectors.tail(F.col("prefix"), vectors.PREFIX), end),
        "action": F.concat(one, text, body, end), "support_reason": F.coalesce(reason, first, bare), "truncated": cut, "unknown_before": seen,
    })


def allocate(tokens: DataFrame, cls: int, sep: int) -> DataFrame:
    """The earlier contract: ``context, action`` of ids ``task, prefix, action_ids`` and ``truncated`` by field."""
    caps = {"task": vectors.TASK, "prefix": vectors.PREFIX, "action_ids": vectors.TEXT_ALONE}
    one, end = F.array(F.lit(cls)), F.array(F.lit(sep))
    return tokens.withColumns({
        "context": vectors.context(F.col("task"), F.col("prefix"), cls, sep), "action": F.concat(one, vectors.head(F.col("action_ids"), vectors.TEXT_ALONE), end),
        "truncated": F.struct(*[(F.size(k) > n).alias(k) for k, n in caps.items()]), "token_counts": F.struct(*[counts(F.size(k), n).alias(k) for k, n in caps.items()]),
    })


def span_overlap(offsets: Column, start: Column, end: Column, limit: int) -> Column:
    """``before, retained, gone``: tokens whose offsets meet the span [start, end), in all and in the first ``limit``."""
    meets = F.filter(offsets, lambda o: (o["start"] < end) & (o["end"] > start))
    kept = F.filter(F.slice(offsets, 1, limit), lambda o: (o["start"] < end) & (o["end"] > start))
    return F.struct(F.size(meets).alias("before"), F.size(kept).alias("retained"), (F.size(kept) == 0).alias("gone"))


def coverage(samples: DataFrame, groups: DataFrame) -> DataFrame:
    """Steps, groups, supported and truncated steps, unknown tokens and unsupported reasons by split, label and subset, over frozen groups.

    ``groups`` (``grp, split, subset``) give the group counts, so groups without a target count too; a
    label's cell has all groups of its split. ``label`` and ``subset`` are null in totals.
    """
    ok = F.col("support_reason").isNull()
    sets = [["split"], ["split", "label"], ["split", "subset"]]
    made = samples.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, ("split", "label", "subset"))).agg(
        F.count("*").alias("steps"), F.count_distinct("grp").alias("groups_with_targets"), F.count_if(ok).alias("supported"), F.count_if(~ok).alias("unsupported"),
        F.count_if("truncated").alias("truncated"), F.coalesce(F.sum("unknown_before"), F.lit(0)).cast("long").alias("unknown_before"),
    )
    why = samples.where("support_reason IS NOT NULL").groupingSets([[F.col(c) for c in s] + [F.col("support_reason")] for s in sets], *map(F.col, ("split", "label", "subset", "support_reason"))).agg(F.count("*").alias("n"))
    told = why.groupBy(*[F.col(c).alias(f"__{c}") for c in ("split", "label", "subset")]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("support_reason", "n")))).alias("reasons"))  # a few reasons a cell
    frozen = groups.groupingSets([[F.col("split")], [F.col("split"), F.col("subset")]], F.col("split"), F.col("subset")).agg(F.count_distinct("grp").alias("groups"))
    labels = frozen.where("subset IS NULL").select("split", F.explode(F.array(*[F.lit(x) for x in (None, -1, 0, 1)]).cast("array<int>")).alias("label"), F.lit(None).cast("string").alias("subset"), "groups")
    cells = labels.unionByName(frozen.where("subset IS NOT NULL").select("split", F.lit(None).cast("int").alias("label"), "subset", "groups"))
    same = [cells[c].eqNullSafe(made[c]) for c in ("split", "label", "subset")]
    joined = cells.join(made, same, "left").select(cells["split"], cells["label"], cells["subset"], "groups", *[F.coalesce(c, F.lit(0)).alias(c) for c in made.columns[3:]])
    own = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("split", "label", "subset")]
    return joined.join(told, own, "left").select(*joined.columns, F.coalesce("reasons", F.create_map().cast("map<string,bigint>")).alias("reasons"))


def encode(rows: DataFrame, key: str, load: Callable[[], Callable[[list[list[int]]], np.ndarray]], width: int) -> DataFrame:
    """``key, pair`` of rows with ``context, action``: each distinct key is encoded once, context then action.

    ``load`` runs once a task and gives a function from at most BATCH token lists to unit vectors. The key
    must tell splits apart, so that no vector is shared between them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load()
        for f in frames:
            pairs = []
            for i in range(0, len(f), BATCH // 2):
                part = f.iloc[i : i + BATCH // 2]
                lists = [list(map(int, x)) for c, a in zip(part["context"], part["action"], strict=True) for x in (c, a)]
                if any(not 2 <= len(x) <= STREAM_TOKENS for x in lists):
                    raise ValueError("a stream has 2 to 256 tokens")
                made = np.asarray(call(lists), np.float32).reshape(len(part), 2 * width)
                if not np.isfinite(made).all() or not np.allclose(np.linalg.norm(made.reshape(-1, width), axis=1), 1, atol=1e-5):
                    raise ValueError("a vector is not finite or has not unit length")
                pairs += made.tolist()
            yield pd.DataFrame({key: f[key].to_numpy(), "pair": pairs})

    kind = rows.schema[key].dataType.simpleString()
    # Streams of like length share a batch.
    ordered = rows.select(key, "context", "action").dropDuplicates([key]).sortWithinPartitions(F.size("context") + F.size("action"), key)
    return ordered.mapInPandas(run, f"{key} {kind}, pair array<float>")


def encode_cached(rows: DataFrame, key: str, load: Callable[[], Callable[[list[list[int]]], np.ndarray]], width: int, cache: str) -> tuple[DataFrame, dict[str, int]]:
    """:func:`encode` with a lasting cache of pairs in the shared folder ``cache``, and ``keys, hits, encoded`` of this call.

    Only keys that the cache lacks are encoded; they are added to it in one committed append, so a job
    that fails adds nothing. Equal keys from jobs that ran at one time count once. The cache is
    joined by key, never broadcast by hand: it grows with what was encoded.
    """
    spark = ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    spark.createDataFrame([], f"{key} {kind}, pair array<float>").write.mode("append").parquet(cache)

    def held() -> DataFrame:
        return spark.read.schema(f"{key} {kind}, pair array<float>").parquet(cache).dropDuplicates([key])

    distinct = rows.select(key, "context", "action").dropDuplicates([key])
    n = distinct.count()
    before = distinct.select(key).join(held().select(key), key, "left_semi").count()
    encode(distinct.join(held().select(key), key, "left_anti"), key, load, width).write.mode("append").parquet(cache)
    return distinct.select(key).join(held(), key), {"keys": n, "hits": before, "encoded": n - before}


def cache_key(identity: str, *parts: Column) -> Column:
    """A digest of the encoder's identity and a sample's split, input and token ids."""
    return F.sha2(F.to_json(F.struct(F.lit(identity).alias("i"), *[p.alias(f"p{k}") for k, p in enumerate(parts)])), 256)


def fit_head(samples: DataFrame, pair_col: str = "pair", c: float = 1.0, iterations: int = 500):
    """One fit on supported train rows; any test row, or a missing class, raises. Returns the weights by class and the intercept."""
    from pyspark.ml.functions import array_to_vector

    from stepaudit.operators import tfidf

    if samples.where(~F.col("split").isin("train", "validation")).first() is not None:
        raise ValueError("only train and validation rows may come near a fit")
    rows = samples.where("split = 'train' AND support_reason IS NULL").select((F.col("label") + 1).cast("double").alias("label"), array_to_vector(F.col(pair_col).cast("array<double>")).alias("features"))
    found = rows.groupBy("label").count().collect()
    if {r.label for r in found} != {0.0, 1.0, 2.0}:
        raise ValueError("the supported train rows must have all classes")
    model = tfidf.fit(rows, sum(r["count"] for r in found), c, iterations)
    return model.coefficientMatrix.toArray(), model.interceptVector.toArray()
