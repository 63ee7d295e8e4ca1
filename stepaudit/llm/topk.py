"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt to blocks of about ``CANDIDATES`` by a hash; in each block every dimension has a
list of the vectors sorted by that component. A query reads all lists in step from the end that
its own component's sign favours, scores each vector that it meets by random access, and stops
when the sum of the lists' present values cannot reach its kth score, or every vector of the block
has been met. ``TOGETHER`` queries read in step: a vector that one of them meets is scored for all
that have not stopped, by one product of matrices. A block's best k are exact, so the best k of all
blocks' are. Queries too go in blocks: a task holds one block of either kind, whatever the tables'
sizes, and nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepaudit.scratch import written

CANDIDATES = 8192
QUERIES = 4096
TOGETHER = 256
FIRST_DEPTH = 16


def _merged(at: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query (``at``), in order."""
    order = np.lexsort((found, -score, at))
    at, found, score = at[order], found[order], score[order]
    top = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[top], found[top], score[top]


def threshold_search(ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (the query's place, ids, scores) of one block for each query; ``lists`` are ascending per dimension."""
    n, m, dims = len(ids), len(own), np.arange(vectors.shape[1])
    least = -np.inf if vectors.dtype == np.float64 else np.iinfo(vectors.dtype).min
    at, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
    zero = ~queries.any(axis=1)
    if zero.any():  # every score is zero
        by_id = np.sort(ids, kind="stable")
        firsts = [(i, by_id[by_id != own[i]][:k]) for i in np.flatnonzero(zero)]
        at, found = np.concatenate([np.full(len(f), i) for i, f in firsts]), np.concatenate([f for _, f in firsts])
        score = np.zeros(len(at), vectors.dtype)
    live, seen, kth = np.flatnonzero(~zero), np.zeros(n, bool), np.full(m, least, vectors.dtype)
    depth, done = FIRST_DEPTH, 0
    while len(live) and done < n:
        depth = min(depth, n)
        q = queries[live]
        met = np.zeros(n, bool)
        met[lists[(q > 0).any(axis=0), n - depth : n - done]] = True
        met[lists[(q < 0).any(axis=0), done:depth]] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        fresh = q @ vectors[new].T
        fresh[own[live][:, None] == ids[new]] = least
        cut = kth[live]
        if len(new) > k and (cut == least).any():  # the kth of the new ones bounds them
            cut[cut == least] = np.partition(fresh[cut == least], len(new) - k, axis=1)[:, len(new) - k]
        row, column = np.nonzero((fresh >= cut[:, None]) & (fresh > least))
        at, found, score = _merged(np.concatenate([at, live[row]]), np.concatenate([found, ids[new[column]]]), np.concatenate([score, fresh[row, column]]), k)
        full = np.bincount(at, minlength=m) >= k
        kth[full] = score[np.searchsorted(at, np.flatnonzero(full), "right") - 1]
        if seen.all():
            break
        bound = np.maximum(q, 0) @ vectors[lists[:, n - depth], dims] + np.minimum(q, 0) @ vectors[lists[:, depth - 1], dims]
        live = live[kth[live] <= bound]
        done, depth = depth, depth * 2
    return at, found, score


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            ids, queries = left["id"].to_numpy(), right["id"].to_numpy()
            rows = right["row"].to_numpy()
            x, q = _matrix(left["v"]), _matrix(right["v"])
            most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * x.shape[1]
            if most >= 2**62:
                raise OverflowError("a score does not fit 64 bits")
            if most < 2**52:
                x, q = x.astype(np.float64), q.astype(np.float64)  # sums stay exact
            lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
            for i in range(0, len(q), TOGETHER):
                at, found, score = threshold_search(ids, x, lists, queries[i : i + TOGETHER], q[i : i + TOGETHER], k)
                out.append((rows[i + at], queries[i + at], found, score.astype(np.int64)))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4)]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("row", "query_id", "vec_id", "score"), columns, strict=True)})

    return run


def quantized(vector: Column) -> Column:
    """floor(256 * x) of every component, or null where a component is null or not finite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(x, lambda c: F.floor(c * 256)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best of all other vectors, ties to smaller ids.

    Components are quantized by :func:`quantized`. Defined cases: vectors that are null, empty or
    hold null or non-finite components, and null ids, take no part; a query meets vectors of its
    own dimension only, and never one with its own id; rows that repeat an id are candidates of
    their own, equal queries give one list, and queries of one id with unlike vectors a list each;
    fewer than k candidates all come; scores that might not fit 64 bits raise; no rows in, no rows
    out; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col)).alias("v"), is_query.alias("q"))
    rows = written(rows.where("id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v")), "vectors")
    n, m = rows.agg(F.count("*"), F.count_if("q")).first()
    many, some = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    deal = F.xxhash64("id", "v")
    cands = rows.withColumn("b", F.pmod(deal, F.lit(many))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(some - 1)))).select("b", "s", "dim", "id", "v")
    number = F.xxhash64("id", "v").alias("row")
    asked = rows.where("q").dropDuplicates(["id", "v"]).withColumn("s", F.pmod(deal, F.lit(some)).cast("int"))
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))).select("b", "s", "dim", number, "id", "v")
    keys = ["b", "s", "dim"]
    found = cands.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
