"""Hard negatives by a Voronoi-partitioned, distributed k-nearest-neighbour join on inner products.

Components are integers, so scores are exact. With M the largest norm, a candidate x gets one more
component, sqrt(M^2 - |x|^2), and an anchor q a zero; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the
nearest candidates are those of the highest inner products. ``PIVOTS`` rows (those of the least
hashes, a bounded sample) cut the space in cells: every candidate goes to its nearest pivot and is
known by its distance r from it. At a distance d from the pivot, an anchor that only needs
candidates within D can be served by none with |d - r| > D.

Anchors are put in groups of at most ``GROUP`` by their nearest pivots. A group and a cell
give one ring [least r, largest r] that any anchor of the group may need; candidates are replicated
to those groups only whose ring of their cell they lie in, and joined there, a block of at most about
``BLOCK`` rows a task, whatever cell they come from, so that a hot cell is spread. Two rounds run:

1. Positives: the k best of an anchor's own label. D comes from its kth best score among the pivots.
2. Negatives: for each positive the best of other labels whose scores lie in a band under it. The
   band's lower end, or the kth best in it among the pivots if that is higher, gives D; its upper
   end a least distance too.

An exact join of a fixed share of the rows with all rows costs the square of the table, where bounds
do not prune; the number of replicas of a candidate is at most that of the groups, rows / GROUP.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepaudit.llm.topk import quantized
from stepaudit.scratch import remove, written

PIVOTS, GROUP, BLOCK = 256, 1024, 8192
#: Components must stay under this after scaling, so that sums of a thousand products fit 64 bits.
LARGEST = 1 << 26
#: Slack of distances, relative to the largest squared one, for rounding.
SLACK = 1e-9

_ROW = "key long, id long, label long, v array<long>"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; by floats where all sums are below 2**53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Space:
    """Pivots and the norm that augments vectors: small, of a fixed number of rows."""

    def __init__(self, rows: list, largest: float):
        self.ids = np.array([r.id for r in rows], np.int64)
        self.labels = np.array([r.label for r in rows], np.int64)
        self.v = np.array([r.v for r in rows], np.int64).reshape(len(rows), -1)
        self.square = float(largest)
        self.extra = np.sqrt(np.maximum(self.square - (self.v.astype(float) ** 2).sum(1), 0))

    def distances(self, v: np.ndarray, candidate: bool) -> np.ndarray:
        """Distances of rows from the pivots, in the augmented space."""
        x = v.astype(float)
        square = (x**2).sum(1)
        extra = np.sqrt(np.maximum(self.square - square, 0)) if candidate else np.zeros(len(x))
        whole = square + extra**2
        far = whole[:, None] + self.square - 2 * (x @ self.v.T.astype(float) + extra[:, None] * self.extra)
        return np.sqrt(np.maximum(far, 0))

    def reach(self, v: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of an anchor from candidates of a score, squared."""
        return (v.astype(float) ** 2).sum(1) + self.square - 2 * score

    @property
    def slack(self) -> float:
        return 4 * SLACK * self.square + 1e-6


def _nearest(space: Space, candidate: bool):
    """Each row's nearest pivot and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = space.distances(_matrix(batch["v"]), candidate)
            cell = far.argmin(1) if len(far) else np.zeros(0, np.int64)
            columns = [batch[c] for c in batch.schema.names] + [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell] if len(far) else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "r"])

    return run


def _kth(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, -k)[-k]) if len(scores) >= k else -np.inf


def _rings(space: Space, k: int, negatives: int, low: int, high: int):
    """For each anchor and cell, the ring of distances in which candidates may serve it (rows group, cell, least, most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, label, ids = _matrix(batch["v"]), batch["label"].to_numpy(), batch["id"].to_numpy()
            group = batch["grp"].to_numpy()
            known = _exact(v, space.v)
            outer, inner = np.full(len(v), -np.inf), np.full(len(v), np.inf)
            own = space.labels[None, :] == label[:, None]
            other = space.ids[None, :] != ids[:, None]
            if negatives:
                for i, scores in enumerate(batch["scores"].to_pylist()):
                    mine = known[i][~own[i] & other[i]]
                    ends = []
                    for s in scores:
                        band = mine[(100 * mine >= low * s) & (100 * mine <= high * s)]
                        ends.append((max(low * s / 100, _kth(band, negatives)), high * s / 100))
                    ends = [e for e in ends if e[0] <= e[1]]
                    outer[i], inner[i] = (min(e[0] for e in ends), max(e[1] for e in ends)) if ends else (np.inf, -np.inf)
            else:
                for i in range(len(v)):
                    outer[i] = _kth(known[i][own[i] & other[i]], k)
            far = space.distances(v, False)
            big = np.where(np.isneginf(outer), np.inf, np.sqrt(np.maximum(space.reach(v, np.where(np.isfinite(outer), outer, 0)), 0) + space.slack))
            small = np.where(np.isposinf(inner), 0, np.sqrt(np.maximum(space.reach(v, np.where(np.isfinite(inner), inner, 0)) - space.slack, 0)))
            big[np.isposinf(outer)] = -np.inf
            least = np.maximum(far - big[:, None], np.maximum(small[:, None] - far, 0))
            most = far + big[:, None]
            rows, cells = np.nonzero(most >= least)
            g, place = np.unique(group[rows] * len(space.ids) + cells, return_inverse=True)
            a, b = np.full(len(g), np.inf), np.full(len(g), -np.inf)
            np.minimum.at(a, place, least[rows, cells])
            np.maximum.at(b, place, most[rows, cells])
            yield pa.RecordBatch.from_arrays([pa.array(g // len(space.ids)), pa.array((g % len(space.ids)).astype(np.int32)), pa.array(a), pa.array(b)], names=["grp", "cell", "least", "most"])

    return run


def _join(k: int, negatives: int, low: int, high: int):
    """The best candidates of one block for each anchor of a group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            ids, label, x = left["id"].to_numpy(), left["label"].to_numpy(), _matrix(left["v"])
            order = np.argsort(ids, kind="stable")
            ids, label, x = ids[order], label[order], x[order]
            anchors, q = right.select([c for c in right.column_names if c != "v"]).to_pylist(), _matrix(right["v"])
            for begin in range(0, len(q), 128):
                for a, row in zip(anchors[begin : begin + 128], _exact(q[begin : begin + 128], x), strict=True):
                    other = ids != a["id"]
                    if not negatives:
                        at = np.flatnonzero(other & (label == a["label"]))
                        top = at[_best(row[at], k)]
                        out += [(a["key"], a["id"], None, int(ids[t]), int(row[t])) for t in top]
                        continue
                    at = np.flatnonzero(other & (label != a["label"]))
                    at = at[np.argsort(-row[at], kind="stable")]
                    for p, s in zip(a["positives"], a["scores"], strict=True):
                        band = at[(100 * row[at] >= low * s) & (100 * row[at] <= high * s)][:negatives]
                        out += [(a["key"], a["id"], p, int(ids[t]), int(row[t])) for t in band]
        columns = [*zip(*out, strict=True)] if out else [[]] * 5
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("key", "anchor_id", "positive_id", "id", "score"), columns, strict=True)})

    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by place."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return at[np.argsort(-scores[at], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def _groups(anchors: DataFrame, size: int) -> DataFrame:
    """Anchors' groups: runs of neighbouring cells of at most about ``size`` anchors; larger cells are dealt by a hash."""
    cells = anchors.groupBy("cell").agg(F.count("*").alias("n"), F.first("order").alias("order")).orderBy("order").collect()  # at most PIVOTS rows
    rows, group, held = [], -1, size
    for c in cells:
        parts = -(-c.n // size)
        if parts > 1 or held + c.n > size:
            group, held = group + 1, 0
        rows.append((c.cell, group, parts))
        held += c.n
        if parts > 1:
            group, held = group + parts - 1, size
    table = anchors.sparkSession.createDataFrame(rows, "cell int, base long, parts long")
    return anchors.join(F.broadcast(table), "cell").withColumn("grp", F.col("base") + F.pmod(F.xxhash64("key"), "parts")).drop("base", "parts")


def _round(space: Space, rows: DataFrame, anchors: DataFrame, blocks: int, k: int, negatives: int, low: int, high: int) -> DataFrame:
    asked = anchors.select("grp", "key", "id", "label", "v", *(["positives", "scores"] if negatives else []))
    rings = asked.mapInArrow(_rings(space, k, negatives, low, high), "grp long, cell int, least double, most double")
    rings = rings.groupBy("grp", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    block = F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).alias("block")
    serve = rows.join(rings, "cell").where((F.col("r") >= F.col("least") - space.slack) & (F.col("r") <= F.col("most") + space.slack))
    serve = serve.select("grp", block, "id", "label", "v")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = serve.groupBy("grp", "block").cogroup(asked.groupBy("grp", "block")).applyInArrow(_join(k, negatives, low, high), "key long, anchor_id long, positive_id long, id long, score long")
    best = Window.partitionBy("key", "positive_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (negatives or k))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, k: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Of each anchor: its ``k`` positives (the best rows of its label), and for each the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high *
    positive_score. Higher scores come first, ties by smaller ids; components are floor(256 * x).
    Defined cases: rows with a null id or label, and vectors that are null, empty or hold null or
    non-finite components, take no part; equal rows count once; rows of an anchor's own id are
    neither its positives nor its negatives; anchors of one id with unlike labels or vectors have
    lists of their own, all under that id; vectors have one dimension (any other raises), and a
    component of 2**26 or more after scaling raises; no rows in, no rows out; other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), quantized(F.col(vector_col)).alias("v"), is_anchor.alias("anchor"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id", "label", "v"])
    rows = written(rows.withColumn("key", F.xxhash64("id", "label", "v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, large, size, least, norm, asked = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v")), F.min(F.size("v")), F.max(square), F.count_if("anchor")).first()
    if not n or not asked:
        return empty
    if size != least or large >= LARGEST or size > 1 << 10:
        raise ValueError("vectors must have one dimension of at most 1024, and components under 2**26 after scaling")
    space = Space(rows.select("key", "id", "label", "v").orderBy(F.xxhash64(F.lit(7), "key"), "id").limit(PIVOTS).collect(), norm)
    cells = written(rows.select("key", "id", "label", "v").mapInArrow(_nearest(space, True), f"{_ROW}, cell int, r double"), "cells")
    # Neighbouring pivots stand together: in the order of their distances from the first one.
    order = np.argsort(np.argsort(space.distances(space.v, True)[:, 0], kind="stable"), kind="stable")
    rank = F.element_at(F.array(*[F.lit(int(o)) for o in order]), F.col("cell") + 1)
    anchors = rows.where("anchor").select("key", "id", "label", "v").mapInArrow(_nearest(space, False), f"{_ROW}, cell int, r double")
    anchors = written(_groups(written(anchors.withColumn("order", rank), "anchors"), GROUP), "groups")
    blocks = max(1, -(-n // BLOCK))
    first = written(_round(space, cells, anchors, blocks, k, 0, low, high).groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), F.col("id").alias("p")))).alias("best")), "positives")
    listed = anchors.join(first, "key").withColumns({"positives": F.col("best.p"), "scores": F.transform("best.m", lambda m: -m)})
    listed = written(listed.drop("best"), "listed")
    second = _round(space, cells, listed, blocks, k, negatives, low, high).withColumnRenamed("score", "negative_score")
    pairs = listed.select("key", F.explode(F.arrays_zip("positives", "scores")).alias("p")).select("key", F.col("p.positives").alias("positive_id"), F.col("p.scores").alias("positive_score"))
    made = second.join(pairs, ["key", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", "negative_score")
    remove(rows, first)
    return made
