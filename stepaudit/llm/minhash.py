"""MinHash near-dedup by a multi-index Hamming join, with exact confirmation.

A document's set is its distinct word shingles. Texts with equal sets form one class, found by a
pre-aggregated minimum; only class representatives go on. Each has a signature of 100 minhashes,
of which 16 bits are kept. A pair differs in at most T = 39 places or is no candidate: at a
similarity of exactly 0.8 the distance is binomial with mean 20, and passes 39 in four of a million
pairs; above 0.8 the chance falls fast.
By the pigeonhole principle, two signatures within T have one of the 20 chunks of 5 with at most
39 // 20 = 1 errors, so each signature is indexed under every chunk with each place left out (100
keys): all pairs within T share a key.

Inside the buckets no step emits pairs that may fail. First each member is paired with its most
frequent bucket leaders (at most ``LEADERS`` pairs a member) and the pairs are confirmed on full
shingle sets, which joins most of a group at once. Then buckets that still hold several components
are dealt in cells of bounded size, where the members of the bucket's largest component meet only
those of other components. A cell first names the members of its candidate pairs, each pair in the
one bucket of its least common key; their shingle sets are fetched, and the cell confirms the pairs
on the full sets and emits a spanning forest, so less than one link a member. Sizes, leaders and
largest components are pre-aggregated and joined back. Signatures, sets and links stay in tables
of the shared folder, which go as soon as they have been read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepaudit.llm.arrow import binaries, flat, pieces, trimmed
from stepaudit.operators.components import connected_components
from stepaudit.scratch import remove, written

CHUNKS, WIDTH = 20, 5
PLACES = CHUNKS * WIDTH
MAX_DISTANCE = 2 * CHUNKS - 1
#: Members of one bucket that a side of a cell holds.
BLOCK = 256
LEADERS = 2
#: Places of the bitmap of wanted ids (a power of two), and bytes of a page of it.
WANTED_BITS, PAGE = 24, 4096

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WORD = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse; one size is kept for ordinary chunks."""
    size = 1 << max(18, (n - 1).bit_length())
    if size not in _POWERS:
        made = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_STEP, _UNSTEP))
        if size > 1 << 21:
            return made
        _POWERS[size] = made
    return _POWERS[size]


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of each document, repeats included, and their offsets.

    A document with fewer than n words has its whole sequence as one shingle; without words none.
    """
    base, size, docs = int(offsets[0]), int(offsets[-1] - offsets[0]), len(offsets) - 1
    if not size:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    raw = data[base : base + size]
    space = _SPACE[raw]
    cut = np.zeros(size + 1, bool)
    cut[offsets - base] = True
    solid = ~space
    start = solid.copy()
    start[1:] &= space[:-1] | cut[1:-1]
    end = solid.copy()
    end[:-1] &= space[1:] | cut[1:-1]
    at, to = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[_LOWER[raw]] * power[:size], dtype=np.uint64)])
    word = _mix((sums[to] - sums[at]) * inverse[at] + (to - at).astype(np.uint64))
    first = np.searchsorted(at, offsets - base)
    words = np.diff(first)
    rolled = word * _WORD[0]
    for k in range(1, n):
        rolled[: max(len(word) - k, 0)] += word[k:] * _WORD[k]
    made = _mix(rolled)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    take = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    out = made[take]
    for d in np.flatnonzero((words > 0) & (words < n)):
        w = word[first[d] : first[d] + words[d]]
        out[begin[d]] = _mix(np.array([(w * _WORD[32 : 32 + len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))]))[0]
    return out, begin


def _sorted_sets(made: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document and their offsets."""
    made = made.copy()
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a > 1:
            made[a:b].sort()
    new = np.ones(len(made), bool)
    if len(made):
        new[1:] = made[1:] != made[:-1]
        new[begin[:-1][np.diff(begin) > 0]] = True
    return made[new], np.concatenate([[0], np.cumsum(new)])[begin]


def signatures(made: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of PLACES 16-bit minhashes for each document; zeros for an empty one."""
    docs = len(begin) - 1
    out = np.zeros((docs, PLACES), np.uint16)
    full = np.flatnonzero(np.diff(begin) > 0)
    if not len(full):
        return out
    where, buf = begin[:-1][full], np.empty_like(made)
    for k in range(PLACES):
        np.multiply(made, _MUL[k], out=buf)
        np.add(buf, _ADD[k], out=buf)
        low = np.minimum.reduceat(buf, where)
        out[full, k] = (_mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The 100 keys of each signature: every chunk with each of its places left out."""
    x = sig.astype(np.uint64).reshape(len(sig), CHUNKS, WIDTH)
    out = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
    tag = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH)
    for left in range(WIDTH):
        h = np.zeros(x.shape[:2], np.uint64)
        for k in (k for k in range(WIDTH) if k != left):
            h = (h << np.uint64(16)) | x[:, :, k]
        out[:, :, left] = _mix(_mix(h) + (tag + np.uint64(left + 1)) * _STEP)
    return out.reshape(len(sig), PLACES).view(np.int64)


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j in pieces(offsets):
                made, begin = shingles(data, offsets[i : j + 1], n)
                sets, at = _sorted_sets(made, begin)
                h1, h2 = _set_hashes(sets, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.diff(at)), pa.array(h1), pa.array(h2), binaries(signatures(made, begin), np.arange(j - i + 1) * PLACES)],
                    names=["id", "text_hash", "n", "h1", "h2", "sig"],
                )

    return run


def _set_hashes(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each document's set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(_mix(sets + salt), dtype=np.uint64)]) for salt in (np.uint64(1), np.uint64(77))]
    return [_mix((s[at[1:]] - s[at[:-1]]) ^ np.diff(at).astype(np.uint64)).view(np.int64) for s in sums]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 2000):
            part = batch.slice(i, 2000)
            keys = chunk_keys(_matrix(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), PLACES))], names=["key", "node"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), PLACES)


def _spots(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmap of a task's ids, as its pages that are not empty."""
    bits = np.zeros(1 << WANTED_BITS, bool)
    for batch in batches:
        bits[_spots(batch.column(0).to_numpy())] = True
    pages = np.packbits(bits).reshape(-1, PAGE)
    used = np.flatnonzero(pages.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([pages[k].tobytes() for k in used], pa.binary())], names=["page", "bits"])


def _sets(n: int, shared):
    """``id, h1, shingles`` of rows (id, text) whose id the shared bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[_spots(batch.column(0).to_numpy())]))
            if not len(batch):
                continue
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets):
                sets, at = _sorted_sets(*shingles(data, offsets[i : j + 1], n))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(_set_hashes(sets, at)[0]), binaries(sets, at)], names=["id", "h1", "shingles"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


_CELL = ["key", "i", "j", "node", "comp", "blk", "n", "sig"]
_CELL_SCHEMA = "key long, i int, j int, node long, comp long, blk int, n long, sig binary"


def _cell_starts(t: dict[str, np.ndarray]) -> np.ndarray:
    new = np.ones(len(t["node"]), bool)
    new[1:] = (t["key"][1:] != t["key"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1])
    return np.flatnonzero(new)


def _candidates(t: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows) of sorted cells: other component, fitting size, within T, least common key here."""
    rows, start = len(t["node"]), _cell_starts(t)
    size = np.diff(np.append(start, rows))
    last, row = np.repeat(np.append(start[1:], rows), size), np.arange(rows)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, 200_000 // max(1, int((last - row).max(initial=1))))
    for lo in range(0, rows, step):
        r = row[lo : lo + step]
        reach = last[lo : lo + step] - r - 1
        a = np.repeat(r, reach)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(reach) - reach, reach)
        n1, n2 = t["n"][a], t["n"][b]
        ok = (t["comp"][a] != t["comp"][b]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
        ok &= (t["blk"][a] != t["blk"][b]) | (t["i"][a] == t["j"][a])
        a, b = a[ok], b[ok]
        for k in range(0, len(a), 10_000):
            x, y = a[k : k + 10_000], b[k : k + 10_000]
            near = (t["sig"][x] != t["sig"][y]).sum(1) <= MAX_DISTANCE
            if near.any():
                found.append((x[near], y[near]))
    a, b = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ([], [])))
    if not len(a):
        return a, b
    seen, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys, own = chunk_keys(t["sig"][seen]), np.zeros(len(a), bool)
    p, q = at[: len(a)], at[len(a) :]
    for k in range(0, len(a), 4_000):
        x, y = keys[p[k : k + 4_000]], keys[q[k : k + 4_000]]
        own[k : k + 4_000] = np.where(x == y, x, np.iinfo(np.int64).max).min(1) == t["key"][a[k : k + 4_000]]
    return a[own], b[own]


def _whole_cells(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[dict]:
    """Columns of batches sorted by cell, cut where a cell ends."""
    held: dict | None = None
    for batch in (b.slice(i, 2000) for b in batches for i in range(0, len(b), 2000)):
        t = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(_CELL[:-1])}
        t["sig"] = _matrix(batch.column(len(_CELL) - 1))
        t |= {c: np.array([x.as_py() for x in batch.column(len(_CELL) + k)], object) for k, c in enumerate(extra)}
        t = {c: np.concatenate([held[c], v]) for c, v in t.items()} if held else t
        cut = int(_cell_starts(t)[-1])
        held = {c: v[cut:] for c, v in t.items()}
        if cut:
            yield {c: v[:cut] for c, v in t.items()}
    if held:
        yield held


def _members(percent: int):
    """The rows of cells that stand in a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches, []):
            keep = np.unique(np.concatenate(_candidates(t, percent)))
            if len(keep):
                sig = binaries(t["sig"][keep].ravel(), np.arange(len(keep) + 1) * PLACES)
                yield pa.RecordBatch.from_arrays([*[pa.array(t[c][keep]) for c in _CELL[:-1]], sig], names=_CELL)

    return run


def _spanning(percent: int):
    """Confirmed links (a, b) of cells whose rows carry their sets: a spanning forest over the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches, ["shingles"]):
            a, b = _candidates(t, percent)
            cell = np.searchsorted(_cell_starts(t), a, "right")
            links: list[tuple[int, int]] = []
            root: dict[int, int] = {}
            at, sets = -1, {}

            def find(x: int) -> int:
                while (up := root.setdefault(x, x)) != x:
                    root[x] = root[up]
                    x = root[x]
                return x

            for c, p, q in zip(cell.tolist(), a.tolist(), b.tolist(), strict=True):
                if c != at:
                    at, root, sets = c, {}, {}
                u, v = find(int(t["comp"][p])), find(int(t["comp"][q]))
                if u == v:
                    continue
                x, y = (sets[r] if r in sets else sets.setdefault(r, np.frombuffer(t["shingles"][r], np.uint64)) for r in (p, q))
                if _alike(x, y, percent):
                    root[u] = v
                    links.append((int(t["node"][p]), int(t["node"][q])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def _fetch_sets(nodes: DataFrame, reps: DataFrame, source: DataFrame, n: int) -> DataFrame:
    """``node, shingles`` of the named nodes, from the text of the row that stands for each.

    A bitmap of the wanted ids, of fixed size, goes to all tasks, so that as a rule only wanted sets
    are made and shuffled; what it lets through beside them falls out in the join.
    """
    wanted = written(reps.join(nodes.select("node").distinct(), "node").select("node", F.col("rep").alias("id"), "h1"), "wanted")
    marks = wanted.select("id").mapInArrow(_marks, "page long, bits binary")
    pages = np.zeros(((1 << WANTED_BITS) // 8 // PAGE, PAGE), np.uint8)
    for r in marks.groupBy("page").agg(F.expr("bitmap_or_agg(bits)").alias("bits")).collect():  # no more rows than pages
        pages[r.page] = np.frombuffer(r.bits, np.uint8)[:PAGE]
    shared = source.sparkSession.sparkContext.broadcast(pages.tobytes())
    made = source.where("id IS NOT NULL").mapInArrow(trimmed(_sets(n, shared)), "id long, h1 long, shingles binary").dropDuplicates(["id", "h1"])
    sets = written(made.hint("merge").join(wanted, ["id", "h1"]).select("node", "shingles"), "sets")
    remove(wanted)
    shared.unpersist()
    return sets


def _leader_links(buckets: DataFrame, reps: DataFrame, source: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links of nodes with the least members of their buckets, LEADERS pairs a node at most."""
    votes = buckets.where("node != leader").groupBy("node", "leader").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("node").orderBy(F.desc("votes"), "leader")  # a node has at most 100 leaders
    star = votes.withColumn("r", F.row_number().over(best)).where(F.col("r") <= LEADERS)
    sizes = reps.select("node", "n")
    star = (
        star.select(F.col("leader").alias("a"), F.col("node").alias("b"))
        .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        .join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
        .where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")).select("a", "b")
    )
    star = written(star, "pairs")
    sets = _fetch_sets(star.select(F.col("a").alias("node")).union(star.select("b")), reps, source, n)
    one = star.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
    links = written(two.mapInArrow(trimmed(_similar(percent)), "a long, b long"), "links")
    remove(star, sets)
    return links


def _cell_links(buckets: DataFrame, joined: DataFrame, reps: DataFrame, source: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links between the components that ``joined`` leaves apart in a bucket."""
    labelled = (
        buckets.select("key", "node").join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    )
    labelled = written(labelled, "labelled")
    shares = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"))
    mixed = written(mixed.where("comps > 1").select("key", F.col("top.comp").alias("main"), F.col("top.c").alias("many"), (F.col("size") - F.col("top.c")).alias("few")), "mixed")
    rest, main = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("few", "many"))
    inside = F.col("comp") == F.col("main")
    deal = F.xxhash64("node")
    dealt = (
        labelled.hint("merge").join(mixed, "key").hint("merge").join(reps.select("node", "n", "sig"), "node")
        .withColumn("blk", F.when(inside, rest + F.pmod(deal, main)).otherwise(F.pmod(deal, rest)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, rest - 1).otherwise(rest + main - 1))))
        .select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "node", "comp", "blk", "n", "sig")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    )
    cells = written(dealt.mapInArrow(trimmed(_members(percent)), _CELL_SCHEMA), "cells")
    remove(labelled, mixed)
    sets = _fetch_sets(cells, reps, source, n)
    filled = cells.join(sets, "node").select(*_CELL, "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    links = written(filled.mapInArrow(trimmed(_spanning(percent)), "a long, b long"), "links")
    remove(cells, sets)
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """:func:`near_duplicates` with ``text_hash, set_hash, stays`` for every row of ``docs``.

    ``text_hash`` is xxhash64 of the text and tells rows of one id apart. ``stays`` says that the row
    is the one of its component to keep: it has the least id and, of several sets with this id, the
    least ``set_hash``; of rows that share both, one is enough.
    """
    if percent < 80:
        raise ValueError("the signature distance is chosen for a similarity of 0.8 or more")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    feats = source.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        trimmed(_features(n)), "id long, text_hash long, n long, h1 long, h2 long, sig binary"
    )
    feats = written(feats, "features")
    some = feats.where("n > 0 AND id IS NOT NULL")
    classes = some.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    reps = written(classes.select(F.monotonically_increasing_id().alias("node"), "n", "h1", "h2", "rep", "sig"), "reps")

    keys = reps.select("node", "sig").mapInArrow(trimmed(_keys), "key long, node long")
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1").select("key", "leader"), "sizes")
    buckets = written(keys.hint("merge").join(sizes, "key"), "buckets")
    remove(sizes)
    links = _leader_links(buckets, reps, source, n, percent)
    joined = connected_components(links)
    more = _cell_links(buckets, joined, reps, source, n, percent)
    remove(buckets)
    if not more.isEmpty():
        remove(joined)
        joined = connected_components(links.unionByName(more))
    remove(links, more)

    known = written(
        reps.join(joined, "node", "left").select("n", "h1", "h2", "rep", F.coalesce("component", "node").alias("comp")), "known"
    )
    remove(joined, reps)
    first = known.groupBy("comp").agg(F.min(F.struct("rep", "h1", "h2")).alias("first"))
    named = written(known.join(first, "comp").select("n", "h1", "h2", "first"), "named")
    remove(known)
    own = F.struct(F.col("id").alias("rep"), "h1", "h2")
    return (
        feats.drop("sig").join(named, ["n", "h1", "h2"], "left")
        .select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("first.rep", "id")).alias("component_id"),
            "text_hash", F.col("h1").alias("set_hash"),
            (F.col("id").isNull() | F.col("first").isNull() | (own == F.col("first"))).alias("stays"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "set_hash", "stays")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts whose shingle sets have 100 * intersection >= ``percent`` * union are linked;
    component_id is the smallest id reachable and kept says that it is the row's own.
    Defined cases: null, empty and blank texts have no shingles and stand alone; a null id
    links with nothing, has a null component and is kept; rows that repeat an id with one text
    share its component, and those with other texts have their own; ids are integers; no rows give
    none; other columns are ignored. ``percent`` below 80 would need a larger distance.
    """
    return near_groups(docs, id_col, text_col, n, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows and columns of ``docs``, one of each group of near copies.

    Defined cases: texts without words and rows without an id all stay, but rows equal in id and
    text count as one; rows that repeat an id with unlike texts all stay unless another is near them;
    an empty table stays empty. Columns may have any names.
    """
    names, numbered = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    id_col, text_col = (numbered[names.index(c)] for c in (id_col, text_col))
    docs = docs.toDF(*numbered)
    groups = near_groups(docs, id_col, text_col, n, percent)
    cls = [F.col("doc_id"), F.when(F.col("n_shingles") == 0, F.col("text_hash")).otherwise(F.col("set_hash")).alias("set_hash")]
    same = groups.where("stays AND doc_id IS NOT NULL").select(*cls, "text_hash").groupBy("doc_id", "set_hash")
    same = same.agg(F.count("*").alias("c")).where("c > 1")
    repeated = groups.where("stays").select(*cls, "text_hash").join(same, ["doc_id", "set_hash"]).select("doc_id", "text_hash", "set_hash").distinct()
    verdict = groups.where("NOT stays").select("doc_id", "text_hash", F.lit(None).cast("long").alias("set_hash")).distinct().unionByName(repeated)
    verdict = written(verdict.select(F.col("doc_id").alias("__nd_id"), F.col("text_hash").alias("__nd_text"), F.col("set_hash").alias("__nd_set")), "verdict")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__nd_id")) & (F.xxhash64(text_col) == F.col("__nd_text"))
    single = docs.join(verdict, same, "left_anti")
    again = docs.join(verdict.where("__nd_set IS NOT NULL"), same).dropDuplicates(["__nd_id", "__nd_set"])
    return single.unionByName(again.select(*numbered)).toDF(*names)
