"""Mixture-controlled packing by deficit round-robin over source queues.

A queue is a source; its documents' ids, each document closed by one end id, form one stream. All
windows hold ``length`` ids and take from each queue its target share, which is ``targets``' or, by
default, the queue's share of all ids. A queue's turn gives it whole ids only: what its share leaves
over is its deficit and is carried to the next window, also from one partition to the next. A queue
that has run dry leaves its share to the others, in their proportions, from that very id on; so
every window but the last is full. With natural targets all queues run dry together.

The carried deficits have a closed form: between two queues' ends, the live queues are the leaves of
a tree, and of x ids that a node has had, its left part has had floor(x * W_left / W_node) and its
right part the rest, W being joint target weights. Both parts grow with x, so that a queue of any
size, also of less than an id a window, gets its ids in order every few windows. Hence any window's
pieces follow from a document's place in its queue alone, on any partition, with no pass over the
windows.

A document's place is the sum of the buckets before its own (documents are dealt to buckets by
hash; their number follows from the ids, not from the cluster) and of those before it in its
bucket. Only the name and size of each queue reach the driver.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepaudit.llm.bpe import load_ranks
from stepaudit.llm.pretokens import Splitter
from stepaudit.scratch import written

LENGTH = 2048
END_ID = 1
CACHE_WORDS = 500_000
#: Ids of a bucket, about, and the least and most buckets.
BUCKET_IDS, MIN_BUCKETS, MAX_BUCKETS = 1 << 20, 256, 1 << 20
#: Targets are rounded to whole weights of this sum.
WEIGHT = 1 << 40
_STATE: dict[str, tuple] = {}


class _Words(dict):
    """Packed ids of words, filled by the same ranks as the library's."""

    def __init__(self, core, kind: np.dtype):
        super().__init__()
        self.core, self.kind = core, kind

    def __missing__(self, word: str) -> bytes:
        self[word] = b = np.array(self.core.encode_ordinary(word), self.kind).tobytes()
        return b


def id_type(path: str) -> np.dtype:
    """Ids travel in two bytes if the vocabulary fits, else in four."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")


def _tokenizer(path: str, ranks_path: str, pattern: str, kind: np.dtype) -> tuple:
    """The library's tokenizer, its special strings, and a word cache."""
    if path not in _STATE:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        _STATE[path] = (t, [x.content for x in t.get_added_tokens_decoder().values()], Splitter(pattern), _Words(core, kind))
    return _STATE[path]


def _tokenize(path: str, ranks_path: str, pattern: str, end_id: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, special, split, words = _tokenizer(path, ranks_path, pattern, kind)
        end = np.array(end_id, kind).tobytes()
        for batch in batches:
            out = []
            for x in batch.column(1):
                text = x.as_py() or ""
                if any(s in text for s in special):
                    out.append(np.array(t.encode(text, add_special_tokens=False).ids, kind).tobytes() + end)
                    continue
                out.append(b"".join(map(words.__getitem__, split(text))) + end)
                if len(words) >= CACHE_WORDS:
                    words.clear()
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "source": batch.column(2), "n": pa.array([len(b) // kind.itemsize for b in out], pa.int64()), "ids": pa.array(out, pa.binary())}
            )

    return run


def _tree(weights: list[int]) -> tuple[list[int], list[list[tuple[int, int, bool]]]]:
    """Prefix sums of weights, and each leaf's way from the root: (left weight, node weight, goes right)."""
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    ways: list[list[tuple[int, int, bool]]] = [[] for _ in weights]
    open_nodes = [(0, len(weights))]
    while open_nodes:
        lo, hi = open_nodes.pop()
        if hi - lo < 2:
            continue
        mid = min(max(bisect.bisect_left(sums, (sums[lo] + sums[hi]) // 2, lo, hi), lo + 1), hi - 1)
        for q in range(lo, hi):
            ways[q].append((sums[mid] - sums[lo], sums[hi] - sums[lo], q >= mid))
        open_nodes += [(lo, mid), (mid, hi)]
    return sums, ways


def _dealt(way: list[tuple[int, int, bool]], x: int) -> tuple[int, int]:
    """Of x ids, how many the leaves before a way's and its own have had."""
    before = 0
    for left, node, right in way:
        part = x * left // node
        if right:
            before, x = before + part, x - part
        else:
            x = part
    return before, x


class Plan:
    """Where each queue's ids go; ``sizes`` are the queues' ids and ``weights`` their targets, in a fixed order."""

    def __init__(self, sizes: list[int], length: int, weights: list[int] | None = None):
        self.length, self.total, self.sizes = length, sum(sizes), sizes
        self.windows = -(-self.total // length)
        weights = weights or sizes
        #: Spans between the ends of queues: first id, live queues' ways, what every queue had before, and sums of that.
        self.spans: list[tuple[int, dict[int, list], list[int], list[int]]] = []
        had, at = [0] * len(sizes), 0
        while at < self.total:
            live = [q for q, n in enumerate(sizes) if had[q] < n]
            ways = dict(zip(live, _tree([max(weights[q], 1) for q in live])[1], strict=True))
            self.spans.append((at, ways, list(had), list(accumulate(had, initial=0))))

            def fits(x: int, ways=ways, had=had) -> bool:
                return all(_dealt(way, x)[1] <= sizes[q] - had[q] for q, way in ways.items())

            lo, hi = 0, self.total - at  # the most ids until a queue has run dry
            if not fits(hi):
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if fits(mid) else (lo, mid)
                hi = lo
            for q, way in ways.items():
                had[q] += _dealt(way, hi)[1]
            at += hi
        self.firsts = [s[0] for s in self.spans]

    def had(self, q: int, x: int) -> tuple[int, int]:
        """Of the first x ids, how many the queues before q and q itself have had."""
        first, ways, base, sums = self.spans[bisect.bisect_right(self.firsts, x) - 1]
        own = base[q]
        if q in ways:
            before, mine = _dealt(ways[q], x - first)
            return before + sums[q], own + mine
        after = next((k for k in ways if k > q), None)
        ids = x - first if after is None else _dealt(ways[after], x - first)[0]
        return ids + sums[q], own

    def window(self, q: int, w: int) -> tuple[int, int]:
        return self.had(q, min(w * self.length, self.total))

    def pieces(self, q: int, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, window, offset) for n ids that begin at ``place`` of queue q."""
        near = place * self.total // (self.sizes[q] * self.length)
        lo, step = min(near, self.windows), 1
        while lo > 0 and self.window(q, lo)[1] > place:
            lo, step = max(lo - step, 0), 2 * step
        hi, step = lo + 1, 1
        while hi < self.windows and self.window(q, hi)[1] <= place:
            lo, hi, step = hi, min(hi + step, self.windows), 2 * step
        w = bisect.bisect_right(range(lo, hi), place, key=lambda k: self.window(q, k)[1]) + lo - 1
        at, (before, own) = place, self.window(q, w)
        while at < place + n:
            before_next, own_next = self.window(q, w + 1)
            stop = min(own_next, place + n)
            if stop > at:
                yield at - place, stop - at, w, before_next - before + at - own
            at, w, before, own = max(at, stop), w + 1, before_next, own_next


def _pieces(shared, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        at, here = None, 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            bucket, queue, base = (batch.column(k).to_pylist() for k in (0, 1, 2))
            keys, ids = batch.column(3).to_pylist(), batch.column(4)
            for k in range(len(batch)):
                if (bucket[k], queue[k]) != at:
                    at, here = (bucket[k], queue[k]), base[k]
                raw = np.frombuffer(ids[k].as_buffer(), kind).astype("<u4").tobytes()
                n = len(raw) // 4
                for s, m, w, o in plan.pieces(queue[k], here, n):
                    for c, v in zip(cols, (keys[k], s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), n, w, o), strict=True):
                        c.append(v)
                here += n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(names, cols, strict=True)})

    return run


def _weights(names: list[str | None], sizes: list[int], targets: dict[str | None, float] | None) -> list[int]:
    if targets is None:
        return sizes
    if any(not np.isfinite(x) or x < 0 for x in targets.values()) or sum(targets.values()) <= 0:
        raise ValueError("targets are proportions")
    scale = WEIGHT / sum(targets.values())
    return [max(round(targets.get(n, 0.0) * scale), 1) for n in names]


def pack(
    docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", length: int = LENGTH, end_id: int = END_ID, targets: dict[str | None, float] | None = None,
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Sequences have ids from 0 without gaps; all but the last are full. ``targets`` gives proportions by
    source (they need not add up to one; a source without one comes last); None takes each source's
    own share. Defined cases: a null text is
    an empty one, which still has its end id; a null source is a queue of its own; rows that repeat
    an id are documents of their own; a null id stays null; no rows give no pieces; other columns
    are ignored.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    schema, kind = "doc_id long, source string, n long, ids binary", id_type(tokenizer_path)
    if end_id > np.iinfo(kind).max:
        kind = np.dtype("<u4")
    tokens = written(chosen.mapInArrow(_tokenize(tokenizer_path, ranks_path, pattern, end_id, kind), schema), "tokens")

    queues = tokens.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_first()).collect()  # one row a source
    if not queues:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    sizes = [r.n for r in queues]
    plan = Plan(sizes, length, _weights([r.source for r in queues], sizes, targets))
    shared = spark.sparkContext.broadcast(plan)
    numbered = written(spark.createDataFrame([(r.source, q) for q, r in enumerate(queues)], "name string, queue int"), "queues")

    buckets = min(max(1 << (plan.total // BUCKET_IDS).bit_length(), MIN_BUCKETS), MAX_BUCKETS)
    dealt = tokens.join(numbered, F.col("source").eqNullSafe(F.col("name"))).select(
        F.pmod(F.xxhash64("doc_id", "n", F.crc32("ids")), F.lit(buckets)).cast("int").alias("bucket"), "queue", "doc_id", "n", "ids"
    )
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a number a bucket
    bases = dealt.groupBy("queue", "bucket").agg(F.sum("n").alias("n")).select("queue", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = (
        dealt.join(written(bases, "bases"), ["bucket", "queue"])
        .select("bucket", "queue", "base", "doc_id", "ids")
        .repartition("bucket").sortWithinPartitions("bucket", "queue", "doc_id", F.crc32("ids"))
    )
    return placed.mapInArrow(_pieces(shared, kind), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
