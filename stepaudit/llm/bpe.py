"""Byte-level BPE encoding and decoding by Spark higher-order functions.

Each task sends its distinct words once, in groups of documents, as byte strings; Spark's
``aggregate`` folds the ranked merges over the bytes of every such word, with the ranks as a
literal table by pairs of ids, and joins the folded ids' binary pieces from a literal list. The
documents then look their words' ids and bytes up. Nothing is shuffled, and no table of words is
gathered: a task holds the words it has met, up to a bound after which it starts anew. The words come
with the ranks of their bytes' pairs, from a table of all 65,536, so that the fold begins at the first merge.

A fold costs the square of a word's length, so a word of over ``FOLD_BYTES`` bytes (one unbroken
run of that many letters, say) is merged by the worker with a heap instead; figures in the README.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepaudit.llm.pretokens import Splitter

FOLD_BYTES = 4096
#: Distinct words that a task holds before it starts anew; three input splits of 16 MB have about 750,000.
HELD_WORDS = 800_000
#: Input splits that :func:`together` puts in a task, while two tasks are left for every core.
SPLITS = 3
#: Characters of text that go to the fold as one row.
GROUP_CHARS = 500_000
#: Above every rank. A slot without a pair names this as its right id.
_NONE, _EMPTY = 0xFFFF, 0xFFFF_FFFF
#: Marks a merged piece until it is removed.
_GONE = -1


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte string from a file of base64 and rank; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap of pairs: lowest rank first, then leftmost."""
    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], alive[j], nxt[i] = stop, False, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for a in (prev[i], i):
            if a >= 0 and (b := nxt[a]) < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


@cache
def _byte_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the bytes, and ranks of pairs of bytes (_NONE without one) by first * 256 + second."""
    ranks = load_ranks(path)
    return np.array([ranks[bytes([b])] for b in range(256)], np.int64), np.array([ranks.get(bytes([a, b]), _NONE) for a in range(256) for b in range(256)], np.int64)


def numbered(words: list[bytes], path: str) -> pa.ListArray:
    """The words as the lists of pieces with which :func:`fold_merges` begins: one for each byte, with the rank of its pair."""
    ids, pairs = _byte_tables(path)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    rank = np.append(pairs[data[:-1] * 256 + data[1:]], _NONE)[: len(data)]
    rank[ends[1:][size > 0] - 1] = _NONE
    place = np.arange(len(data)) - np.repeat(ends[:-1], size)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rank << 46 | place << 16 | ids[data]))


@cache
def _pair_table(path: str) -> tuple[list[int], list[int]]:
    """Ranks by pairs of ids as a table without collisions: ``offset`` of each sum of two ids, and ``slots``.

    The slot at offset[left + right] + right holds right * 65536 + rank. A sum and a right id make a
    pair, and no two sums share an offset, so a slot that names the right id is the pair's own. Each
    sum finds an offset where its slots are free, the fullest first.
    """
    ranks = load_ranks(path)
    top = max(ranks.values())
    if top >= _NONE:
        raise ValueError("ids must be below 65,535")
    sums: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            if (x := ranks.get(piece[:k])) is not None and (y := ranks.get(piece[k:])) is not None:
                sums.setdefault(x + y, {})[y] = rank
    spread = 2 * max(sum(map(len, sums.values())), top) + 2
    rng = np.random.default_rng(7)
    slots, taken = [_EMPTY] * (spread + top + 1), set()
    offset = [-1] * (2 * top + 1)
    for both, held in sorted(sums.items(), key=lambda kv: -len(kv[1])):
        at = int(rng.integers(spread))
        while at in taken or any(slots[at + y] != _EMPTY for y in held):
            at = int(rng.integers(spread))
        offset[both] = at
        taken.add(at)
        for y, rank in held.items():
            slots[at + y] = y * 65536 + rank
    free = (at for at in range(spread) if at not in taken)
    return [next(free) if at < 0 else at for at in offset], slots


class RankMap:
    """The ranks and the pieces as literals of a plan; :meth:`bound` lets one copy of each serve all uses."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        offset, slots = _pair_table(path)
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")

        def literal(values: list, kind: T.DataType) -> Column:
            return F.from_json(F.lit(json.dumps(values)), T.ArrayType(kind))

        self.slots, self.offset, self.pieces = literal(slots, T.LongType()), literal(offset, T.LongType()), literal(pieces, T.StringType())

    def bound(self, use) -> Column:
        """``use()`` while the tables are variables of the expression instead of literals."""
        own = self.slots, self.offset

        def with_offset(slots: Column, offset: Column) -> Column:
            self.slots, self.offset = slots, offset
            try:
                return use()
            finally:
                self.slots, self.offset = own

        return _with(own[0], lambda slots: _with(own[1], lambda offset: with_offset(slots, offset)))

    def rank(self, left: Column, right: Column) -> Column:
        """The rank of two ids side by side, _NONE without one or where the right id is null."""
        slot = self.slots[self.offset[left + right] + right]
        return F.least(F.lit(_NONE).cast("long"), slot.bitwiseXOR(F.shiftleft(right, 16)))  # the slot's own right id leaves the rank alone


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_merges(word: Column, ranks: RankMap) -> Column:
    """Ids of a word (an array as of :func:`numbered`), by folding the ranked merges over its pieces.

    A piece is one number: the rank of the pair that it begins, 16 bits; its place in the word, 30;
    its id, 16. So the least number is the lowest rank, and of equal ranks the leftmost, and as an
    id is a rank, it also names the merged piece.
    """
    low, none = (1 << 46) - 1, _NONE << 46
    place = low - 0xFFFF

    def piece_id(x: Column) -> Column:
        return x.bitwiseAND(0xFFFF)

    def join(s: Column, m: Column, i: Column) -> Column:
        """Pieces with the i-th (from 1), which is m, and the next merged."""
        made = F.shiftright(m, 46)

        def piece(x: Column, j: Column) -> Column:
            own = F.shiftleft(ranks.rank(made, piece_id(F.get(s, i + 1))), 46) + made + m.bitwiseAND(place)
            before = F.shiftleft(ranks.rank(piece_id(x), made), 46) + x.bitwiseAND(low)
            return F.when((j > i) | (j < i - 2), x).when(j == i, F.lit(_GONE)).when(j == i - 1, own).otherwise(before)

        return F.array_remove(F.transform(s, piece), F.lit(_GONE))

    def spot(s: Column, at: Column) -> Column:
        """The position of the piece at a place. array_position leaves its loop by an exception, which costs more."""
        return F.size(F.filter(s, lambda x: x.bitwiseAND(place) <= at))

    def step(s: Column, _: Column) -> Column:
        return _with(F.array_min(s), lambda m: F.when(m >= none, s).otherwise(_with(spot(s, m.bitwiseAND(place)), lambda i: join(s, m, i))))

    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(word), F.lit(2))), word, step)
    return F.transform(folded, lambda x: piece_id(x).cast("int"))


def decoded(ids: Column, ranks: RankMap) -> Column:
    """The binary pieces of ids, one after another."""
    return F.encode(F.array_join(F.transform(ids, lambda x: F.get(ranks.pieces, x)), ""), "ISO-8859-1")


class _Places(dict):
    """Numbers for words in the order in which they are first met; ``new`` are those not sent yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _group(pattern: str, path: str):
    """Rows of whole documents: ids, their words as places in the task's word list, and the new words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place = Splitter(pattern), _Places()
        ids: list = []
        idx: list[bytes] = []
        restart, chars = True, 0

        def row() -> pa.RecordBatch:
            new = [w.encode() for w in place.new]
            short = [w if len(w) <= FOLD_BYTES else b"" for w in new]
            long = [b"" if len(w) <= FOLD_BYTES else w for w in new]
            words = numbered(short, path)
            words = pa.ListArray.from_arrays(pa.array([0, len(short)], pa.int32()), words)
            values = [pa.array([v], k) for v, k in ((restart, pa.bool_()), (ids, pa.list_(pa.int64())), (idx, pa.list_(pa.binary())), (long if any(long) else [], pa.list_(pa.binary())))]
            return pa.RecordBatch.from_arrays([*values, words], names=["restart", "ids", "idx", "long", "short"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = text.as_py() or ""
                words = split(whole)
                ids.append(key)
                idx.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)).tobytes())
                chars += len(whole)
                if chars >= GROUP_CHARS or len(place) >= HELD_WORDS:
                    yield row()
                    restart = len(place) >= HELD_WORDS
                    if restart:
                        place.clear()
                    place.new, ids, idx, chars = [], [], [], 0
        if ids:
            yield row()

    return run


def _assemble(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        pieces = dict(zip(ranks.values(), ranks.keys(), strict=True))
        digits = {r: str(r) for r in pieces}
        text: list[str] = []  # of each word: its ids joined by commas,
        counts = np.zeros(0, np.int64)  # how many,
        back: list[bytes] = []  # and the bytes that they decode to
        for batch in batches:
            for r in range(len(batch)):
                restart, keys, idx, long = (c[r].as_py() for c in batch.columns[:4])
                if restart:
                    text, counts, back = [], np.zeros(0, np.int64), []
                words = batch.column(4)[r].values
                made, ends = list(map(digits.__getitem__, words.flatten().to_pylist())), (words.offsets.to_numpy() - words.offsets[0].as_py()).tolist()
                first = len(text)
                text += [",".join(made[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                counts = np.concatenate([counts, np.diff(ends)])
                back += batch.column(5)[r].as_py()
                for k in (k for k, w in enumerate(long) if w):
                    own = merge_long(long[k], ranks)
                    text[first + k], counts[first + k], back[first + k] = ",".join(map(digits.__getitem__, own)), len(own), b"".join(map(pieces.__getitem__, own))
                n, s1, s2, kept = [], [], [], []
                for spots in idx:
                    w = np.frombuffer(spots, np.int32)
                    spot = w.tolist()
                    n.append(int(counts[w].sum()) if len(w) else 0)
                    joined = ",".join(map(text.__getitem__, spot))
                    s1.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded = b"".join(map(back.__getitem__, spot))
                    s2.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        kept.append(([int(x) for x in joined.split(",")] if joined else [], decoded))
                out = {"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(s1, pa.string()), "decoded_sha256": pa.array(s2, pa.string())}
                if with_ids:
                    out |= {"ids": pa.array([x for x, _ in kept], pa.list_(pa.int32())), "decoded": pa.array([x for _, x in kept], pa.binary())}
                yield pa.RecordBatch.from_pydict(out)

    return run


def together(docs: DataFrame) -> DataFrame:
    """Rows read from files in fewer tasks, as a word that several splits hold is folded once a task."""
    parts, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-parts // SPLITS), 2 * cores)
    return docs.coalesce(tasks) if tasks < parts else docs


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids, decoded`` of every row.

    Defined cases: a null text is an empty one, which has no ids (the digests are those of no
    bytes); rows that repeat an id each give a row, and a null id stays null; other columns are
    ignored. Special-token strings are ordinary text.
    """
    table = RankMap(ranks_path)
    grouped = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _group(pattern, ranks_path), "restart boolean, ids array<long>, idx array<binary>, long array<binary>, short array<array<long>>"
    )
    folded = grouped.select("restart", "ids", "idx", "long", table.bound(lambda: F.transform("short", lambda w: fold_merges(w, table))).alias("folded"))
    folded = folded.select("*", F.transform("folded", lambda w: decoded(w, table)).alias("bytes"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return folded.mapInArrow(_assemble(ranks_path, with_ids), schema)
