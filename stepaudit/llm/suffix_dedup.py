"""Removal of repeated byte strings by longest-previous-factor arrays over suffix arrays of content-defined pieces.

A byte goes if a string of ``length`` (100) bytes that covers it also starts earlier: in a smaller
document, or earlier in the same one. In suffix order, the suffix with the longest match among all
that start earlier is the previous or the next one of a smaller position; so a start is a repeat if
its longest previous factor, the longer of the two matches, is at least ``length``.

No task sorts the suffixes of the whole corpus. A start's first 100 bytes hold 61 grams of 40
bytes; the one of the least hash (the leftmost, if equal) is its anchor. Equal strings have equal
anchors, so starts are dealt out by the hash of the anchor: a piece is a run of starts with one
anchor, with the text that they reach over.

1. Keys of pieces that come only once in the corpus match nothing and go. Every batch of documents
   sends a key once, however often it holds it.
2. The other pieces are cut from the texts. Equal pieces are neighbours in suffix order; a batch
   keeps the first of them and marks the rest as repeats before anything is shuffled.
3. Pieces are dealt by key to buckets of bounded size; each builds the suffix array of its pieces
   and the longest previous factors of their starts. A key with more than ``HOT`` pieces (a common
   line between ever other texts) is dealt again by eight starts' common bytes, and then by single
   starts, whose least position is a pre-aggregated minimum.
4. The covered stretches of a document are merged and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepaudit.llm.arrow import binaries, flat, pieces
from stepaudit.llm.minhash import _BYTE, _mix, _powers
from stepaudit.scratch import release, remove, written

LENGTH, GRAM = 100, 40
#: Bytes of a text that are hashed at once, and bits of a place in them (kept in a gram's low bits).
PART, PLACE_BITS = 1 << 19, 20
#: Bytes of pieces that a bucket holds, and pieces of one key that go to one bucket, at most.
BUCKET_BYTES, HOT = 4 << 20, 1 << 15
#: Low bits of a key that its count leaves out (two keys that then look alike are only cut in vain).
KEY_SHIFT = 16
#: Starts that a piece of a hot key is cut into.
CHUNK = 8

_RUNS = "id long, tie long, start long, n int"
_PIECES = f"key long, {_RUNS}, at int, piece binary"


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def cut_points(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of some texts (at most 2**PLACE_BITS bytes): key, text, first start, number of starts, anchor's distance."""
    raw = data[offsets[0] : offsets[-1]]
    begin = offsets - offsets[0]
    if len(raw) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    power, inverse = _powers(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)])
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[: len(raw) - gram + 1])
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = _slide((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    new = np.zeros(len(least) + 1, bool)
    new[1:-1] = least[1:] != least[:-1]
    text = np.flatnonzero(np.diff(begin) >= length)
    ends = begin[text + 1] - length + 1
    new[begin[text]] = new[ends] = True
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(least)))
    owner = np.searchsorted(begin, at, "right") - 1
    ok = (at + length <= begin[owner + 1]) & (n > 0)
    at, n, owner = at[ok], n[ok], owner[ok]
    anchor = (least[at] & mask).astype(np.int64)
    return grams[anchor].view(np.int64), owner, at - begin[owner], n, anchor - at


def _parts(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of any texts; longer texts are read in parts that overlap by ``length - 1`` bytes."""
    for i, j in pieces(offsets, PART // 2):
        if j > i + 1 or offsets[j] - offsets[i] <= PART:
            key, text, start, n, at = cut_points(data, offsets[i : j + 1], length)
            yield key, text + i, start, n, at
            continue
        for a in range(int(offsets[i]), max(int(offsets[j]) - length + 1, int(offsets[i]) + 1), PART):
            key, text, start, n, at = cut_points(data, np.array([a, min(a + PART + length - 1, offsets[j])]), length)
            yield key, text + i, start + a - offsets[i], n, at


def longest_previous(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each of ``starts`` (ascending), the longest match, up to ``depth``, with one before it.

    ``text`` reaches ``depth`` bytes past every start. Suffixes are sorted by their first ``depth``
    bytes; a start's match is the longer of those with its previous and its next smaller position.
    """
    n = len(starts)
    if n < 2:
        return np.zeros(n, np.int64)
    at = [*range(0, depth - 7, 8)]
    if depth % 8:
        at.append(max(depth - 8, 0))
    big = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8)
    words = [np.ascontiguousarray(big[starts + a]).view(">u8").ravel().astype(np.uint64) for a in at]
    order = np.lexsort(words[::-1])  # stable: equal suffixes stay in the order of their positions
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    best = np.zeros(n, np.int64)
    for side in (-1, 1):
        # Places of suffixes before (after) in suffix order; n stands for none.
        to = np.append(np.arange(n) + side, n)
        to[(to < 0) | (to > n)] = n
        position = np.append(order, -1)
        while True:
            late = np.flatnonzero(position[to[:n]] > position[:n])
            if not len(late):
                break
            to[late] = to[to[late]]
        other = np.append(order, 0)[to[:n]][rank]  # the start that stands there
        found = to[:n][rank] < n
        same, matched = found.copy(), np.zeros(n, np.int64)
        for a, w in zip(at, words, strict=True):
            differ = w ^ w[other]
            equal = same & (differ == 0)
            matched[equal] = a + 8
            odd = np.flatnonzero(same & (differ != 0))
            zero = np.zeros(len(odd), np.int64)
            for k in range(1, 8):
                zero += differ[odd] >> np.uint64(64 - 8 * k) == 0
            matched[odd] = a + zero
            same = equal
        best = np.maximum(best, matched)
    return np.minimum(best, depth)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them) of each row, one after another."""
    begin = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(begin - first, n)


def _firsts(texts: pa.Array, place: np.ndarray) -> np.ndarray:
    """The least place of each text's equals."""
    code = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    least = np.full(int(code.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, code, place)
    return least[code]


def _places(ids: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rank of (id, tie, start), equal for equal ones."""
    order = np.lexsort((starts, ties, ids))
    same = np.ones(len(order), bool)
    same[:1] = False
    for x in (ids, ties, starts):
        same[1:] &= x[order][1:] == x[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(~same)
    return rank


def _keys(length: int):
    """A row a piece: key, document and 4 * start + 1 for a key's only piece in the batch.

    Of several, the first has 2 added in place of 1; the others, which are known to be wanted, have 0
    and are dealt by keys of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch["text"])
            found = [(key, text, start) for key, text, start, _, _ in _parts(data, offsets, length)]
            if not sum(len(f[0]) for f in found):
                continue
            key, text, start = (np.concatenate(x) for x in zip(*found, strict=True))
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            seen = np.zeros(len(key), np.int64)
            seen[first] = np.minimum(times, 2)
            dealt = np.where(seen > 0, key, _mix(key.view(np.uint64) + np.arange(len(key), dtype=np.uint64)).view(np.int64))
            doc = batch["doc"].to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(dealt >> KEY_SHIFT), pa.array(doc), pa.array(start * 4 + seen)], names=["dealt", "doc", "spot"])

    return run


def _cut(length: int):
    """Wanted pieces, the first of equal ones in a batch; the others come out as repeats (no key, no text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch["text"])
            spots = batch["starts"]
            rows = np.repeat(np.arange(len(batch)), spots.value_lengths().to_numpy(zero_copy_only=False))
            wanted = rows << 40 | spots.flatten().to_numpy(zero_copy_only=False)
            ids, ties = (batch[c].to_numpy(zero_copy_only=False) for c in ("id", "tie"))
            for key, text, start, n, at in _parts(data, offsets, length):
                take = np.flatnonzero(np.isin(text << 40 | start, wanted))
                key, text, start, n, at = (x[take] for x in (key, text, start, n, at))
                for i, j in pieces(np.concatenate([[0], np.cumsum(n + length - 1)]), BUCKET_BYTES):
                    t = text[i:j]
                    yield first_of_equals(data, offsets[t], key[i:j], ids[t], ties[t], start[i:j], n[i:j], at[i:j])

    def first_of_equals(data, base, key, ids, ties, start, n, at) -> pa.RecordBatch:
        size = n + length - 1
        texts = binaries(data[_spread(base + start, size)], np.concatenate([[0], np.cumsum(size)]))
        place = _places(ids, ties, start)
        first = _firsts(texts, place)
        keep = np.flatnonzero(first == place)
        keep = keep[np.unique(place[keep], return_index=True)[1]]
        late = np.flatnonzero(place > first)
        take = np.concatenate([keep, late])
        none = np.arange(len(take)) >= len(keep)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key[take], mask=none), pa.array(ids[take]), pa.array(ties[take]), pa.array(start[take]), pa.array(n[take], pa.int32()),
                pa.array(at[take], pa.int32()), pa.concat_arrays([texts.take(pa.array(keep)), pa.nulls(len(late), pa.binary())]),
            ],
            names=["key", "id", "tie", "start", "n", "at", "piece"],
        )

    return run


def _resolve(length: int):
    """The repeated starts of a bucket, as runs."""

    def run(table: pa.Table) -> pa.Table:
        key, ids, ties, start = (table[c].to_numpy() for c in ("key", "id", "tie", "start"))
        n = table["n"].to_numpy().astype(np.int64)
        texts = table["piece"].combine_chunks()
        place = _places(ids, ties, start)
        first = _firsts(texts, place)
        late = np.flatnonzero(place > first)
        # One of equal pieces, in the order of their places; keys with two or more of them need the suffix order.
        keep = np.flatnonzero(first == place)
        keep = keep[np.unique(place[keep], return_index=True)[1]]
        _, back, times = np.unique(key[keep], return_inverse=True, return_counts=True)
        keep = keep[times[back] > 1]
        out = [(ids[late], ties[late], start[late], n[late])]
        if len(keep):
            data, offsets = flat(texts.take(pa.array(keep)))
            count = n[keep]
            repeat = longest_previous(data, _spread(offsets[:-1], count), length) >= length
            row = np.repeat(np.arange(len(keep)), count)
            spot = _spread(start[keep], count)
            edge = np.ones(len(repeat), bool)
            edge[1:] = (repeat[1:] != repeat[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(edge)
            size = np.diff(np.append(begin, len(repeat)))
            begin, size = begin[repeat[begin]], size[repeat[begin]]
            at = keep[row[begin]]
            out.append((ids[at], ties[at], spot[begin], size))
        made = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table({"id": made[0], "tie": made[1], "start": made[2], "n": pa.array(made[3], pa.int32())})

    return run


def _remove(length: int):
    """Digests of texts without their covered stretches."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch["text"])
            runs = batch["runs"]
            sizes = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            start, n = (runs.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            removed, spans, kept = [], [], []
            for d in range(len(batch)):
                text = data[offsets[d] : offsets[d + 1]]
                change = np.zeros(len(text) + 1, np.int32)
                mine = slice(ends[d], ends[d + 1])
                np.add.at(change, start[mine], 1)
                np.add.at(change, start[mine] + n[mine] + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum()))
                kept.append(text[~gone].tobytes())
            names = [c for c in batch.schema.names if c not in ("text", "runs")]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in names]
                + [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _finer(hot: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces of at most ``width`` starts, keyed by the bytes that all strings of the same eight starts share."""
    if width == 1:
        made = hot.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        low, n = F.col("i"), F.lit(1)
        core = F.substring("piece", F.col("i") + 1, F.lit(length))
    else:
        last = F.floor(F.col("at") / width).cast("int")
        least = F.floor(F.greatest(F.lit(0), F.col("at") - F.col("n") + 1) / width).cast("int")
        made = hot.withColumn("c", F.explode(F.sequence(least, last)))
        top = F.col("at") - F.col("c") * width
        low = F.greatest(F.lit(0), top - (width - 1))
        n = F.least(F.col("n") - 1, top) - low + 1
        core = F.substring("piece", top + 1, F.lit(length - width + 1))
    made = made.select(core.alias("core"), "id", "tie", (F.col("start") + low).alias("start"), n.cast("int").alias("n"), (F.col("at") - low).alias("at"), F.substring("piece", low + 1, n + (length - 1)).alias("piece"))
    return made.where("n > 0").select(F.xxhash64(F.lit(width), "core").alias("key"), "id", "tie", "start", "n", "at", "piece")


def _keys_where(table: DataFrame, test: Column) -> DataFrame:
    """Keys whose number of rows, a pre-aggregated sum, passes a test. Joins with them may be split, or broadcast if they are small."""
    return written(table.groupBy("key").agg(F.count("*").alias("rows")).where(test).select("key"), "keys")


def repeated_runs(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``id, tie, start, n``: runs of starts whose ``length`` bytes also start earlier; ``docs`` has id, tie, text."""
    spark = docs.sparkSession
    docs = docs.withColumn("doc", F.xxhash64("id", "tie"))
    seen = F.sum(F.col("spot").bitwiseAND(F.lit(3))).over(Window.partitionBy("dealt"))
    spots = docs.select("doc", "text").mapInArrow(_keys(length), "dealt long, doc long, spot long").withColumn("seen", seen)
    starts = spots.where("spot % 4 = 0 OR seen > 1").groupBy("doc").agg(F.collect_set(F.shiftright("spot", 2)).alias("starts"))
    wanted = written(starts, "wanted")
    release(spark)
    found = written(docs.join(wanted, "doc").select("id", "tie", "text", "starts").mapInArrow(_cut(length), _PIECES), "pieces")
    remove(wanted)
    release(spark)
    runs = [found.where("key IS NULL").select("id", "tie", "start", "n")]
    kept, spare = found.where("key IS NOT NULL"), [found]
    for width in (CHUNK, 1):
        many = _keys_where(kept, F.col("rows") > hot)
        spare.append(many)
        runs.append(_solve(kept.join(many, "key", "left_anti"), length))
        if many.isEmpty():
            break
        finer = written(_finer(kept.join(many, "key", "left_semi"), width, length), "finer")
        again = _keys_where(finer, F.col("rows") > 1)
        spare += [finer, again]
        kept = finer.join(again, "key", "left_semi")
    else:
        # Single starts: the least position of equal ones is a pre-aggregated minimum.
        place = F.struct("id", "tie", "start")
        first = kept.groupBy("piece").agg(F.min(place).alias("first"))
        runs.append(kept.join(first, "piece").where(place > F.col("first")).select("id", "tie", "start", "n"))
    made = runs[0]
    for r in runs[1:]:
        made = made.unionByName(r)
    made = written(made, "runs")
    remove(*spare)
    release(spark)
    return made


def _solve(table: DataFrame, length: int) -> DataFrame:
    size = table.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    return table.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).applyInArrow(_resolve(length), _RUNS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row: its UTF-8 bytes without the repeats.

    Defined cases: a null text is an empty one; texts under ``length`` bytes are whole; a null id
    comes before all others (as the least long); rows equal in id and text count as one document and
    get the same result; rows of one id with unlike texts are documents of their own, in the order
    of their hashes; no rows in, no rows out; other columns are ignored. ``kept`` is binary, as a
    cut may fall inside a character.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    runs = repeated_runs(docs.select("id", "tie", "text"), length)
    spans = runs.groupBy("id", "tie").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    whole = docs.join(spans, ["id", "tie"], "left").select("doc_id", "text", "runs")
    out = whole.mapInArrow(_remove(length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("doc_id", id_col)
