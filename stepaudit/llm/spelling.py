"""Spelling variants grouped by anagram hashing.

A word's anagram key is the sum of a power of its letters, so that all orders of the same letters
share it. Two words one edit apart have keys that differ by a letter's value (one letter added or
removed) or by the exchange of two letters' values. Both cases meet at a common key: every word is
filed under its own key and under its key less each of its distinct letters. A removal meets in
(own key, key less a letter), an exchange in (key less one letter, key less another). The letters'
order is verified on the words that meet.

No pairs are written: a task holds whole keys, looks at their words in blocks, and gives each
word's number of links and its best link. Keys that no second word has go by a pre-aggregated
count. Keys with more than ``HOT`` entries (very many words of the same letters) are dealt again by
the word less the letter at each of its places, which all words one edit apart share; such a group is
bounded by the alphabet and the word's length. Counts of words are merged in the tasks before they
are shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepaudit.llm.arrow import flat
from stepaudit.scratch import remove, written

RUN = "[a-zÀ-ÿ]+"
POWER = 5
#: Words that a task counts before it passes the counts on, entries of a key that one task looks through,
#: pairs and letters looked at in one go, and entries in a bucket of keys.
HELD, HOT, PAIRS, CELLS, BUCKET = 200_000, 1024, 1 << 18, 1 << 22, 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENTRIES = "key long, letter int, word string, n long"
_LINKS = "word string, n_near long, form_n long, form string"


def _counts(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(RUN).findall, {}

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                runs: dict[str, int] = {}
                for r in find(text.encode().translate(_LOWER).decode()):
                    runs[r] = runs.get(r, 0) + 1
                start = zlib.crc32(f"{name}:".encode())
                for r, n in runs.items():
                    h = zlib.crc32(r.encode(), start) if every else 1
                    if every and h % every == 0:
                        r = r[: h % len(r)] + r[h % len(r) + 1 :]
                    if len(r) >= least:
                        held[r] = held.get(r, 0) + n
                if len(held) > HELD:
                    yield given()
        yield given()

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, damage_every: int = 0) -> DataFrame:
    """``word, n`` of the words of all texts: runs of letters, only A-Z lower-cased.

    With ``damage_every`` > 0, a run whose crc32 of ``<id>:<run>`` it divides loses one letter, for
    tests of how errors are found. A null id counts as an empty name there.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    part = rows.mapInArrow(_counts(least_length, damage_every), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, letters, rows = [], [], []
        for i, word in enumerate(batch["word"].to_pylist()):
            own = sum(ord(c) ** POWER for c in word)
            keys.append(own)
            letters.append(-1)
            less = sorted({ord(c) for c in word})
            keys += [own - c**POWER for c in less]
            letters += less
            rows += [i] * (len(less) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(letters, pa.int32()), *(batch[c].take(pa.array(rows, pa.int32())) for c in ("word", "n"))], names=["key", "letter", "word", "n"])


def _one_edit(data: np.ndarray, begin: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the only edit between words a and b (b the longer, if one is), or -1. A letter is a byte."""
    out = np.full(len(a), -1, np.int64)
    width = int(size[np.concatenate([a, b])].max(initial=1))
    step = max(1, CELLS // width)
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        least = np.minimum(size[x], size[y])
        k = np.arange(int(least.max(initial=0)))
        inside = k < least[:, None]
        last = len(data) - 1
        head = (data[np.minimum(begin[x][:, None] + k, last)] == data[np.minimum(begin[y][:, None] + k, last)]) & inside
        tail = (data[np.maximum((begin[x] + size[x])[:, None] - 1 - k, 0)] == data[np.maximum((begin[y] + size[y])[:, None] - 1 - k, 0)]) & inside
        end = np.zeros((len(x), 1), bool)
        p, s = (np.argmin(np.hstack([m, end]), axis=1) for m in (head, tail))
        longer = size[y] - size[x]
        near = ((longer == 1) & (p + s >= size[x])) | ((longer == 0) & (p + s == size[x] - 1))
        out[i : i + step] = np.where(near, p, -1)
    return out


def _links(table: pa.Table) -> pa.Table:
    """Each word's links in a bucket of keys: their number, and the best one's count and word."""
    group = table["key"].to_numpy()
    exact = "rest" in table.column_names
    order = np.argsort(group, kind="stable")
    table, group = table.take(pa.array(order)), group[order]
    letter, n = table["letter"].to_numpy(), table["n"].to_numpy()
    words = table["word"].to_pylist()
    data, ends = flat(pa.array([w.encode("latin-1") for w in words], pa.binary()))
    rest = table["rest"].to_pylist() if exact else None
    begin, size = ends[:-1], np.diff(ends)
    stop = np.searchsorted(group, group, "right")
    more = stop - np.arange(len(group)) - 1  # rows after this one in its group
    total = np.concatenate([[0], np.cumsum(more)])
    left, right = [], []
    i = 0
    while i < len(group):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(i, j), more[i:j])
        b = a + 1 + np.arange(len(a)) - (total[a] - total[i])
        # The shorter word is filed under its own key; exchanges meet under keys less unlike letters.
        swap = (letter[a] >= 0) & (letter[b] < 0)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        may = np.where(letter[a] < 0, (letter[b] >= 0) & (size[b] == size[a] + 1), (size[a] == size[b]) & (letter[a] != letter[b]))
        a, b = a[may], b[may]
        p = _one_edit(data, begin, size, a, b)
        fine = p >= 0
        a, b, p = a[fine], b[fine], p[fine]
        # Each pair counts in one key only: that of the letters that differ.
        gone, kept = data[np.minimum(begin[b] + p, len(data) - 1)], data[np.minimum(begin[a] + p, len(data) - 1)]
        fine = (gone == letter[b]) & ((letter[a] < 0) | (kept == letter[a]))
        a, b, p = a[fine], b[fine], p[fine]
        if exact:
            fine = np.array([words[y][:q] + words[y][q + 1 :] == rest[y] == rest[x] for x, y, q in zip(a, b, p, strict=True)], bool)
            a, b = a[fine], b[fine]
        left += [a, b]
        right += [b, a]
        i = j
    src, dst = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    if not len(src):
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
    _, code = np.unique(np.array(words, dtype=object), return_inverse=True)  # in code-point order
    code = code.ravel()
    at = np.lexsort((code[dst], -n[dst], code[src]))
    src, dst = src[at], dst[at]
    first = np.flatnonzero(np.concatenate([[True], code[src][1:] != code[src][:-1]]))
    many = np.diff(np.append(first, len(src)))
    return pa.table({"word": pa.array([words[k] for k in src[first]]), "n_near": pa.array(many, pa.int64()), "form_n": pa.array(n[dst[first]], pa.int64()), "form": pa.array([words[k] for k in dst[first]])})


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``word, n_near, form_n, form`` of every word with a word one edit away: their number and the most frequent of them.

    ``words`` has distinct ``word`` (code points to U+00FF) and ``n``. Ties go to the smaller word.
    """
    entries = written(words.mapInArrow(_entries, _ENTRIES), "entries")
    counts = written(entries.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(F.col("letter") >= 0).alias("less")).where("rows > 1 AND less > 0"), "keys")
    size = counts.agg(F.sum("rows")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // BUCKET)))).alias("bucket")
    few = entries.join(counts.where(F.col("rows") <= hot).select("key"), "key", "left_semi")
    links = few.groupBy(bucket).applyInArrow(_links, _LINKS)
    many = entries.join(counts.where(F.col("rows") > hot).select("key"), "key", "left_semi")
    letter = F.char(F.col("letter"))
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda p: F.substring("word", p, F.lit(1)) == letter)
    less = F.transform(places, lambda p: F.concat(F.substring("word", F.lit(1), p - 1), F.substr("word", p + 1)))
    rests = F.when(F.col("letter") < 0, F.array("word")).otherwise(F.array_distinct(less))
    finer = many.withColumn("rest", F.explode(rests)).withColumn("key", F.xxhash64("key", "rest"))
    links = links.unionByName(finer.groupBy(bucket).applyInArrow(_links, _LINKS))
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    made = written(links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form"), "near")
    remove(entries, counts)
    return made


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form: the last word that forms lead to, by doubled steps."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        remove(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(words: DataFrame, factor: int = 10, hot: int = HOT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` (``word, n``; distinct words).

    A word's form is its most frequent near word (one letter added, removed or exchanged; ties to
    the smaller word), if that is at least ``factor`` times as frequent, else null with a null
    form_n; n_near counts all near words. Forms lead to ever more frequent words, so a root exists.
    Defined cases: no rows in, no rows out; words of no letters have no near words.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, hot)
    known = words.join(near, "word", "left")
    form = F.col("form_n") >= F.lit(factor) * F.col("n")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("form")).alias("form"), F.when(form, F.col("form_n")).alias("form_n")), "forms")
    roots = _roots(known.where("form IS NOT NULL"))
    remove(words, near)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage_every: int = 0) -> DataFrame:
    """:func:`group_variants` of the words of all texts.

    Defined cases: null texts have no words; a null id counts as an empty name; repeated rows count
    again; texts and words of any length are whole; no rows in, no rows out; other columns are ignored.
    """
    return group_variants(count_words(docs, id_col, text_col, damage_every=damage_every))
