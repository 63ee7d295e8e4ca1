"""Spelling variants, repeated byte strings and hard negatives beside brute force, and on odd rows."""

import functools
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepaudit.llm import hard_negatives as hn
from stepaudit.llm import queries, spelling, suffix_dedup


def _variants(texts, every=0):
    counts = Counter()
    for k, t in texts:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if k is None else k}:{r}".encode())
            if every and h % every == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                counts[r] += 1
    n = {w: c for w, c in counts.items() if c > 1}
    holes, shorter = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            shorter[w[:i] + w[i + 1 :]].add(w)
    out = {}
    for w in n:
        near = set().union(*(holes[w[:i], w[i + 1 :]] for i in range(len(w))), shorter[w], ({w[:i] + w[i + 1 :] for i in range(len(w))} & n.keys())) - {w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, len(near)]
    made = {}
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        made[w] = (form, root, n[w], near, n[form] if form else None)
    return made


def _said(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_query(spark, data):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_spelling(spark, data)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = _variants(texts, 31)
    assert _said(got) == want and any(v[0] for v in want.values())


WORDS = ["letters" * 1, "lettres", "leters", "lettters", "settler", "tteslre", "étranger", "étrangee", "etranger", "abcdefgh", "bacdefgh", "abcdefg"]


@pytest.mark.parametrize("hot", [1, 3, spelling.HOT])
def test_spelling_cases(spark, hot):
    """Orders of the same letters, repeated letters, ties, chains of forms and very long words, with and without hot keys."""
    long = "ab" * 5000
    texts = [(1, " ".join(["lettering"] * 300 + ["letering"] * 30 + ["leteringx"] * 3 + ["letterinz"] * 30)), (1, None), (None, "Letters, LETTERS é"), (2, ""), (3, f"{long} {long} {long}c {long}c")]
    texts += [(10 + k, " ".join([w, w]) + " ") for k, w in enumerate(WORDS)] * 2
    texts += [(50, " ".join(p + p[::-1] + "zz" for p in ("abcd", "bacd", "abdc", "acbd", "dbca") for _ in range(2)))]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, key string, n long")
    words = spelling.count_words(docs)
    want = _variants(texts)
    assert _said(spelling.group_variants(words, hot=hot)) == want
    assert want["leteringx"][:2] == ("letering", "lettering") and want["étranger"][3] == 2
    assert spelling.variants(docs.limit(0)).collect() == []


def _cut(docs, length=100):
    """``doc, bytes, removed, spans, digest`` by all strings in order of documents."""
    seen, out = set(), {}
    for k, t in sorted(docs, key=lambda x: x[0]):
        raw = np.frombuffer(t.encode(), np.uint8)
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length].tobytes()
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        out[k] = (len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("depth", [3, 8, 13, 100])
def test_longest_previous(depth):
    rng = np.random.default_rng(depth)
    for _ in range(10):
        text = rng.integers(97, 100, 150 + depth).astype(np.uint8)
        starts = np.sort(rng.choice(150, 60, replace=False))
        got = suffix_dedup.longest_previous(text, starts, depth)
        for i, a in enumerate(starts):
            want = max((next((k for k in range(depth) if text[a + k] != text[b + k]), depth) for b in starts[:i]), default=0)
            assert got[i] == want


def _texts():
    rng = np.random.default_rng(2)
    word = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(2, 9, 400)]
    prose = [" ".join(rng.choice(word, 60)) for _ in range(12)]
    line = "a line that stands in very many documents, with the same words in the same order, and that is longer than a hundred bytes"
    texts = [(k, prose[k]) for k in range(12)]
    texts += [(20, prose[0]), (21, prose[1][:150] + "!" + prose[1][150:]), (22, prose[2][50:] + prose[2]), (23, "a" * 700), (24, "ab" * 300), (25, "éü漢字🙂" * 40 + prose[3]), (26, prose[4] + prose[4])]
    texts += [(100 + k, f"{rng.choice(word)} {k} {line} {rng.choice(word)} {k * 7}") for k in range(60)]
    texts += [(200 + k, f"{' '.join(rng.choice(word, 8))} {line[:95]} {' '.join(rng.choice(word, 8))}") for k in range(60)]
    return texts + [(300, ""), (301, "x" * 99), (302, "x" * 100), (303, "x" * 101)]


@pytest.mark.parametrize("hot, part", [(suffix_dedup.HOT, suffix_dedup.PART), (3, 300), (20, 1000)])
def test_repeats(spark, monkeypatch, hot, part):
    """Copies, shifted copies, runs, a common line (hot keys too) and texts read in parts."""
    texts = _texts()
    runs = suffix_dedup.repeated_runs
    monkeypatch.setattr(suffix_dedup, "repeated_runs", functools.partial(runs, hot=hot))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    if part != suffix_dedup.PART:
        data = [t.encode() for _, t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        flat = np.frombuffer(b"".join(data), np.uint8)
        monkeypatch.setattr(suffix_dedup, "PART", part)
        found = [np.concatenate(x) for x in zip(*suffix_dedup._parts(flat, offsets, 100))]
        starts = sorted((int(t), int(s) + i) for t, s, n in zip(found[1], found[2], found[3]) for i in range(n))
        assert starts == [(t, i) for t, d in enumerate(data) for i in range(len(d) - 99)]  # every start in one piece
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == _cut(texts)


def test_repeats_odd_rows(spark):
    schema = "doc_id long, text string, id long, tie long, n int, runs string, key long, piece string, start long, spots string"
    prose = " ".join(f"word{k}" for k in range(40))
    rows = [(1, None), (2, ""), (None, prose), (None, prose), (5, prose), (5, prose), (5, prose + " more"), (7, "x")]
    df = spark.createDataFrame([(k, t, 1, 2, 3, "r", 4, "p", 5, "s") for k, t in rows], schema)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeats(df).collect())
    n = len(prose)
    # Equal rows are one document, so the null id's two keep their text; documents of id 5 come in the order of their hashes.
    assert got == [(-1, n, 0, prose), (-1, n, 0, prose), (1, 0, 0, ""), (2, 0, 0, ""), (5, n, n, ""), (5, n, n, ""), (5, n + 5, n, " more"), (7, 1, 0, "x")]
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def _mined(rows, k=5, negatives=3, low=50, high=95):
    rows = sorted({(i, y, tuple(int(np.floor(256 * float(x))) for x in v)) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, y, v in rows:
        if i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in rows if j != i))
        for s, j, _ in [x for x in scored if x[2] == y][:k]:
            band = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r + 1, b[1], -s, -b[0]) for r, b in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("pivots, group, block", [(hn.PIVOTS, hn.GROUP, hn.BLOCK), (7, 3, 50), (1, 1, 9), (30, 2, 1000)])
def test_hard_negatives(spark, monkeypatch, pivots, group, block):
    """Clusters, far and near vectors, ties, zero vectors, equal rows and labels with few rows, in any partition of the space."""
    for name, value in (("PIVOTS", pivots), ("GROUP", group), ("BLOCK", block)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 5)) * [[3], [1], [1], [0.3], [2], [1]]
    rows = [(k, int(k % 4), [float(x) for x in centres[k % 6] + rng.normal(size=5) * 0.2]) for k in range(600)]
    rows += [(k, 1, [0.0] * 5) for k in (650, 651, 652)] + [(k, 9, [1.0] * 5) for k in (700, 701)] + [(750, 8, [1.0] * 5)] + rows[:30] + [(k, 2, rows[0][2]) for k in range(800, 812)]
    df = spark.createDataFrame([(*r, k % 3) for k, r in enumerate(rows)], "vec_id long, label int, embedding array<double>, key long").repartition(5)
    got = hn.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label"))
    want = _mined(rows)
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == want and len(want) > 100


def test_hard_negative_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.5]), (3, 2, [nan, 1.0]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [inf, 1.0]), (None, 2, [1.0, 1.0]), (7, 2, [None, 1.0]), (8, 2, []), (50, 3, [-1.0, -1.0])]
    schema = "vec_id long, label int, embedding array<double>, id long, v string, cell int, r double, grp long, score long"
    df = spark.createDataFrame([(*r, 1, "v", 2, 3.0, 4, 5) for r in rows], schema)
    got = [tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label")).collect()]
    assert got == [(0, 1, 1, 2, 196608, 131072)] == _mined(rows)
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0, F.col("label")).collect() == []
    assert hn.hard_negatives(df, F.lit(False), F.col("label")).collect() == []
    for bad in ([(0, 1, [1.0]), (1, 1, [1.0, 2.0])], [(0, 1, [1e9])]):
        with pytest.raises(ValueError):
            hn.hard_negatives(spark.createDataFrame(bad, "vec_id long, label int, embedding array<double>"), F.lit(True), F.col("label"))


def test_bounds_prune(spark):
    """Of clusters far apart, most candidates are replicated to few groups."""
    rng = np.random.default_rng(1)
    rows = [(k, k % 3, [float(x) for x in np.eye(8)[k % 8] * 20 + rng.normal(size=8) * 0.05]) for k in range(1600)]
    v = np.array([r[2] for r in rows])
    space = hn.Space([type("R", (), {"id": i, "label": y, "v": [int(np.floor(256 * x)) for x in w]}) for i, y, w in rows[:256]], ((np.floor(256 * v)) ** 2).sum(1).max())
    import pyarrow as pa

    q = np.floor(256 * v[:8]).astype(np.int64)
    batch = pa.RecordBatch.from_pydict({"grp": np.arange(8), "id": np.arange(8) + 10**6, "label": np.array([r[1] for r in rows[:8]]), "v": q.tolist()})
    rings = pa.Table.from_batches(list(hn._rings(space, 5, 0, 50, 95)([batch]))).to_pandas()
    far = space.distances(np.floor(256 * v).astype(np.int64), True)
    cell, r = far.argmin(1), far.min(1)
    kept = sum(((cell == x.cell) & (r >= x.least) & (r <= x.most)).sum() for x in rings.itertuples())
    assert kept < 0.4 * 8 * len(rows), kept




def test_column_names(spark, data):
    """Names with dots and quotes, those that stages use themselves, and repeated ones, in the operators and every stage."""
    import corpus_pipeline as c

    from stepaudit.llm import line_dedup, minhash

    names = ["a.b", "__ld_id", "__nd_id", "c0", "x`y", "n_removed", "__ld_new"]
    block = "one line of words\nanother line here\na third line there"
    rows = [(1, f"{block}\nfirst and more words", 5), (2, f"{block}\nsecond of its own kind", 5), (3, "some words that stand here only once", 5), (4, "some words that stand here only once", 5)]
    docs = spark.createDataFrame([(k, t, "en", None, n, *"abcdefg") for k, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    cut = line_dedup.dedup_lines(docs)
    assert cut.columns == [n for n in docs.columns if n != "n_removed"] + ["n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r["a.b"], r["__ld_id"]) for r in cut.collect()}[2] == ("second of its own kind", "a", "b")
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r["__nd_id"], r["x`y"]) for r in kept.collect()) == [(k, "c", "e") for k in (1, 2, 3)]
    plain = docs.drop("n_removed")
    for name, stage in c.STAGES[1:3]:
        got = stage(spark, plain, data)
        assert got.columns == plain.columns and got.count() == (4 if name == "line_dedup" else 3)


def test_top_k_in_step():
    """A block's queries read the lists in step: the best of each as by brute force, in a fraction of the time that one at a time takes."""
    import time

    import numpy as np
    import pyarrow as pa

    from stepaudit.llm import topk

    def table(ids, v, **more):
        flat = pa.array(v.ravel(), pa.int64())
        return pa.table({"id": pa.array(ids, pa.int64()), "v": pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), flat), **more})

    def brute(ids, v, own, q, k):
        s = [sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, x in zip(ids.tolist(), v.tolist(), strict=True) if i != o)[:k] for o, y in zip(own.tolist(), q.tolist(), strict=True)]
        return [(n, o, i, -score) for n, (o, best) in enumerate(zip(own.tolist(), s, strict=True)) for score, i in best]

    rng = np.random.default_rng(6)
    for n, m, dim, high, scale in ((300, 300, 1, 9, 1), (500, 280, 2, 1000, 1), (2000, 40, 3, 2, 1), (400, 300, 5, 4, 1), (400, 40, 2, 4, 2**28), (3, 3, 4, 2, 1), (900, 30, 8, 1, 1)):
        ids, v = rng.integers(0, n, n) if n < 500 else rng.permutation(n), rng.integers(-high, high + 1, (n, dim)) * scale
        v[rng.random(n) < 0.1] = 0
        v[rng.random(n) < 0.1] = v[0]
        own, q = ids[:m], v[:m]
        got = topk._search(5)(table(ids, v), table(own, q, row=pa.array(range(m), pa.int64()))).to_pylist()
        assert sorted((r["row"], r["query_id"], r["vec_id"], r["score"]) for r in got) == sorted(brute(ids, v, own, q, 5)), (n, dim)
    v = rng.normal(0, 32, (topk.CANDIDATES, 64)).astype(np.int64)
    left, right = table(np.arange(len(v)), v), table(np.arange(1024), v[:1024], row=pa.array(range(1024), pa.int64()))
    began = time.thread_time()
    assert len(topk._search(5)(left, right)) == 5 * 1024
    took, began = time.thread_time() - began, time.thread_time()
    for i in range(64):  # a sixteenth of the queries, each with a product and a sort of its own
        np.lexsort((np.arange(len(v)), v @ v[i]))
    assert took < 16 * (time.thread_time() - began)


def test_top_k_of_repeated_ids(spark):
    from stepaudit.llm import topk

    schema = "vec_id long, embedding array<double>"
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 2.0])], schema)
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") == 0, 2).collect())
    assert got == sorted([(1, 1, 65536), (2, 2, 0), (1, 2, 131072), (2, 2, 65536)])
    for x in (3e7, 1e300):
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(spark.createDataFrame([(0, [x, 1.0]), (1, [-3e9, x])], schema), F.col("vec_id") == 0).collect()
