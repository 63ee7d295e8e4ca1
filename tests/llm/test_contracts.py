"""The registered queries over whole tables, by SQL or beside brute force."""

import base64
import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from compare import by_sql, difference
from tokenizers import Tokenizer

from stepaudit.llm import queries as q


@pytest.fixture(scope="module")
def texts(data):
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{data}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, data, name):
    _, said = difference(spark, data, q.queries()[name], q.oracle_sql()[name])
    assert not said


def test_bpe(spark, data, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.op4_bpe(spark, data).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids = own.encode_ordinary(t)
        assert got[k] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_flac(spark, data, texts):
    got = {r.doc_id: r for r in q.op5_flac(spark, data).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        raw = t.encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64


def test_packing(spark, data, texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in q.op6_packing(spark, data).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for k, text in texts.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    filled = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        filled += at
    assert filled / (2048 * len(sequences)) > 0.9


def test_token_counts(spark, data, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    for r in q.op7_token_counts(spark, data).collect():
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_language_id(spark, data, texts):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{data}/documents.parquet'").fetchall())
    right = held = 0
    rows = q.op10_language_id(spark, data).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id])))
        if r.held_out and lang[r.doc_id]:
            held, right = held + 1, right + (r.lang_pred == lang[r.doc_id])
    assert right >= 0.85 * held, (right, held)


def test_lm_score(spark, data, texts):
    """Every score beside a plain reading of the model; the same at 1 and 16 partitions; above word frequencies."""
    from stepaudit.llm import lm_score as lm

    rows = {r.doc_id: r for r in q.op8_lm_score(spark, data).collect()}
    assert rows.keys() == texts.keys()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    for n in (1, 16):
        other = {r.doc_id: r.log_likelihood for r in lm.score(docs.repartition(n)).collect()}
        assert all(abs(other[k] - rows[k].log_likelihood) < 1e-6 * max(1, abs(other[k])) for k in rows)
    model = lm.train(docs)

    def slots(text):
        raw = text.encode()
        return lm.word_slots(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()

    counts = np.zeros(lm.SLOTS, np.int64)
    words = {k: slots(t) for k, t in texts.items()}
    for w in words.values():
        np.add.at(counts, w, 1)
    total, unigram, n = 0.0, 0.0, 0
    for k, w in words.items():
        sides = [lm.EDGE, *(int(model.vocabulary.context[x]) for x in w), lm.EDGE]
        want = 0.0
        for p, x in enumerate(w):
            target = int(model.vocabulary.target[x])
            want += float(model.table[(sides[p] * lm.SIDES + sides[p + 2]) * lm.TARGETS + target]) + float(model.vocabulary.share[x])
            unigram += np.log((counts[x] + 1) / (counts.sum() + lm.SLOTS))
        assert rows[k].n_words == len(w) and abs(rows[k].log_likelihood - want) < 1e-5 * max(1, abs(want))
        total, n = total + want, n + len(w)
    assert total / n > unigram / n + 0.05, (total / n, unigram / n)
    mass = np.bincount(model.vocabulary.target, np.exp(model.vocabulary.share.astype(float)), lm.TARGETS)
    assert np.allclose(mass, 1, atol=1e-3) and np.allclose(np.exp(model.table.reshape(-1, lm.TARGETS).astype(float)).sum(1), 1, atol=1e-4)


def _as_sql(docs, folder, sql):
    """Rows of a query over ``docs`` as the table documents."""
    folder.mkdir()
    docs.toPandas().to_parquet(folder / "documents.parquet")
    names, rows = by_sql(str(folder), sql)
    return [dict(zip(names, r, strict=True)) for r, n in rows.items() for _ in range(n)]


NEAR_5 = q._NEAR.replace("len(ws) < 4", "len(ws) < 5").replace("len(ws) - 2)", "len(ws) - 3)").replace("ws[i:i+3]", "ws[i:i+4]")


def test_pipeline(spark, data, tmp_path):
    """Each stage beside a plain version of it on its own input."""
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    from stepaudit.llm import language_id

    first = spark.read.parquet(f"{data}/documents.parquet")
    named, cut, one, packed = (stage for _, stage in c.STAGES)
    model = language_id.train(first, F.lit(True))
    kept = c.written(named(spark, first, data), "language")
    want = {r.doc_id for r in first.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= c.LEAST_SCORE}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want and len(want) > 0.9 * first.count()

    lines = c.written(cut(spark, kept, data), "lines")
    want = {r["doc_id"]: r["text"] for r in _as_sql(kept, tmp_path / "a", q._LINES)}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text is not None)

    near = c.written(one(spark, lines, data), "near")
    want = {r["doc_id"] for r in _as_sql(lines, tmp_path / "b", NEAR_5) if r["kept"]}
    assert {r.doc_id for r in near.select("doc_id").collect()} == want and near.count() == len(want)
    for docs in (kept, lines, near):
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in packed(spark, near, data).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for r in near.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert sum(n for _, n, _ in got[r.doc_id]) == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc in got[r.doc_id])
    assert got.keys() == want


def test_pipeline_odd_rows(spark, data):
    """Null, empty and long texts, repeated rows and ids, an empty table and clashing names, stage by stage."""
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n string, h1 string, component string, ids string, bucket string"
    english = "the quick brown fox jumps over the lazy dog and runs into the deep green forest again"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "".join(f"{english} {k}\n" for k in range(3000))), (5, english), (5, english), (5, "another text about the rivers and the mountains of the north"), (6, english + " x"), (None, "lost id with the words of a text"), (None, None), (7, "12 34")]
    rows += [(100 + k, f"{english} number {k} " + " ".join(f"w{k}_{j}" for j in range(30))) for k in range(40)]
    docs = spark.createDataFrame([(k, t, "en", None, 5, 0.5, "x", "n", "h", "c", "i", "b") for k, t in rows], schema)
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, c.written(stage(spark, docs, data), name)
        assert docs.columns == before.columns
        ids = sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect())
        if name == "language_id":
            assert set(ids) >= {4, 5, 6, -1, 100, 139} and not {1, 2, 3, 7} & set(ids)
        assert stage(spark, before.limit(0), data).collect() == []
    assert ids.count(5) == 2 and ids.count(6) == 0 and ids.count(-1) == 1
    assert {r.text for r in docs.where("doc_id = 5").collect()} == {english, "another text about the rivers and the mountains of the north"}
    pieces = c.STAGES[-1][1](spark, docs, data).collect()
    assert sum(r.length for r in pieces if r.start == 0) > 0 and c.STAGES[-1][1](spark, docs.limit(0), data).collect() == []
    assert len({(r.doc_id, r.doc_tokens) for r in pieces if r.start == 0}) == len(ids)
