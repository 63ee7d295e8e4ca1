"""Python's words in the JVM, and the sparse fit beside a plain one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepaudit.functions import texts
from stepaudit.operators import tfidf


def test_words_of_any_script(spark):
    """Every character, alone and between letters, beside Python's own words."""
    rng = random.Random(5)
    every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(every)
    rows = ["".join(f"a{c}b {c}{c} " for c in every[i : i + 400]) for i in range(0, len(every), 400)]
    rows += ["ΟΔΟΣ ὈΔΥΣΣΕΎΣ Σ", "İstanbul DİL", "Straße ÄÖÜ x_1 café", "", " "]
    got = spark.createDataFrame(list(enumerate(rows)), "k int, t string").select("k", texts.words_of(spark, F.col("t")).alias("w")).collect()
    lowered = spark.createDataFrame(list(enumerate(rows)), "k int, t string").select("k", F.lower("t").alias("l")).collect()
    cased = {r.k: r.l for r in lowered}
    for r in got:
        # Letters of a Unicode version that the JVM does not know keep their case; their classes are right all the same.
        assert r.w == re.findall(r"\b\w\w+\b", cased[r.k])
        if cased[r.k] == rows[r.k].lower():
            assert r.w == texts.unicode_words(rows[r.k])
    assert sum(cased[k] == t.lower() for k, t in enumerate(rows)) > 0.9 * len(rows)


def _rows(n=120, seed=1):
    rng = random.Random(seed)
    own = {-1: ["kaputt", "verloren"], 0: ["vielleicht", "schön"], 1: ["fertig", "größer"]}
    return [(k, " ".join(rng.choices(own[y] + ["der", "café", "olé", "schritt"], k=9)), y) for k in range(n) for y in [k % 3 - 1]]


def _plain(rows, terms, idf):
    x = np.zeros((len(rows), len(terms)))
    for i, (_, text, _) in enumerate(rows):
        words = texts.unicode_words(text)
        for t, n in (Counter(words) + Counter(map(" ".join, zip(words, words[1:])))).items():
            if t in terms:
                x[i, terms.index(t)] = (1 + math.log(n)) * idf[terms.index(t)]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def test_sparse_fit(spark):
    """The fit's loss is that of a plain numpy fit (many small steps of Newton's kind), its gradient that of the dense matrix."""
    rows = _rows()
    docs = spark.createDataFrame(rows, "id int, text string, label int").repartition(5)
    model, b = tfidf.train(docs)
    got = sorted(model.collect(), key=lambda r: r.term)
    terms, idf = [r.term for r in got], [r.idf for r in got]
    assert {"café", "olé", "größer", "schön"} <= set(terms) and "caf" not in terms
    x, y = _plain(rows, terms, idf), np.array([r[2] + 1 for r in rows])
    n, width = x.shape

    def value(v):
        w, c = v[:-3].reshape(width, 3), v[-3:]
        z = x @ w + c
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        loss = -np.log(p[np.arange(n), y]).mean()
        p[np.arange(n), y] -= 1
        return loss + (w**2).sum() / (2 * n), np.append((x.T @ p / n + w / n).ravel(), p.mean(0)), loss

    mine = np.append(np.array([[r.w0, r.w1, r.w2] for r in got]).ravel(), b)
    v = np.zeros(3 * width + 3)
    for _ in range(4000):  # plain descent on a strongly convex loss
        v = v - 2.0 * value(v)[1]
    assert np.abs(value(v)[1]).max() < 1e-5
    assert abs(value(mine)[0] - value(v)[0]) < 1e-8 and np.abs(value(mine)[1]).max() < 2e-5
    at = np.random.default_rng(1).normal(size=3 * width + 3)
    loss, g, count = tfidf.evaluate(tfidf.blocks(docs, terms, np.array(idf)), at, width)
    want = value(at)
    assert count == n and abs(loss - want[2]) < 1e-12
    assert np.allclose(g[:-3], want[1][:-3] - at[:-3] / n, atol=1e-12) and np.allclose(g[-3:], want[1][-3:], atol=1e-12)
    right = sum(r.predicted == r.doc_id % 3 - 1 for r in tfidf.predict(docs, model, b, "id").collect())
    assert right >= 0.9 * len(rows)


def test_fit_contract(spark):
    docs = spark.createDataFrame(_rows(), "id int, text string, label int")
    with pytest.raises(ValueError, match="classes"):
        tfidf.train(docs.where("label != 0"))
    with pytest.raises(ValueError, match="converge"):
        tfidf.train(docs, iterations=2)
    with pytest.raises(ValueError, match="two texts"):
        tfidf.train(docs.limit(1))


def test_prediction_cases(spark):
    model = spark.createDataFrame([("aa", 1.0, 1.0, 1.0, 0.0), ("bb", 1.0, 0.0, 0.0, 2.0)], tfidf.MODEL)
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, None), (4, "é"), (1, "bb")], "doc_id int, text string")
    got = sorted((r.doc_id, r.predicted) for r in tfidf.predict(docs, model, [0.0, 0.0, 0.0]).collect())
    assert got == [(1, -1), (1, 1), (2, 1), (3, -1), (4, -1)]  # the first of equal ones
    assert tfidf.predict(docs.limit(0), model, [0.0, 0.0, 0.0]).collect() == []
    assert tfidf.vocabulary(docs.limit(0)).collect() == []
