"""TF-IDF of one- and two-word terms, and the three-class linear model that scores or abstains.

Words are cut in the JVM. Their counting is done on Arrow batches of word arrays: words become codes,
pairs of neighbours pairs of codes, and counts array operations, with no loop over rows. What is
known of a row never leaves its batch, so scoring, and the blocks of a fit, need no shuffle; a
vocabulary takes one, of counts that were merged by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepaudit.functions import texts
from stepaudit.scratch import remove, written
from stepaudit.session import ship

#: Vocabulary size, least documents of a term, classes.
TERMS, LEAST_DOCS = 20_000, 2
CLASSES = [-1, 0, 1]
#: Parts of a gradient that are added up in tasks of their own, past evaluations that the fit remembers, and its stop.
SLICES, MEMORY, GRADIENT = 16, 10, 1e-5

MODEL = "term string, idf double, w0 double, w1 double, w2 double"


def ascii_words(text: Column) -> Column:
    """Lower-cased words of two or more ASCII characters, as the scorer sees them."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def _entries(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term and count of every distinct term of each row's words, and the terms' texts."""
    codes = words.flatten().dictionary_encode()
    word = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    near = np.flatnonzero(row[1:] == row[:-1])
    # A pair's code is over all words' codes.
    code = np.concatenate([word, ((word[near] + 1) << 32) | word[near + 1]])
    row = np.concatenate([row, row[near]])
    term, place = np.unique(code, return_inverse=True)
    key, n = np.unique(row * max(len(term), 1) + place, return_counts=True)
    single = term[term < 1 << 32]
    first, second = (term[len(single) :] >> 32) - 1, term[len(single) :] & 0xFFFFFFFF
    pairs = pc.binary_join_element_wise(codes.dictionary.take(pa.array(first)), codes.dictionary.take(pa.array(second)), " ")
    names = pa.concat_arrays([codes.dictionary.take(pa.array(single)), pairs])
    return key // max(len(term), 1), key % max(len(term), 1), n, names


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, term, n, names = _entries(batch["w"])
        cf = np.bincount(term, n, len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(term, minlength=len(names))), pa.array(cf)], names=["term", "df", "cf"])


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = TERMS) -> DataFrame:
    """``term, df, cf, idf`` of the most frequent terms of Unicode words; ties go to the lesser term. One shuffle, by term.

    Every row is a document, whatever its id; a null text has no terms.
    """
    spark = ship(docs.sparkSession)
    part = docs.select(texts.words_of(spark, F.col(text_col)).alias("w")).mapInArrow(_counts, "term string, df bigint, cf bigint")
    by = part.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= LEAST_DOCS)
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    top = by.orderBy(F.desc("cf"), "term").limit(size).crossJoin(F.broadcast(n))
    return top.withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).drop("n_docs")


class Weights:
    """A model of at most TERMS terms, as arrays that go to every task."""

    def __init__(self, model: DataFrame):
        rows = model.select("term", "idf", "w0", "w1", "w2").limit(TERMS + 1).collect()
        self.terms = [r.term for r in rows]
        if len(rows) > TERMS or len(set(self.terms)) != len(rows):
            raise ValueError("a model has at most 20,000 terms, each once")
        self.idf = np.array([r.idf for r in rows], float)
        self.w = np.array([[r.w0, r.w1, r.w2] for r in rows], float).reshape(-1, 3)


def _values(words: pa.Array, terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and unit-length value of known terms, and the rows' lengths before (0: nothing is known)."""
    row, term, n, names = _entries(words)
    at = pc.index_in(names, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[term] if len(names) else term
    keep = at >= 0
    row, at, n = row[keep], at[keep], n[keep]
    v = (1 + np.log(n)) * idf[at] if len(at) else np.zeros(0)
    norm = np.sqrt(np.bincount(row, v * v, len(words)))
    return row, at, v / norm[row], norm


def _sums(model: Weights):
    terms = pa.array(model.terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, v, norm = _values(batch["w"], terms, model.idf)
            none = pa.array(norm == 0)
            sums = [pc.if_else(none, None, pa.array(np.bincount(row, v * model.w[at, k], len(batch)))) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["plain"], *sums], names=["doc_id", "plain", "s0", "s1", "s2"])

    return run


def probabilities(docs: DataFrame, model: DataFrame, intercept: list[float], words: Column, plain: Column, id_col: str) -> DataFrame:
    """``doc_id, plain, p`` of every row: the classes' probabilities, or null where no term of ``words`` is known."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), plain.alias("plain"), words.alias("w"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sums = rows.mapInArrow(_sums(Weights(model)), f"doc_id {kind}, plain boolean, s0 double, s1 double, s2 double")
    z = F.array(*[F.col(f"s{k}") + F.lit(intercept[k]) for k in range(3)])
    e = sums.withColumn("z", F.when(F.col("s0").isNotNull(), z)).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    return e.select("doc_id", "plain", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def score(docs: DataFrame, model: DataFrame, intercept: list[float], threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, p0, p1, p2, reason`` of every row: the probability of class -1, all classes', or why there is none.

    ``model`` has ``term, idf, w0, w1, w2``; one of more than ``TERMS`` rows, or of repeated terms, is
    refused, so it may go to all tasks. A text beyond ASCII, one without known terms, and a score at
    the threshold abstain. Rows that repeat an id are scored apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = ~text.rlike(r"[^\x00-\x7F]")
    words = F.when(plain, ascii_words(text)).otherwise(F.array().cast("array<string>"))
    p = probabilities(docs, model, intercept, words, plain, id_col)
    first, t = F.get("p", F.lit(0)), F.lit(threshold)
    reason = F.when(~F.col("plain"), "unsupported-unicode").when(first.isNull(), "no-known-features").when(F.abs(first - t) <= 1e-6, "threshold-ambiguity").when(first < t, "below-threshold")
    return p.select("doc_id", first.alias("score"), *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3)], reason.alias("reason"))


def predict(docs: DataFrame, model: DataFrame, intercept: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, p0, p1, p2, predicted`` of every row over its Unicode words, without abstention.

    ``predicted`` is the class of the greatest probability, the first of equal ones; a row without
    known terms has the intercept's probabilities.
    """
    words = texts.words_of(docs.sparkSession, F.col(text_col))
    e = [math.exp(x - max(intercept)) for x in intercept]
    bare = F.array(*[F.lit(x / sum(e)) for x in e])
    p = probabilities(docs, model, intercept, words, F.lit(True), id_col).withColumn("p", F.coalesce("p", bare))
    own = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("p", F.array_max("p")).cast("int"))
    return p.select("doc_id", *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3)], own.alias("predicted"))


def _rows_of(terms: list[str], idf: np.ndarray):
    """Sparse rows of a batch: labels, row ends, terms and values."""
    names = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            row, at, v, _ = _values(batch["w"], names, idf)
            ends = np.searchsorted(row, np.arange(len(batch)), "right")
            parts = (batch["y"].to_numpy().astype(np.int8), ends.astype(np.int32), at.astype(np.int32), v.astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["y", "ends", "terms", "v"])

    return run


def blocks(docs: DataFrame, terms: list[str], idf: np.ndarray, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Compressed sparse rows, a block a batch: ``y, ends, terms, v`` as binary arrays of all rows with a label."""
    spark = ship(docs.sparkSession)
    rows = docs.where(F.col(label_col).isNotNull()).select((F.col(label_col) + 1).cast("int").alias("y"), texts.words_of(spark, F.col(text_col)).alias("w"))
    return rows.mapInArrow(_rows_of(terms, idf), "y binary, ends binary, terms binary, v binary")


def _gradient(x: np.ndarray, width: int):
    """Loss and gradient of the blocks of a task, as slices that are added up by number; the loss is slice -1."""
    w, b = x[: 3 * width].reshape(width, 3), x[3 * width :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros(len(x)), np.zeros(2)
        for batch in batches:
            for y, ends, at, v in zip(*(batch[c] for c in ("y", "ends", "terms", "v")), strict=True):
                y, ends, at, v = (np.frombuffer(a.as_buffer(), t) for a, t in ((y, np.int8), (ends, np.int32), (at, np.int32), (v, np.float64)))
                row = np.repeat(np.arange(len(y)), np.diff(ends, prepend=0))
                z = np.stack([np.bincount(row, v * w[at, k], len(y)) for k in range(3)], 1) + b
                z -= z.max(1, keepdims=True)
                e = np.exp(z)
                p = e / e.sum(1, keepdims=True)
                loss += np.log(e.sum(1)).sum() - z[np.arange(len(y)), y].sum(), len(y)
                p[np.arange(len(y)), y] -= 1
                for k in range(3):
                    total[k : 3 * width : 3] += np.bincount(at, v * p[row, k], width)
                total[3 * width :] += p.sum(0)
        cut = np.array_split(total, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(SLICES)], pa.int32()), pa.array([a.tobytes() for a in (loss, *cut)], pa.binary())], names=["slice", "part"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(a.as_buffer(), np.float64) for c in table["part"].chunks for a in c)
    return pa.table({"slice": table["slice"][:1], "part": pa.array([total.tobytes()], pa.binary())})


def evaluate(made: DataFrame, x: np.ndarray, width: int) -> tuple[float, np.ndarray, int]:
    """Mean loss, its gradient and the number of rows at the weights ``x``: one job, sums by slice."""
    parts = made.mapInArrow(_gradient(x, width), "slice int, part binary").groupBy("slice").applyInArrow(_added, "slice int, part binary")
    got = {r.slice: np.frombuffer(r.part, np.float64) for r in parts.collect()}  # the gradient, of 3 * (TERMS + 1) numbers at most
    loss, n = got[-1]
    return float(loss / n), np.concatenate([got[k] for k in range(SLICES)]) / n, int(n)


def minimize(value, x: np.ndarray, iterations: int) -> tuple[np.ndarray, int]:
    """L-BFGS with a backtracking search; ``value(x)`` gives a loss and its gradient. Returns x and the iterations taken."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(iterations):
        if np.abs(g).max() <= GRADIENT:
            return x, k
        d, used = -g, []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            d = d - a * y
            used.append(a)
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        step = 1.0 if past else min(1.0, 1 / np.abs(g).sum())
        for _ in range(40):
            f2, g2 = value(x + step * d)
            if f2 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            return x, iterations
        s, y = step * d, g2 - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-MEMORY:]
        x, f, g = x + s, f2, g2
    return x, iterations


def fit_blocks(made: DataFrame, width: int, c: float = 1.0, iterations: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width, 3) and intercept of the multinomial logistic fit: mean loss + |w|^2 / (2 C n), intercept free.

    Raises if it does not converge, or if a class has no row.
    """

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g, n = evaluate(made, x, width)
        w = x[: 3 * width]
        return loss + w @ w / (2 * c * n), g + np.append(w, np.zeros(3)) / (c * n)

    x = np.zeros(3 * width + 3)
    _, g, _ = evaluate(made, x, width)
    if (g[3 * width :] > 1 / 3 - 1e-12).any():
        raise ValueError("the fit does not know all classes")
    x, took = minimize(value, x, iterations)
    if took >= iterations:
        raise ValueError("the fit did not converge")
    return x[: 3 * width].reshape(width, 3), x[3 * width :]


def fit(features: DataFrame, n: int, c: float = 1.0, iterations: int = 500):
    """A multinomial logistic fit with the penalty 1 / (C n) over dense ``features, label`` vectors."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(family="multinomial", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(features)
    if model.summary.totalIterations >= iterations or model.numClasses != len(CLASSES):
        raise ValueError("the fit did not converge, or does not know all classes")
    return model


def train(docs: DataFrame, text_col: str = "text", label_col: str = "label", size: int = TERMS, c: float = 1.0, iterations: int = 500) -> tuple[DataFrame, list[float]]:
    """The linear model of labelled texts as ``term, idf, w0, w1, w2`` and its intercept; labels are -1, 0, 1.

    The vocabulary is that of all rows; rows without a label are not fitted.
    """
    known = sorted(vocabulary(docs, text_col, size).collect(), key=lambda r: r.term)  # at most size
    if not known:
        raise ValueError("no term occurs in two texts")
    terms, idf = [r.term for r in known], np.array([r.idf for r in known])
    made = written(blocks(docs, terms, idf, text_col, label_col), "blocks")
    w, b = fit_blocks(made, len(terms), c, iterations)
    remove(made)
    rows = [(t, float(i), *map(float, row)) for t, i, row in zip(terms, idf, w, strict=True)]
    return docs.sparkSession.createDataFrame(rows, MODEL), [float(x) for x in b]
