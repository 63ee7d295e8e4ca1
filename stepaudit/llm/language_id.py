"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed to ``FEATURES`` places.
Document frequencies are counted over all learnable rows. The classifier is fitted on a bounded
sample of them (``SAMPLE`` rows, shared evenly by the labels: those of the least hashes of id and
text) by follow-the-regularised-leader with elastic-net penalties. A third of the sample is left out
of a first fit and fixes the temperature; the final fit takes the whole sample. Model and frequencies
are of fixed size. Only labels and sparse counts of the sample reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES = 1 << 15
SAMPLE = 3000
#: Labels that a model may have.
MAX_LABELS = 1000
#: Tasks that add up the frequencies of all others.
ADDERS = 16
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002
UNKNOWN = "und"
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
#: Characters that are hashed at once.
PIECE = 1 << 18


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text; an n-gram is never split."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(FEATURES, np.int64)
    for at in range(0, len(chars), PIECE):
        c = chars[at : at + PIECE + 2]
        new = min(PIECE, len(chars) - at)
        x, y, z = c * _M1, c * _M2, c * _M3
        for n, h in ((1, x), (2, x[:-1] ^ (y[1:] + _M3)), (3, x[:-2] + (y[1:-1] ^ (z[2:] >> np.uint32(5))) + _M2)):
            h = h[:new]
            h = (h ^ (h >> np.uint32(15))) * (_M2 + np.uint32(2 * n))
            out += np.bincount((h >> np.uint32(17)).astype(np.int64), minlength=FEATURES)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit-length TF-IDF values of a text."""
    c = counts(text)
    at = np.flatnonzero(c)
    return at, _weighed(at, c[at], idf)


def _weighed(at: np.ndarray, c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf[at]
    return v / max(float(np.sqrt((v * v).sum())), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for x in batch.column(0):
            df[:-1] += counts(x.as_py()) > 0
            df[-1] += 1
    yield pa.RecordBatch.from_pydict({"df": pa.array([df.tobytes()], pa.binary())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for x in batch.column(0):
            df += np.frombuffer(x.as_buffer(), np.int64)
    yield pa.RecordBatch.from_pydict({"df": pa.array([df.tobytes()], pa.binary())})


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(len(batch)):
            c = counts(batch.column(2)[r].as_py())
            at = np.flatnonzero(c)
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.uint16), np.minimum(c[at], 2**31 - 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), *packed], names=["h", "lang", "at", "n"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """Weights by feature and class, and what prediction needs."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf, self.temperature = langs, idf, 1.0
        self.weights, self.bias = np.zeros((FEATURES, len(langs))), np.zeros(len(langs))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
        """Follow-the-regularised-leader with one learning rate per coordinate."""
        z, n = np.zeros((FEATURES + 1, len(self.langs))), np.zeros((FEATURES + 1, len(self.langs)))

        def solve(zs: np.ndarray, ns: np.ndarray, l1: float, l2: float) -> np.ndarray:
            return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(ns)) / ALPHA + l2))

        order = np.random.default_rng(5)
        for _ in range(epochs):
            for r in order.permutation(len(rows)):
                at, value, label = rows[r]
                at, value = np.append(at, FEATURES), np.append(value, 0.2)
                w = solve(z[at], n[at], L1, L2)
                p = softmax(value @ w)
                p[label] -= 1
                g = value[:, None] * p
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - sigma * w
                n[at] += g * g
        w = solve(z, n, L1, L2)
        self.weights, self.bias = w[:-1], w[-1] * 0.2
        return self

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.bias

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
        """The temperature with the least log-loss on rows that were left out."""
        if rows:
            x, y = np.stack([self.logits(a, v) for a, v, _ in rows]), np.array([label for *_, label in rows])
            loss = lambda t: -np.log(softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean()
            self.temperature = min(np.geomspace(0.05, 10, 80).tolist(), key=loss)
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*vector(text, self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the rows that ``learnable`` admits and that have a label and a letter.

    Every label is learned, however rare; without such rows the model knows none.
    """
    spark = docs.sparkSession
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    made = rows.select(F.col(text_col).alias("text")).mapInArrow(_frequencies, "df binary")
    df = np.zeros(FEATURES + 1)
    for r in made.repartition(ADDERS).mapInArrow(_add, "df binary").collect():  # at most ADDERS rows
        df += np.frombuffer(r.df, np.int64)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    hashed = rows.select(F.xxhash64(F.lit("language"), id_col, text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = hashed.groupBy("lang").agg(F.count("*").alias("c")).limit(MAX_LABELS + 1).collect()
    if len(sizes) > MAX_LABELS:
        raise ValueError("there are too many labels")
    if not sizes:
        return Model([], idf)
    each = max(sample // len(sizes), 1)
    # Hashes are uniform, so twice as many rows as are wanted lie below this bound, up to chance; the rank is exact.
    bounds = spark.createDataFrame([(r.lang, -(2**63) + min(int(2**64 * 2 * (each + 50) / r.c), 2**64 - 1)) for r in sizes], "l string, bound long")
    near = hashed.join(F.broadcast(bounds), (F.col("lang") == F.col("l")) & (F.col("h") <= F.col("bound"))).select("h", "lang", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # rows of one hash are equal
    some = near.withColumn("r", rank).where(F.col("r") <= each).select("h", "lang", "text").mapInArrow(_sparse, "h long, lang string, at binary, n binary")
    some = sorted(some.collect(), key=lambda r: (r.h, r.lang))  # at most ``sample`` rows
    langs = sorted(r.lang for r in sizes)
    made = []
    for r in some:
        at = np.frombuffer(r.at, np.uint16).astype(np.int64)
        made.append((at, _weighed(at, np.frombuffer(r.n, np.int32), idf), langs.index(r.lang)))
    model = Model(langs, idf)
    if len(made) >= 30:
        model.fit([m for k, m in enumerate(made) if k % 3]).calibrate(made[::3])
    return model.fit(made)


def _predict(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*[f"c{k}" for k in range(batch.num_columns)], "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred, score``, which replace columns of these names.

    Defined cases: a null or empty text, one without a letter, and any text where nothing could be
    learned are ``und`` with score 0; equal texts get equal results; ties go to the first label in
    order; other columns pass through; no rows give none.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    schema = ", ".join([f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)] + ["lang_pred string, score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = numbered.mapInArrow(_predict(shared, keep.index(text_col)), schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score")


def third(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned where :func:`third` is not 1, predicted everywhere.

    A null id is not held out and not learned from. The other cases are those of :func:`identify`.
    """
    model = train(docs, third(id_col) != 1, id_col, text_col, lang_col, sample)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(third(id_col) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(chosen, model).select("doc_id", "held_out", "lang_pred", "score")
