"""Masked pseudo-likelihood by a bidirectional window network.

Every word is predicted from the words on both its sides; the sum of a document's conditional
log-probabilities is its score. A word's probability is that of its class, which the network gives
from the classes of its neighbours, times its share of the class:

* The vocabulary is counted over all documents in ``SLOTS`` hashed slots (the only bound on it), so
  the counts grow with the input. The most frequent slots are classes of their own; the rest share
  ``TAIL`` classes by hash, and within a class a word has its counted share, smoothed by one.
* The network has an embedding for each side and class, a tanh layer and a softmax over the
  target classes. It sees a word only by its class and those of its neighbours, so the number of
  times that each (left, right, target) triple occurs is all that its gradient needs. The triples of
  all words of all documents are counted by the cluster; numpy trains on the counts.

Counts are whole numbers, so neither the partitioning nor the order of rows changes a score. Both
tables have a fixed largest size and go to the tasks; no text reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepaudit.llm.arrow import flat, pieces
from stepaudit.llm.minhash import shingles

#: Bits of a slot, target and context classes, and how many of each are shared by rarer words.
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
TARGETS, TARGET_TAIL = 256, 64
CONTEXTS, CONTEXT_TAIL = 64, 32
#: The class of the place before the first and after the last word.
EDGE = CONTEXTS
SIDES = CONTEXTS + 1
HIDDEN, EPOCHS, RATE = 32, 80, 0.05
PIECE = 1 << 19


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every word, and documents' offsets into them; words are in lower case (A-Z), cut at blanks."""
    hashed, begin = shingles(data, offsets, 1)
    return (hashed >> np.uint64(64 - SLOT_BITS)).astype(np.int64), begin


class Vocabulary:
    """Classes of slots, and each slot's log share of its target class."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.target, self.context = (self._classes(order, counts, n, tail) for n, tail in ((TARGETS, TARGET_TAIL), (CONTEXTS, CONTEXT_TAIL)))
        mass = np.bincount(self.target, counts + 1, TARGETS)
        self.share = (np.log(counts + 1) - np.log(np.maximum(mass, 1))[self.target]).astype(np.float32)

    @staticmethod
    def _classes(order: np.ndarray, counts: np.ndarray, n: int, tail: int) -> np.ndarray:
        made = (n - tail + np.arange(SLOTS) % tail).astype(np.uint8)
        top = order[: n - tail]
        top = top[counts[top] > 0]
        made[top] = np.arange(len(top))
        return made

    def cells(self, slots: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(left * SIDES + right) * TARGETS + target of every word."""
        side = self.context[slots].astype(np.int64)
        left, right = np.full(len(slots), EDGE), np.full(len(slots), EDGE)
        left[1:], right[:-1] = side[:-1], side[1:]
        full = np.diff(begin) > 0
        left[begin[:-1][full]] = EDGE
        right[begin[1:][full] - 1] = EDGE
        return (left * SIDES + right) * TARGETS + self.target[slots]


def network() -> dict[str, np.ndarray]:
    """Embeddings of the left and right class, output weights and bias."""
    rng = np.random.default_rng(11)
    return {
        "left": rng.normal(0, 0.3, (SIDES, HIDDEN)), "right": rng.normal(0, 0.3, (SIDES, HIDDEN)),
        "out": rng.normal(0, 0.1, (HIDDEN, TARGETS)), "bias": np.zeros(TARGETS),
    }


def log_softmax(net: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of all targets for contexts, and the hidden layer."""
    h = np.tanh(net["left"][left] + net["right"][right])
    x = h @ net["out"] + net["bias"]
    x -= x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True)), h


def fit(triples: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """The network of counted triples: Adam on the log-loss of all words, from the targets' frequencies on."""
    n = triples.reshape(SIDES * SIDES, TARGETS).astype(np.float64)
    seen = np.flatnonzero(n.sum(1))
    net = network()
    if not len(seen):
        return net
    n = n[seen] / n.sum()
    weight, left, right = n.sum(1, keepdims=True), seen // SIDES, seen % SIDES
    net["bias"] = np.log(n.sum(0) + 1e-7)
    m, v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))
    for t in range(1, epochs + 1):
        logp, h = log_softmax(net, left, right)
        g = np.exp(logp) * weight - n
        back = (g @ net["out"].T) * (1 - h * h)
        grad = {"out": h.T @ g, "bias": g.sum(0), "left": np.zeros_like(net["left"]), "right": np.zeros_like(net["right"])}
        np.add.at(grad["left"], left, back)
        np.add.at(grad["right"], right, back)
        for k, x in net.items():
            m[k] += 0.1 * (grad[k] - m[k])
            v[k] += 0.01 * (grad[k] ** 2 - v[k])
            x -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return net


class Model:
    """What scoring needs: the vocabulary and the network's log-probabilities of every triple."""

    def __init__(self, vocabulary: Vocabulary, net: dict[str, np.ndarray]):
        both = np.arange(SIDES * SIDES)
        self.vocabulary, self.table = vocabulary, log_softmax(net, both // SIDES, both % SIDES)[0].astype(np.float32).ravel()

    def log_probabilities(self, slots: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log p(word | both sides) of each word."""
        return self.table[self.vocabulary.cells(slots, begin)].astype(np.float64) + self.vocabulary.share[slots]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    for batch in batches:
        data, offsets = flat(batch.column(column))
        for i, j in pieces(offsets, PIECE):
            yield batch, i, j, *word_slots(data, offsets[i : j + 1])


def _counted(size: int, shared=None):
    """What occurs in a task's documents and how often: slots, or triples if a vocabulary is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for *_, slots, begin in _texts(batches, 0):
            total += np.bincount(shared.value.cells(slots, begin) if shared else slots, minlength=size)
        used = np.flatnonzero(total)
        for k in range(0, len(used), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(used[k : k + (1 << 16)].astype(np.int32)), pa.array(total[used[k : k + (1 << 16)]])], names=["place", "n"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            yield pa.RecordBatch.from_pydict({k: pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c, k in enumerate(("places", "counts"))})


def _gather(texts: DataFrame, size: int, shared=None) -> np.ndarray:
    """Sums over all tasks, of a fixed size, on the driver."""
    sums = texts.mapInArrow(_counted(size, shared), "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for r in sums.mapInArrow(_packed, "places binary, counts binary").toLocalIterator():
        out[np.frombuffer(r.places, np.int32)] = np.frombuffer(r.counts, np.int64)
    return out


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all words of all rows; without words every target is equally probable."""
    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    vocabulary = Vocabulary(_gather(texts, SLOTS))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    triples = _gather(texts, SIDES * SIDES * TARGETS, shared)
    shared.unpersist()
    return Model(vocabulary, fit(triples))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, slots, begin in _texts(batches, 1):
            sums = np.concatenate([[0.0], np.cumsum(shared.value.log_probabilities(slots, begin))])
            n = np.diff(begin)
            total = np.where(n > 0, sums[begin[1:]] - sums[begin[:-1]], 0.0)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0)[i:j], "n_words": pa.array(n, pa.int64()), "log_likelihood": pa.array(total),
                    "mean_log_probability": pa.array(total / np.maximum(n, 1), mask=n == 0),
                }
            )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_probability`` of every row, by ``model`` or one trained on ``docs``.

    Defined cases: a null or empty text and one of blanks only have no words, a log-likelihood of
    0 and a null mean; rows that repeat an id each give a row, and equal texts equal scores up to
    rounding; ties of frequency go to the lesser slot; a null id stays null; other columns are
    ignored; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(_score(shared), "doc_id long, n_words long, log_likelihood double, mean_log_probability double")
