"""Array operators of the semantic features: token budgets, pooling, cosine and a linear head."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens kept of task, prefix, text (with and without calls), tool name, arguments.
TASK, PREFIX, TEXT, TEXT_ALONE, NAME, ARGS_HEAD, ARGS_TAIL = 64, 190, 94, 254, 8, 16, 15


def head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def tail(a: Column, n: int) -> Column:
    """The last n items, or all of a shorter array."""
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - (n - 1)), F.lit(n))


def context(task: Column, prefix: Column, cls: int, sep: int) -> Column:
    return F.concat(F.array(F.lit(cls)), head(task, TASK), tail(prefix, PREFIX), F.array(F.lit(sep)))


def arguments(ids: Column) -> Column:
    return F.when(F.size(ids) <= ARGS_HEAD + ARGS_TAIL, ids).otherwise(F.concat(head(ids, ARGS_HEAD), tail(ids, ARGS_TAIL)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The unit mean of the vectors that the mask admits."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m != 0, v)), lambda v: v.isNotNull())
    total = F.aggregate(kept, F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return unit(total)


def softmax(logits: list[Column]) -> Column:
    z = F.array(*logits)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
