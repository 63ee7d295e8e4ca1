"""Line dedup: overlapping three-line windows, repeated anywhere in the corpus, lose their later occurrences.

Every run of ``window`` consecutive lines is hashed (two 64-bit hashes). A window seen before,
in the order of (id, text hash, position), covers its lines; the covered positions of a document
are merged and those lines go. Only built-in functions are used.

At scale: windows are counted with map-side partial aggregation, so that a passage in a third of
the documents adds one row a task. Repeated windows are joined back on the hash and a salt, both
sides by exchanges that adaptive execution may split. Texts are shuffled once, by id.

Defined cases: a null text stays null and an empty one empty; documents with fewer lines than
``window`` are untouched; windows of blank lines only are never repeats; rows equal in id and text
count as one document and get the same result; rows with the same id (null also) and another text
are documents of their own, told apart by the text; other columns go through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SALTS = 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    lines = F.transform(_lines(F.col(text_col)), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.trim(x) == "").alias("b")))
    base = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("__ld_id"), F.xxhash64(text_col).alias("__ld_t"), lines.alias("l")
    ).where(F.size("l") >= window)
    spots = F.transform(
        F.sequence(F.lit(0), F.size("l") - window),
        lambda i: F.struct(
            i.alias("p"),
            F.xxhash64(*[F.get(F.col("l"), i + k)["h"] for k in range(window)]).alias("h1"),
            F.xxhash64(F.lit(window), *[F.get(F.col("l"), i + k)["h"] for k in reversed(range(window))]).alias("h2"),
            F.forall(F.slice("l", i + 1, window), lambda x: x["b"]).alias("blank"),
        ),
    )
    return base.select("__ld_id", "__ld_t", F.explode(F.filter(spots, lambda s: ~s["blank"])).alias("s")).select(
        "__ld_id", "__ld_t", "s.p", "s.h1", "s.h2"
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated windows cut out of ``text_col``.

    Adds ``n_lines`` (before) and ``n_removed``, both null for a null text; they replace
    columns of these names.
    """
    made = [(c, f"c{k}") for k, c in enumerate(docs.columns)]  # columns go by numbers, so that no name can clash or need quotes
    id_col, text_col = dict(made)[id_col], dict(made)[text_col]
    docs = docs.toDF(*[n for _, n in made])
    wins = _windows(docs, id_col, text_col, window)
    place = F.struct("__ld_id", "__ld_t", "p")
    first = (
        wins.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    later = (
        wins.withColumn("salt", F.pmod(F.xxhash64("__ld_t", "p"), F.lit(SALTS)).cast("int"))
        .join(first, ["h1", "h2", "salt"]).where(~F.struct("__ld_id", "__ld_t", "p").eqNullSafe(F.col("first")))
    )
    covered = later.groupBy("__ld_id", "__ld_t").agg(F.collect_set("p").alias("__ld_p"))
    keyed = docs.withColumns({"__ld_t2": F.xxhash64(text_col), "__ld_id2": F.col(id_col)})
    joined = keyed.join(covered, F.col("__ld_id2").eqNullSafe(F.col("__ld_id")) & (F.col("__ld_t2") == F.col("__ld_t")), "left")
    # Both are columns that are read twice, so that they are not worked out again for every line.
    ready = joined.withColumns(
        {
            "__ld_l": _lines(F.col(text_col)),
            "__ld_gone": F.array_distinct(F.flatten(F.transform("__ld_p", lambda p: F.sequence(p, p + (window - 1))))),
        }
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("__ld_l") - 1), "__ld_gone")
    cut = F.array_join(F.transform(kept, lambda i: F.get("__ld_l", i)), "\n")
    hit = F.col("__ld_p").isNotNull() & F.col(text_col).isNotNull()
    out = ready.withColumns(
        {
            "n_lines": F.when(F.col(text_col).isNotNull(), F.size("__ld_l")),
            "n_removed": F.when(hit, F.size("__ld_gone")).when(F.col(text_col).isNotNull(), F.lit(0)),
            "__ld_new": F.when(hit, cut).otherwise(F.col(text_col)),
        }
    )
    kept_cols = [F.col("__ld_new" if n == text_col else n).alias(c) for c, n in made if c not in ("n_lines", "n_removed")]
    return out.select(*kept_cols, "n_lines", "n_removed")
