"""A corpus from raw documents to packed sequences: each stage works on all that the one before kept.

Language ID rejects documents without letters (``und``) and those whose language is doubtful;
line dedup cuts repeated three-line windows; MinHash near-dedup keeps one document of each group;
packing cuts the rest into sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepaudit.llm import language_id as languages
from stepaudit.llm import line_dedup as lines
from stepaudit.llm import minhash
from stepaudit.llm.queries import packed
from stepaudit.scratch import written
from stepaudit.session import ship

#: A document goes if its language is less probable than this.
LEAST_SCORE = 0.5

#: SQL has no form of the classifier or the tokenizer.
ORACLE_SQL = None


def _own(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` by quoted names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known with a score of at least LEAST_SCORE.

    Learned from the labelled rows of ``docs``. Null, empty and letterless texts go; without a
    labelled row nothing is known, so all go. Equal texts share their fate; all columns pass through.
    """
    ship(spark)
    model = languages.train(docs, F.lit(True))
    named = languages.identify(docs, model)
    return named.where((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*_own(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without repeated windows of three lines; n_chars follows the text.

    A null text stays null (n_chars too), an emptied one is empty; rows equal in id and text count
    as one document here; ties go to the least id, then text hash, then place.
    """
    cut = lines.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8 or more.

    Rows are told apart by id and text, so that a repeated id with another text stays and an exact
    repeat goes; texts without words and rows without an id stay. The least id of a group stays.
    """
    ship(spark)
    return minhash.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; null texts count as empty, a null source is a queue of its own."""
    ship(spark)
    return packed(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written before the next reads it; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
