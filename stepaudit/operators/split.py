"""A split without leaks: groups that share a normalized question go to one part, in the order of a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepaudit.operators.components import connected_components
from stepaudit.scratch import remove, written

#: What goes before a group's name in the hash; a parameter of :func:`assign`.
SEED = "stepaudit-split-1:"
_SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normalized(question: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(question), _SPACES, " "))


def assign(rows: DataFrame, group_col: str, question_col: str, seed: str = SEED) -> DataFrame:
    """``grp, component, split``: 60 % of the components train, 20 % validation, 20 % test.

    Places are counted by hash prefix first, so no task sorts all components.
    """
    keyed = rows.select(F.col(group_col).alias("grp"), F.sha2(normalized(F.coalesce(question_col, F.lit(""))), 256).alias("q")).where("grp IS NOT NULL").distinct()
    keyed = written(keyed, "questions")
    least = written(keyed.groupBy("q").agg(F.min("grp").alias("least")), "least")
    star = keyed.join(least, "q").where("grp != least").select("grp", "least")
    joined = connected_components(star, "grp", "least").select(F.col("node").alias("grp"), "component")
    comps = written(keyed.select("grp").distinct().join(joined, "grp", "left").select("grp", F.coalesce("component", "grp").alias("component")), "components")
    remove(keyed, least)
    roots = comps.select("component").distinct().withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("component").cast("string")), 256))
    roots = roots.withColumn("bucket", F.substring("h", 1, 3))
    sizes = roots.groupBy("bucket").agg(F.count("*").alias("n"))  # 4,096 rows at most
    sizes = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = roots.join(F.broadcast(sizes), "bucket").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("h")) - 1)
    part = F.when(F.col("i") < F.floor(F.col("total") * F.lit(0.6)), "train").when(F.col("i") < F.floor(F.col("total") * F.lit(0.8)), "validation").otherwise("test")
    return comps.join(ranked.select("component", part.alias("split")), "component").select("grp", "component", "split")


def leaks(rows: DataFrame, assigned: DataFrame, group_col: str, question_col: str) -> DataFrame:
    """Questions in more than one part; there should be none."""
    q = rows.select(F.col(group_col).alias("grp"), F.sha2(normalized(F.coalesce(question_col, F.lit(""))), 256).alias("q"))
    return q.join(assigned, "grp").groupBy("q").agg(F.count_distinct("split").alias("n")).where("n > 1")
