"""Connected components by minimum-label propagation with pointer jumping.

Every round is two equi-joins on tables that were written before, so that adaptive execution
can split a hub's partition, and one pre-aggregated minimum. Rounds grow with the logarithm
of the diameter. Nothing but the count of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepaudit.scratch import remove, written


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return ``node, component`` for every endpoint; component is the least node reachable.

    Rows with a null endpoint link nothing and are dropped; self-links and repeats are
    harmless. No rows in, no rows out. Other columns are ignored.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = written(both, "links")
    labels = written(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
        .select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    for _ in range(max_rounds):
        seen = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        )
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        after = written(
            step.join(jump, "mid", "left")
            .select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("changed")),
            "labels",
        )
        remove(labels)
        labels = after
        if labels.where("changed").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    remove(both)
    done = labels.select("node", F.col("label").alias("component"))
    done._written_at = labels._written_at  # the caller may remove it
    return done
