"""The streaming form of the rules over events that arrive in parts: an extension, equal to the batch rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepaudit.operators import redact
from stepaudit.plans import queries as plans
from stepaudit.plans import views
from stepaudit.plans.views import table
from stepaudit.scratch import folder as shared
from stepaudit.session import ship
from stepaudit.streaming import review

#: Parts in which the events arrive, by their time.
PARTS = 3


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of events with ``ts, event_id``, in no order."""
    at = table(spark, folder, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return views.steps(spark, folder).drop("pos").join(at, "id")


def streamed_flags(spark: SparkSession, folder: str) -> DataFrame:
    """J1 and R1 to R5 as a stream: every part of the events is a run of its own from the checkpoint; the last one ends all runs."""
    top = f"{shared(ship(spark))}/stream-{uuid.uuid4().hex}"
    steps = arrivals(spark, folder)
    micros = F.unix_micros("ts")
    cut = steps.agg(F.percentile_approx(micros, F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]))).first()[0] or [0] * (PARTS - 1)
    ends = steps.groupBy("run_id").agg(F.max("ts").alias("ts"), (F.max("event_id") + 1).alias("event_id")).withColumn("kind", F.lit(review.END))
    for k in range(PARTS + 1):
        part = ends if k == PARTS else steps.where((micros > cut[k - 1] if k else F.lit(True)) & (micros <= cut[k] if k < PARTS - 1 else F.lit(True)))
        for c, kind in steps.dtypes:
            part = part if c in part.columns else part.withColumn(c, F.lit(None).cast(kind))
        part.select(*steps.columns).write.mode("append").parquet(f"{top}/in")
        live = spark.readStream.schema(steps.schema).parquet(f"{top}/in")
        found = review.flags(live, ["ts", "event_id"], safe=redact.masked(F.col("content")))
        found.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(review.FLAG).parquet(f"{top}/out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"streamed_flags": streamed_flags}


def oracle_sql() -> dict[str, str]:
    return {"streamed_flags": f"WITH {plans._FLAGS} SELECT CAST(run_id AS VARCHAR) AS run_id, pos, step_id, rule, evidence, phase, place FROM f"}
