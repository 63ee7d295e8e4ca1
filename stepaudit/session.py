"""Session settings that the engine expects."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch, at most; a larger row is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC."""
    b = SparkSession.builder.appName("stepaudit")
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("STEPAUDIT_DRIVER_MEMORY", "6g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once a session, for sessions started elsewhere.

    Arrow batches are held to ARROW_ROWS rows and ARROW_BYTES bytes: whole texts or shingle sets in
    larger ones cost an executor hundreds of MB.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_stepaudit_shipped", None) != sc.applicationId:
        top = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="stepaudit-")) / "stepaudit.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(at))
        sc._stepaudit_shipped = sc.applicationId
    return spark
