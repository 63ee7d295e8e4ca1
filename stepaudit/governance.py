"""Gates of a run: frozen hashes, resources, split audits, publication, and a supervised child process."""

from __future__ import annotations

import hashlib
import importlib.metadata
import math
import os
import resource
import signal
import socket
import subprocess
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepaudit.operators import vectors

#: Wall seconds and KiB of the three kinds of run, and of published files.
LIMITS = {"calibration": (60, 512 * 1024), "preflight": (120, 2048 * 1024), "fit": (2210, 2048 * 1024)}
ARTIFACT_BYTES, REPORT_BYTES, CACHE_BYTES = 128 * 1024 * 1024, 32 * 1024 * 1024, 32 * 1024 * 1024
ATTEMPTS = 5


def within(value, cap: float) -> bool:
    """A finite number from 0 to ``cap``; True and False are no numbers."""
    return type(value) in (int, float) and math.isfinite(value) and 0 <= value <= cap


def resources_ok(used: dict, kind: str = "fit") -> bool:
    """Whether a supervised run ended by itself within its limits."""
    seconds, kib = LIMITS[kind]
    code = used.get("exit_code")
    return type(code) is int and code == 0 and used.get("stop_reason", "missing") is None and within(used.get("elapsed_seconds"), seconds) and within(used.get("peak_kib"), kib)


def digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def lock_problems(top: str, files: dict[str, dict], packages: dict[str, str] | None = None, version=importlib.metadata.version) -> list[str]:
    """What differs from a lock of files (``bytes, sha256``) and package versions; links and unknown files count too."""
    root, found = Path(top), []
    present = {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() or p.is_symlink()}
    found += [f"missing {n}" for n in sorted(set(files) - present)] + [f"unexpected {n}" for n in sorted(present - set(files))]
    for name in sorted(set(files) & present):
        path, pin = root / name, files[name]
        if any(p.is_symlink() for p in [path, *path.parents] if root in [p, *p.parents]):
            found.append(f"link {name}")
        elif path.stat().st_size != pin["bytes"] or digest(path) != pin["sha256"]:
            found.append(f"changed {name}")
    for name, want in (packages or {}).items():
        try:
            have = version(name)
        except importlib.metadata.PackageNotFoundError:
            have = None
        if have != want:
            found.append(f"package {name}")
    total = sum(p["bytes"] for p in files.values())
    return found + (["too large"] if total > ARTIFACT_BYTES else [])


def split_problems(runs: DataFrame, split: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """``grp, problem`` of an audit of routing columns; no rows if all is well.

    ``runs`` has ``grp, query_index, sample_index, component``; ``split`` has ``grp, split``. Problems:
    missing ids, unknown or unseen groups, attempts outside the range, repeated or incomplete, and
    components that lie in two splits.
    """
    ids = runs.where("query_index IS NULL OR sample_index IS NULL").select("grp", F.lit("routing-ids").alias("problem"))
    unknown = runs.join(split, "grp", "left_anti").select("grp", F.lit("unknown-group").alias("problem"))
    unseen = split.join(runs, "grp", "left_anti").select("grp", F.lit("unseen-group").alias("problem"))
    outside = runs.where((F.col("sample_index") < 0) | (F.col("sample_index") >= attempts)).select("grp", F.lit("attempt-range").alias("problem"))
    per = runs.groupBy("grp").agg(F.count("sample_index").alias("n"), F.count_distinct("sample_index").alias("d"))
    repeated = per.where("n > d").select("grp", F.lit("repeated-attempt").alias("problem"))
    short = per.where(F.col("d") < attempts).select("grp", F.lit("incomplete-attempts").alias("problem"))
    crossing = (
        runs.join(split, "grp").groupBy("component").agg(F.count_distinct("split").alias("k"), F.min("grp").alias("grp")).where("k > 1")
        .select("grp", F.lit("component-crosses-splits").alias("problem"))
    )
    out = ids
    for df in (unknown, unseen, outside, repeated, short, crossing):
        out = out.unionByName(df)
    return out.distinct()


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, with ``side``; none if the tables are equal, repeats counted."""
    cols = expected.columns
    lost, new = expected.exceptAll(actual.select(*cols)), actual.select(*cols).exceptAll(expected)
    return lost.withColumn("side", F.lit("expected")).unionByName(new.withColumn("side", F.lit("actual")))


def parity(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``matched, unmatched, max_error`` of a numeric column of two tables joined by keys."""
    a, b = expected.select(*keys, F.col(value).alias("x")), actual.select(*keys, F.col(value).alias("y"))
    both = a.withColumn("l", F.lit(True)).join(b.withColumn("r", F.lit(True)), keys, "full_outer")
    hit = F.col("l").isNotNull() & F.col("r").isNotNull()
    return both.agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"), F.max(F.when(hit, F.abs(F.col("x") - F.col("y")))).alias("max_error"))


def vector_parity(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``matched, unmatched, max_error, min_cosine`` of a vector column of two tables joined by keys; other lengths do not match."""
    a, b = expected.select(*keys, F.col(value).alias("x")), actual.select(*keys, F.col(value).alias("y"))
    both = a.join(b, keys, "full_outer")
    hit = F.coalesce(F.size("x") == F.size("y"), F.lit(False))
    error = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p.cast("double") - q.cast("double"))))
    cosine = F.try_divide(vectors.dot(F.col("x"), F.col("y")), F.sqrt(vectors.dot(F.col("x"), F.col("x")) * vectors.dot(F.col("y"), F.col("y"))))
    return both.agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"), F.max(F.when(hit, error)).alias("max_error"), F.min(F.when(hit, cosine)).alias("min_cosine"))


def publication_problems(report: dict, gate: dict, stage: Path) -> list[str]:
    """Why a staged candidate may not be published: the gate is computed anew, files are counted and hashed again."""
    found = []
    if report.get("status") != "completed" or report.get("fits") != 1:
        found.append("not one completed fit")
    if not resources_ok(report.get("resource", {}), report.get("kind", "fit")):
        found.append("resources")
    if report.get("gate") != gate:
        found.append("another gate")
    if gate.get("selected_threshold") not in [c["threshold"] for c in gate.get("candidates", []) if c["eligible"]]:
        found.append("no eligible threshold")
    return found + lock_problems(str(stage), report.get("files", {}))


def supervise(command: list[str], seconds: float, kib: int, poll: float = 0.01) -> dict:
    """Run a command in its own process group and stop the group beyond a wall time or resident size.

    Limits above those of :data:`LIMITS` are refused. Returns exit code, reason of a stop, seconds and peak.
    """
    if seconds > max(s for s, _ in LIMITS.values()) or kib > max(k for _, k in LIMITS.values()):
        raise ValueError("a limit may not be raised")
    began, peak, reason = time.monotonic(), 0, None
    child = subprocess.Popen(command, start_new_session=True)
    page = resource.getpagesize() // 1024
    while child.poll() is None:
        try:
            peak = max(peak, int(Path(f"/proc/{child.pid}/statm").read_text().split()[1]) * page)
        except (OSError, IndexError):
            pass
        if time.monotonic() - began > seconds or peak > kib:
            reason = "wall" if peak <= kib else "memory"
            os.killpg(child.pid, signal.SIGKILL)
            child.wait()
            break
        time.sleep(poll)
    return {"exit_code": child.returncode, "stop_reason": reason, "elapsed_seconds": time.monotonic() - began, "peak_kib": peak}


@contextmanager
def offline():
    """Within it no socket of this process connects to anything but this machine."""
    real = socket.socket.connect

    def guarded(self, address):
        if self.family != socket.AF_UNIX and not str(address[0]).startswith("127."):
            raise RuntimeError("the run is offline")
        return real(self, address)

    socket.socket.connect = guarded
    try:
        yield
    finally:
        socket.socket.connect = real


def approved(flag: bool) -> None:
    """A fit on real rows needs a clear yes."""
    if flag is not True:
        raise PermissionError("a reviewed run must be approved")


def cancel(spark, tag: str) -> list[str]:
    """Stop the queries that run under a tag (set by ``spark.addTag``); the session goes on."""
    return spark.interruptTag(tag)
