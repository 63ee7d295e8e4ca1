"""Reports of redacted runs and their flags, review notes, and sinks that publish only what passed."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepaudit.operators import redact, rules
from stepaudit.operators.validate import MAX_BYTES
from stepaudit.sources import verified

#: Versions and the two notices of a report.
REPORT_VERSION = NOTES_VERSION = 1
METHOD = "Structural rules only. No trained model or model confidence is presented."
LIMITS = "Flags are observations for review, not causal diagnoses. Rules can miss semantic mistakes and flag benign exploration. Redaction is best effort."
NOTES_METHOD = "Experimental uncalibrated review suggestions; not observed evidence."


def safe_flags(steps: DataFrame) -> DataFrame:
    """Flags of raw steps as they may be shown: found first, then redacted, with the step ids of the redacted run.

    ``n_masked`` counts the masks of the flag's own texts; ``step_pos`` is the flagged step's position.
    """
    found = rules.records(rules.flags(steps, redact.masked(F.col("content"))))
    shown = redact.redact_steps(steps).select("run_id", "pos", F.col("id").alias("safe_id"))
    made = found.join(shown, ["run_id", "pos"])
    return made.select(
        "run_id", "phase", "place", "ordinal", "pos", F.concat_ws(":", "rule", "safe_id").alias("id"), "rule", F.col("safe_id").alias("step_id"), "severity", "title",
        redact.masked(F.col("sentence")).alias("evidence"), "uncertainty",
    )


def reports(runs: DataFrame, steps: DataFrame, generated_at: str | None = None) -> DataFrame:
    """``run_id, redaction_count, n_flags, report``: one JSON report for each run of ``run_id, task``.

    ``steps`` are the runs' raw steps. Ids and task are redacted and count too. The whole run is in the
    report, whatever is filtered on a screen. A run's steps, at most 2000 by contract, and flags form one row.
    """
    raw_cols = [c for c in ("id", "kind", "content", "tool", "call_id", "status")]
    safe = redact.redact_steps(steps)
    per_step = safe.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.struct(*raw_cols).alias("s")))).alias("steps"), F.sum("n_masked").alias("masks")
    )
    order = ["phase", "place", "ordinal", "pos"]
    shown = ["id", "rule", "step_id", "severity", "title", "evidence", "uncertainty"]
    per_flag = safe_flags(steps).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*shown).alias("f")))).alias("flags"))
    joined = runs.select("run_id", "task").join(per_step, "run_id").join(per_flag, "run_id", "left")
    flags = F.coalesce(F.col("flags.f"), F.array().cast(f"array<struct<{','.join(f'{c}:string' for c in shown)}>>"))
    count = F.col("masks") + redact.mask_count(F.col("run_id").cast("string")) + redact.mask_count(F.col("task"))
    run = F.struct(
        F.lit(1).alias("schema_version"), redact.masked(F.col("run_id").cast("string")).alias("run_id"), redact.masked(F.col("task")).alias("task"),
        F.lit("completed").alias("status"), F.col("steps.s").alias("steps"),
    )
    at = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.struct(
        F.lit(REPORT_VERSION).alias("report_version"), at.alias("generated_at"), F.lit(METHOD).alias("review_method"), F.lit(LIMITS).alias("limitations"),
        count.alias("redaction_count"), run.alias("run"), flags.alias("flags"),
    )
    return joined.select("run_id", count.alias("redaction_count"), F.size(flags).cast("long").alias("n_flags"), F.to_json(body).alias("report"))


def notes(made: DataFrame, scored: DataFrame, coverage: DataFrame) -> DataFrame:
    """``run_id, notes``: review notes of runs that have a report: the redacted run, results and coverage, no envelope."""
    shown = [c for c in scored.columns if c not in ("run_id", "context")]
    results = scored.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("msg_index", *[c for c in shown if c != "msg_index"]))).alias("results"))
    cov = coverage.select("run_id", F.struct(*[c for c in coverage.columns if c != "run_id"]).alias("coverage"))
    body = F.struct(
        F.lit(NOTES_VERSION).alias("review_notes_version"), F.parse_json(F.get_json_object("report", "$.run")).alias("run"), "results", "coverage", F.lit(NOTES_METHOD).alias("method")
    )
    return made.join(cov, "run_id").join(results, "run_id", "left").select("run_id", F.to_json(body).alias("notes"))


def write_texts(rows: DataFrame, path: str, text_col: str) -> None:
    """One JSON text a line in a new folder; an existing one is refused."""
    rows.select(F.col(text_col).alias("value")).write.mode("errorifexists").text(path)


def write_valid(runs: DataFrame, path: str, publication: str, raw_col: str = "raw") -> None:
    """Publish valid runs of at most 2 MiB under ``runs`` and all others, as ``{"reason", "raw"}``, under ``quarantine``.

    ``runs`` has ``reason``. One scan, one job: both parts become visible together or not at all, and
    the same publication again changes nothing (``sources.verified``).
    """
    small = F.octet_length(raw_col) <= MAX_BYTES
    ok = F.coalesce(F.col("reason").isNull() & small, F.lit(False))
    told = F.to_json(F.struct(F.coalesce("reason", F.when(F.col(raw_col).isNull(), "missing").otherwise("too-large")).alias("reason"), F.col(raw_col).alias("raw")))
    # A valid run may be written over several lines; those in JSON stand between values only.
    line = F.when(ok, F.regexp_replace(raw_col, "[\\r\\n]+", " ")).otherwise(told)
    rows = runs.select(F.when(ok, "runs").otherwise("quarantine").alias("folder"), F.lit(None).cast("string").alias("file"), line.alias("line"))
    verified.write_committed(rows, path, publication)


def evidence(samples: DataFrame, thresholds: list[float]) -> DataFrame:
    """Positions, labels, scores, audits (counts) and each threshold's decision, never a text: what may leave the review."""
    from stepaudit.operators.policy import exceeds

    keep = [c for c in ("split", "subset", "grp", "query_index", "sample_index", "msg_index", "label", "rule", "score", "support_reason", "audit", "truncated", "unknown_before") if c in samples.columns]
    flags = F.map_from_arrays(F.array(*[F.lit(str(t)) for t in thresholds]), F.array(*[exceeds(F.col("score"), F.lit(t)) for t in thresholds]))
    return samples.select(*keep, F.lit(True).alias("text_redacted"), flags.alias("model_flags"))


def attempt(path: str, body: dict) -> None:
    """Marks an attempt in a file that must not exist yet."""
    with open(path, "x") as f:
        f.write(json.dumps(body, sort_keys=True))


def publish(stage: str, output: str, check) -> None:
    """Move a finished local folder to ``output`` if ``check`` passes on it; the output must be new, a failed stage goes."""
    if os.path.lexists(output):
        raise ValueError("the output must be new")
    try:
        check(Path(stage))
    except Exception:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    os.rename(stage, output)


def split_json(split: DataFrame, files: DataFrame, seed: int, most: int = 100_000) -> str:
    """A split manifest of ``grp, split`` and ``file, sha256``, keys sorted, as ``sources.files.read_manifest`` takes it."""
    small = [{r[0]: r[1] for r in t.select(*c).distinct().limit(most + 1).collect()} for t, c in ((split, ("grp", "split")), (files, ("file", "sha256")))]
    if max(map(len, small)) > most:
        raise ValueError("a manifest is small")
    if small[0] and split.select("grp", "split").distinct().count() != len(small[0]):
        raise ValueError("a group has one split")
    return json.dumps({"seed": seed, "groups": small[0], "source_sha256": small[1]}, sort_keys=True, indent=2)


def results_json(tables: dict[str, DataFrame], most: int = 10_000) -> str:
    """Small result tables as one JSON text with sorted keys; a table of more than ``most`` rows is refused."""
    out = {}
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} is no small table")
        out[name] = sorted((r.asDict(True) for r in rows), key=lambda r: json.dumps(r, sort_keys=True, default=str))
    return json.dumps(out, sort_keys=True, indent=2, default=str)
