"""Streamed flags beside the batch rules, over random logs, restarts and idle runs."""

import datetime
import random

import pytest

from stepaudit.operators import rules
from stepaudit.streaming import review

SCHEMA = "run_id string, id string, kind string, content string, tool string, call_id string, status string, ts timestamp, n long"
START = datetime.datetime(2024, 1, 1)


def _logs(runs=8, steps=25):
    rng = random.Random(9)
    out = []
    for n in range(runs * steps):
        kind = rng.choice(["tool_call", "tool_call", "tool_result", "task"])
        out.append((f"r{rng.randrange(runs)}", f"i{n}", kind, rng.choice(["a", "b", "it failed", None]), rng.choice(["t", None]), rng.choice(["k1", "k2", "", None]), rng.choice(["ok", "error", None]) if kind == "tool_result" else None, START + datetime.timedelta(seconds=n), n))
    return out


def _batch(spark, rows):
    seen, made = {}, []
    for r in rows:
        seen[r[0]] = seen.get(r[0], 0) + 1
        made.append((r[0], seen[r[0]], *r[1:7]))
    got = rules.flags(spark.createDataFrame(made, "run_id string, pos int, id string, kind string, content string, tool string, call_id string, status string"))
    return sorted((r.run_id, r.pos, r.step_id, r.rule, r.evidence, r.phase, r.place) for r in got.collect())


def _stream(spark, top, parts, idle_ms=0):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(f"{top}/in")
        live = spark.readStream.schema(SCHEMA).parquet(f"{top}/in")
        live = live.withWatermark("ts", "1 second") if idle_ms else live
        found = review.flags(live, ["n"], idle_ms)
        found.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(review.FLAG).parquet(f"{top}/out").collect())


@pytest.mark.parametrize("cuts", [[200], [1, 90, 91, 200]])
def test_restarts(spark, tmp_path, cuts):
    rows = _logs()
    ends = [(f"r{k}", None, review.END, None, None, None, None, START + datetime.timedelta(days=1), 10**6) for k in range(8)]
    parts = [rows[a:b] for a, b in zip([0, *cuts[:-1]], cuts)] + [ends]
    got, want = _stream(spark, str(tmp_path), parts), _batch(spark, rows)
    assert not set(got) ^ set(want) and len(got) == len(want)


def test_idle_runs(spark, tmp_path):
    """A run ends when no step has come for a while; its later steps are a new run's."""
    call = ("r0", "i0", "tool_call", "a", "t", "k", None, START, 0)
    late = ("r1", "i1", "task", "a", None, None, None, START + datetime.timedelta(hours=2), 1)
    again = ("r0", "i2", "tool_result", "a", "t", "k", None, START + datetime.timedelta(hours=2), 2)
    got = _stream(spark, str(tmp_path), [[call], [late], [again]], idle_ms=60_000)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("r0", 1, "i0", "missing_result"), ("r0", 1, "i2", "unmatched_result")]
