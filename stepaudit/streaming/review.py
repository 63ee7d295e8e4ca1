"""Flags of steps as they arrive: an extension beyond completed runs, equal to the batch rules once a run has ended.

Every run has its state: the number of its steps, for every call id its calls that wait for a result
(first in, first out), and for every call signature its count and first ids. A step's own flags come
out with its batch; results that are missing when the run ends (a row of the kind ``end``, or no step
for ``idle_ms`` of event time) come out then, and the state goes. Steps of one run must arrive in their
order; their place in it is counted. A run's state is one value (a run has 2000 steps at most by
contract), read and written once a batch, and holds no text; a restart goes on from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from stepaudit.operators import rules
from stepaudit.session import ship

#: A row of this kind ends its run.
END = "end"
FLAG = "run_id string, pos int, step_id string, rule string, evidence string, phase int, place long"
_NAMES = [c.split()[0] for c in FLAG.split(", ")]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Review(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("run", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps = pd.concat(list(rows))
        steps = steps.sort_values([c for c in steps.columns if c.startswith("order")], kind="stable")
        run, out, ended = self._load(), [], False
        for s in steps.itertuples(index=False):
            if s.kind == END:
                ended = True
            else:
                out += self._step(key[0], run, s)
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if ended:
            out += self._close(key[0], run)
        else:
            self.kept.update((json.dumps(run, separators=(",", ":")),))
            if self.idle_ms:
                self.handle.registerTimer(int(steps["ms"].max()) + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._close(key[0], self._load())
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    def _load(self) -> dict:
        """Steps so far; by call id its first step and its waiting calls' places and ids; by signature its count and first ids."""
        return json.loads(self.kept.get()[0]) if self.kept.exists() else {"pos": 0, "calls": {}, "seen": {}}

    @staticmethod
    def _step(name: str, run: dict, s) -> list[tuple]:
        run["pos"] = pos = run["pos"] + 1
        out = []
        if s.kind == "tool_call":
            ids = run["seen"].setdefault(s.signature, [])
            if len(ids) < rules.REPEATS:
                ids.append(s.id)
                if len(ids) == rules.REPEATS:
                    out.append((name, pos, s.id, "repeated_call", ", ".join(ids), 0, pos))
        if s.call_id:
            first, waits, ids = run["calls"].setdefault(s.call_id, [pos, [], []])
            if s.kind == "tool_call":
                waits.append(pos)
                ids.append(s.id)
            elif s.kind == "tool_result" and waits:
                del waits[0], ids[0]
            elif s.kind == "tool_result":
                out.append((name, pos, s.id, "unmatched_result", s.call_id, 0, pos))
        if s.kind == "tool_result" and s.error:
            out.append((name, pos, s.id, "tool_error", s.error, 0, pos))
        return out

    def _close(self, name: str, run: dict) -> list[tuple]:
        self.kept.clear()
        return [(name, p, i, "missing_result", call_id, 1, first) for call_id, (first, waits, ids) in run["calls"].items() for p, i in zip(waits, ids, strict=True)]

    def close(self) -> None:
        pass


def flags(steps: DataFrame, order: list[str], idle_ms: int = 0, safe: Column | None = None) -> DataFrame:
    """Flags (``FLAG``) of a stream of ``run_id, id, kind, content, tool, call_id, status`` and an event time ``ts``.

    ``order`` are columns that order the steps of a run within a batch. ``safe`` is the redacted content.
    With ``idle_ms`` the stream needs a watermark on ``ts``, and a run that is idle that long ends.
    Texts are read in the JVM; the state sees signatures and evidence only.
    """
    spark = ship(steps.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    content = F.coalesce("content", F.lit(""))
    by_status = F.coalesce(F.col("status") == "error", F.lit(False))
    snippet = F.regexp_extract(content if safe is None else safe, rules.SNIPPET, 0)
    error = F.when(by_status, rules.BY_STATUS).when(content.rlike(rules.ERROR), F.when(snippet == "", "error term").otherwise(snippet))
    rows = steps.select(
        F.col("run_id").cast("string").alias("run_id"), *[F.col(c).alias(f"order{k}") for k, c in enumerate(order)], "id", "kind", F.coalesce("call_id", F.lit("")).alias("call_id"), F.coalesce(error, F.lit("")).alias("error"),
        F.sha2(F.to_json(F.array(F.coalesce("tool", F.lit("")), content)), 256).alias("signature"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "ts",
    )
    return rows.groupBy("run_id").transformWithStateInPandas(Review(idle_ms), FLAG, "Append", "EventTime" if idle_ms else "None")
