"""Typed values, labels and samples of JSON lines beside a plain version."""

import json
import random

import pytest

from stepaudit.operators import features, policy, trajectory

ROWS = "subset string, grp string, split string, query_index long, sample_index long, line string"


def _text(v):
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _plain(row, subset):
    steps = []
    for i, m in enumerate(row["messages"]):
        if m["role"] == "system":
            continue
        step = {"id": f"m{i}", "kind": {"user": "task", "assistant": "assistant", "tool": "tool_result"}[m["role"]], "content": _text(m.get("content") or ""), "tool": None, "call_id": None}
        if m["role"] == "tool":
            step["tool"], step["call_id"] = m.get("name") or None, m.get("tool_call_id") or None
        steps.append(step)
        if m["role"] == "assistant":
            for j, c in enumerate(m.get("tool_calls") or []):
                steps.append({"id": f"m{i}-call{j}", "kind": "tool_call", "content": _text(c["function"].get("arguments", "")), "tool": c["function"]["name"], "call_id": c.get("id") or f"m{i}-call{j}"})
    return f"{subset}-{row['query_index']}-{row['sample_index']}", _text(row.get("question") or "Conversation task"), steps


VALUES = ["", "plain", "é ü\n\"q\" \\ 漢", "{\"a\": 1}", None, 0, 1, -2.5, 1e3, 12345678901234567890, True, False, [], {}, [1, "x", None], {"z": {"y": [1.5, "é"]}, "a": None, "z2": ""}]


def _made(n, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        messages = []
        for _ in range(rng.randint(1, 7)):
            m = {"role": rng.choice(["user", "assistant", "assistant", "tool", "system"])}
            if rng.random() < 0.9:
                m["content"] = rng.choice(VALUES)
            if rng.random() < 0.4:
                m |= {"name": rng.choice(["", "get", None]), "tool_call_id": rng.choice(["", "k1", None])}
            if rng.random() < 0.5:
                m["tool_calls"] = rng.choice([None, [], [{"id": rng.choice(["", None, "k1"]), "function": {"name": "get"} | rng.choice([{}, {"arguments": rng.choice(VALUES)}])} for _ in range(rng.randint(1, 3))]])
            messages.append(m)
        row = {"query_index": k, "sample_index": 0, "messages": messages, "step_labels": {}}
        if rng.random() < 0.8:
            row["question"] = rng.choice(VALUES)
        out.append(row)
    return out


def _frame(spark, rows, split="train", **dump):
    return spark.createDataFrame([("s", f"s:{r['query_index']}", split, r["query_index"], r["sample_index"], json.dumps(r, **dump)) for r in rows], ROWS)


@pytest.mark.parametrize("ascii_only", [True, False])
def test_typed_values(spark, ascii_only):
    rows = _made(150)
    df = _frame(spark, rows, ensure_ascii=ascii_only)
    want = {run: (task, steps) for run, task, steps in (_plain(r, "s") for r in rows)}
    assert {r.run_id: r.task for r in trajectory.runs_of(df).collect()} == {k: v[0] for k, v in want.items()}
    got = {}
    for r in sorted(features.adapt(trajectory.messages_of(df)).collect(), key=lambda r: (r.run_id, r.pos)):
        got.setdefault(r.run_id, []).append({c: r[c] for c in ("id", "kind", "content", "tool", "call_id")})
    assert got == {k: v[1] for k, v in want.items() if v[1]}
    assert trajectory.messages_of(df.limit(0)).count() == 0


def test_repeated_keys(spark):
    line = '{"query_index":1,"sample_index":0,"messages":[{"role":"user","content":"a","content":"b"},{"role":"assistant","content":"c"}]}'
    got = trajectory.messages_of(spark.createDataFrame([("s", "s:1", "train", 1, 0, line)], ROWS)).orderBy("msg_index").collect()
    assert [(r.role, r.content) for r in got] == [("user", ""), ("assistant", "c")]


def test_targets(spark):
    m = [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "assistant", "content": "c"}]
    labels = {"1": -1, "3": 1, "0": 1, "7": 0, " 2": 1, "2": 1, "-1": 0, "1_": 1}
    rows = [{"query_index": 1, "sample_index": 0, "messages": m, "step_labels": labels}, {"query_index": 2, "sample_index": 0, "messages": m, "step_labels": {"1": 2, "2": True, "0": "1", "10": 1}}, {"query_index": 3, "sample_index": 0, "messages": m, "step_labels": None}]
    df = _frame(spark, rows)
    got = {(r.run_id[2], r.key): (r.reason, r.target) for r in trajectory.targets(trajectory.labels_of(df), trajectory.messages_of(df)).collect()}
    assert got == {
        ("1", "1"): (None, True), ("1", "3"): (None, False), ("1", "0"): ("label-role", False), ("1", "7"): ("label-index", False), ("1", " 2"): ("label-repeated", False), ("1", "2"): ("label-repeated", False),
        ("1", "-1"): ("label-index", False), ("1", "1_"): ("label-index", False), ("2", "1"): ("label-value", False), ("2", "2"): ("label-value", False), ("2", "0"): ("label-role", False), ("2", "10"): ("label-index", False),
    }


def test_samples(spark):
    call = [{"id": "k", "function": {"name": "get", "arguments": {}}}]
    m = [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a", "tool_calls": call}, {"role": "assistant", "content": "é"}, {"role": "tool", "content": "failed", "tool_call_id": "k"}, {"role": "assistant", "content": "c"}]
    rows = [{"query_index": 1, "sample_index": 0, "messages": m, "step_labels": {"1": -1, "2": 0, "4": 1}, "ground_truth": "poison"}]
    got = sorted(trajectory.samples(_frame(spark, rows)).collect(), key=lambda r: r.msg_index)
    assert [(r.msg_index, r.label, r.rule, r.support_reason) for r in got] == [(1, -1, True, None), (2, 0, False, "unsupported-unicode")]
    assert got[0].text == "user u\nassistant a\nget {}"
    with pytest.raises(Exception, match="TEST"):
        trajectory.samples(_frame(spark, rows, "test")).collect()
    cells = {(r.split, r.label, r.subset): (r.steps, r.reasons) for r in policy.full_coverage(trajectory.samples(_frame(spark, rows))).collect()}
    assert len(cells) == 8 and cells["train", 1, "s"] == (0, {}) and cells["train", 0, None] == (1, {"unsupported-unicode": 1})


def test_incompatible(spark):
    from stepaudit.operators import envelope

    def run(q, n, text="c", **call):
        m = [{"role": "user", "content": text}, *[{"role": "assistant", "content": "a"} for _ in range(n)]]
        if call:
            m[1]["tool_calls"] = [{"function": {"name": "get", "arguments": ""} | call}]
        return {"query_index": q, "sample_index": 0, "messages": m, "step_labels": {"1": 0}}

    many = {"query_index": 8, "sample_index": 0, "messages": [{"role": "user", "content": "é" * 60_000}, *[{"role": "assistant", "content": "é" * 50_000} for _ in range(21)]], "step_labels": {"1": 0}}
    rows = [run(1, 2), run(2, 2000), run(3, 2, "x" * 100_001), run(4, 2, name=""), run(5, 2, name="n" * 201), run(6, 1999), run(7, 2, "🙂" * 50_000), many]
    df = _frame(spark, rows, ensure_ascii=False)
    found = {r.run_id: r.reason for r in envelope.incompatible(trajectory.messages_of(df), trajectory.runs_of(df)).collect()}
    assert found == {"s-2-0": "group-count", "s-3-0": "step-text", "s-4-0": "step-option", "s-5-0": "step-option", "s-8-0": "too-large"}
    got = {r.run_id: r.support_reason for r in trajectory.samples(df).collect()}
    assert {k: v for k, v in got.items() if v} == {k: "incompatible-envelope" for k in found} | {"s-7-0": "unsupported-unicode"}


def test_split_json(spark, tmp_path):
    import hashlib

    from stepaudit.operators import report
    from stepaudit.sources import files

    split = spark.createDataFrame([("a:1", "train"), ("a:2", "validation"), ("a:3", "test"), ("a:1", "train")], "grp string, split string")
    listed = spark.createDataFrame([("a.jsonl", "0" * 64)], "file string, sha256 string")
    raw = report.split_json(split, listed, 42)
    (tmp_path / "split.json").write_text(raw)
    back, present = files.read_manifest(spark, str(tmp_path / "split.json"), hashlib.sha256(raw.encode()).hexdigest(), 3)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in split.collect()} and present.count() == 1
    with pytest.raises(ValueError):
        report.split_json(split.union(spark.createDataFrame([("a:1", "test")], split.schema)), listed, 42)
