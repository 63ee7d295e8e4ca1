"""Sources, sinks, fits and gates that need files, models or processes."""

import hashlib
import json
import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepaudit import governance
from stepaudit.functions import texts
from stepaudit.operators import envelope, features, report, semantic, tfidf
from stepaudit.plans import cases
from stepaudit.session import ARROW_BYTES, ship
from stepaudit.sources import files, verified


def _sha(path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_run_files(spark, tmp_path):
    good = cases._RUN
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"task": "x" * (2 * 1024 * 1024)}))
    (tmp_path / "c.json").write_bytes(b'{"a": "\xff"}')
    (tmp_path / "d.json").write_text("{")
    got = {r.file[-6:]: r.reason for r in files.read_runs(spark, f"{tmp_path}/*.json").collect()}
    assert got == {"a.json": None, "b.json": "too-large", "c.json": "not-utf8", "d.json": "not-an-object"}


def test_shipped_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(b)], pa.int64()), "size": pa.array([b.nbytes], pa.int64())})

    ship(spark)
    long, row = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS t"), 10_000
    got = long.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.size for r in got) <= ARROW_BYTES + 2 * row
    whole = spark.range(0, 3, 1, 1).selectExpr(f"repeat('x', {2 * ARROW_BYTES}) AS t").mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in whole) == 3  # a row beyond the bound is kept whole


def _row(q, s, text="why", **more):
    m = [{"role": "user", "content": text}, {"role": "assistant", "content": "a"}, {"role": "assistant", "content": "b"}]
    return {"query_index": q, "sample_index": s, "question": text, "step_labels": {"1": -1}, "messages": m} | more


def test_verified_folder(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    rows = [_row(1, 0), _row(2, 0, "two", ground_truth="poison"), _row(3, 0, "three", messages=None, step_labels=None)]
    (data / "set.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    m = {"seed": 1, "groups": {"set:1": "train", "set:2": "validation", "set:3": "test"}, "source_sha256": {"set.jsonl": _sha(data / "set.jsonl")}}
    (tmp_path / "split.json").write_text(json.dumps(m))
    split, listed = files.read_manifest(spark, str(tmp_path / "split.json"), _sha(tmp_path / "split.json"), 3)
    got = files.read_verified(spark, str(data), split, listed)
    assert {(r.grp, r.split, r.subset) for r in got.collect()} == {("set:1", "train", "set"), ("set:2", "validation", "set")}
    assert "ground_truth" not in got.columns
    plain = files.read_jsonl(spark, str(data))
    assert plain.count() == 3 and {r.grp for r in plain.select("grp").collect()} == set(m["groups"])
    assert json.loads(files.row_at(spark, str(data / "set.jsonl"), 2))["query_index"] == 3
    for bad in (-1, 3, 9):
        with pytest.raises(ValueError):
            files.row_at(spark, str(data / "set.jsonl"), bad)
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "split.json"), "0" * 64)
    (data / "more.jsonl").write_text("")
    with pytest.raises(ValueError):
        files.read_verified(spark, str(data), split, listed)
    (data / "more.jsonl").unlink()
    (data / "set.jsonl").write_text(json.dumps(_row(1, 1)) + "\n")
    with pytest.raises(ValueError):
        files.read_verified(spark, str(data), split, listed)
    (data / "link.jsonl").symlink_to(data / "set.jsonl")
    with pytest.raises(ValueError):
        files.refuse_links(str(data))


def test_models(spark, tmp_path):
    rows = [(w, 1 + k / 10, *[math.sin(k + j) for j in range(3)]) for k, w in enumerate(["a b", "bb", "cc"])]
    schema = "term string, idf double, w0 double, w1 double, w2 double"
    raw = files.model_json(spark.createDataFrame(rows, schema), [0.1, -0.2, 0.3], 0.7)
    (tmp_path / "m.json").write_text(raw)
    model, b, t = files.read_model(spark, str(tmp_path / "m.json"), _sha(tmp_path / "m.json"), len(raw), 0.7)
    assert sorted(model.collect()) == sorted(spark.createDataFrame(rows, schema).collect()) and (b, t) == ([0.1, -0.2, 0.3], 0.7)
    for sha, size, cut in [("0" * 64, None, None), (None, 3, None), (None, None, 0.5)]:
        with pytest.raises(ValueError):
            files.read_model(spark, str(tmp_path / "m.json"), sha, size, cut)
    good = json.loads(raw)
    h = "a" * 64
    assert files.check_model(json.dumps(good | {"provenance": {"kind": "train-validation", "source_hashes": [h], "split_sha256": h}}))
    for change in [
        {"x": 1}, {"artifact_version": 2}, {"classes": [0, 1, -1]}, {"threshold": 0.55}, {"vocabulary": ["bb", "bb", "cc"]}, {"vocabulary": ["", "bb", "cc"]}, {"vocabulary": ["x" * 201, "b", "c"]}, {"idf": [0.5, 1, 1]},
        {"idf": [1, 1]}, {"coefficients": good["coefficients"][:2]}, {"coefficients": [[1001, 0, 0]] * 3}, {"intercept": [0, 0, float("nan")]}, {"intercept": [True, 0, 0]}, {"provenance": {"kind": "synthetic", "source_hashes": [h], "split_sha256": None}},
        {"provenance": {"kind": "train-validation", "source_hashes": [], "split_sha256": h}}, {"provenance": {"kind": "train-validation", "source_hashes": [h], "split_sha256": "A" * 64}},
    ]:
        with pytest.raises(ValueError):
            files.check_model(json.dumps(good | change))
    with pytest.raises(ValueError):
        tfidf.score(spark.createDataFrame([(1, "bb")], "doc_id int, text string"), spark.range(20_001).selectExpr("string(id) term", "1d idf", "0d w0", "0d w1", "0d w2"), [0, 0, 0], 0.5)


def _reference_score(model, text, b):
    words = re.findall("[a-z0-9_]{2,}", text.lower())
    n = Counter(words) + Counter(map(" ".join, zip(words, words[1:])))
    v = {t: (1 + math.log(n[t])) * idf for t, idf, *_ in model if n[t]}
    norm = math.sqrt(sum(x * x for x in v.values()))
    z = [b[k] + sum(v[t] * w[k] for t, _, *w in model if t in v) / norm for k in range(3)]
    e = [math.exp(x - max(z)) for x in z]
    return e[0] / sum(e)


def test_scores_of_repeated_ids(spark):
    model = [("aa", 1.2, 0.5, -0.1, 0.2), ("bb", 1.5, -0.7, 0.3, 0.1), ("aa bb", 2.0, 1.0, 0.0, -1.0)]
    rows = [(1, "aa bb aa"), (1, "bb"), (1, "bb"), (2, None), (None, "aa"), (3, "aa é"), (4, "zz")]
    got = tfidf.score(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(model, "term string, idf double, w0 double, w1 double, w2 double"), [0.1, 0.2, 0.0], 0.9)
    want = [(1, "aa bb aa"), (1, "bb"), (1, "bb"), (None, "aa")]
    have = sorted((str(r.doc_id), round(r.score, 12)) for r in got.collect() if r.score is not None)
    assert have == sorted((str(k), round(_reference_score(model, t, [0.1, 0.2, 0.0]), 12)) for k, t in want)
    assert {r.doc_id: r.reason for r in got.collect() if r.score is None} == {2: "no-known-features", 3: "unsupported-unicode", 4: "no-known-features"}
    docs = spark.createDataFrame([(1, "aa aa"), (1, "aa")] * 2, "doc_id int, text string")
    assert [(r.df, r.cf) for r in tfidf.vocabulary(docs).where("term = 'aa'").collect()] == [(4, 6)]


def test_train(spark):
    rng = random.Random(1)
    own = {-1: ["broken", "lost"], 0: ["maybe", "look"], 1: ["done", "right"]}
    rows = [(k, " ".join(rng.choices(own[y] + ["the", "step"], k=8)), y) for k in range(90) for y in [k % 3 - 1]]
    model, b = tfidf.train(spark.createDataFrame(rows, "id int, text string, label int"))
    got = tfidf.score(spark.createDataFrame(rows, "doc_id int, text string, label int"), model, b, 0.5)
    right = sum((r.p0, r.p1, r.p2).index(max(r.p0, r.p1, r.p2)) == r.doc_id % 3 for r in got.collect())
    assert right >= 85 and files.check_model(files.model_json(model, b, 0.5))


def test_roles_and_calls(spark):
    call = [("k", ("get", "{}")), (None, (None, None))]
    schema = "run_id string, msg_index int, role string, content string, tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>"
    rows = [("a", 0, "user", "u", call), ("a", 1, "assistant", "x", call), ("a", 2, "assistant", "<answer>z</answer>", None), ("b", 0, "robot", "u", None), ("b", 1, "assistant", "x", None), ("c", 0, "system", "s", None)]
    m = spark.createDataFrame(rows, schema)
    assert [(r.run_id, r.id, r.kind, r.call_id) for r in features.adapt(m).orderBy("run_id", "pos").collect()] == [
        ("a", "m0", "task", None), ("a", "m1", "assistant", None), ("a", "m1-call0", "tool_call", "k"), ("a", "m1-call1", "tool_call", "m1-call1"), ("a", "m2", "assistant", None)
    ]
    assert [tuple(r) for r in features.unsupported(m).collect()] == [("b", 0, "unsupported-role")]
    assert [r.id for r in features.adapt(m, exclude_final=True).orderBy("pos").collect()] == ["m0", "m1", "m1-call0", "m1-call1"]
    assert [r.feature for r in features.prefix_features(m).where("run_id = 'a'").collect()] == ["user u\nget {}\n \nassistant x\nget {}\n "]  # calls of any role with text
    built = {(r.run_id, r.msg_index): (r.role, r.step_ids) for r in envelope.build(m).collect()}
    assert built == {("a", 0): ("user", ["m0"]), ("a", 1): ("assistant", ["m1", "m1-call0", "m1-call1"]), ("a", 2): ("assistant", ["m2"]), ("c", 0): ("excluded", [])}


def test_envelope_actions(spark):
    df = spark.createDataFrame([(json.dumps(cases._ENV),)], "raw string")
    got = envelope.actions(envelope.groups_of(df)).collect()
    assert [(r.msg_index, r.pos, r.feature, r.context) for r in got] == [(2, 2, "user c\nassistant [answer omitted] go\nget {}", "<answer>no</answer> go\nget {}")]


def test_notes_and_sinks(spark, tmp_path):
    steps = spark.createDataFrame([("r", k + 1, s["id"], s["kind"], s["content"], s.get("tool"), s.get("call_id"), None) for k, s in enumerate(cases._ENV_STEPS)], cases.STEP_SCHEMA)
    made = report.reports(spark.createDataFrame([("r", "mail x@y.org")], "run_id string, task string"), steps)
    one = json.loads(made.first().report)
    assert one["redaction_count"] == 1 and one["run"]["task"] == "mail [REDACTED EMAIL]" and one["flags"] == [] and len(one["run"]["steps"]) == 5 and "call_id" not in one["run"]["steps"][0]
    groups = envelope.groups_of(spark.createDataFrame([(json.dumps(cases._ENV),)], "raw string"))
    scored = envelope.scored_actions(groups, spark.createDataFrame([("user", 1.0, 1.0, 0.0, 0.0)], "term string, idf double, w0 double, w1 double, w2 double"), [0.0] * 3, 0.5)
    note = json.loads(report.notes(made, scored, envelope.review_coverage(scored, groups)).first().notes)
    assert note["run"]["run_id"] == "r" and note["coverage"]["eligible"] == 1 and note["results"][0]["msg_index"] == 2 and "messages" not in note
    report.write_texts(made, str(tmp_path / "out"), "report")
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception, match="EXISTS|exists"):
        report.write_texts(made, str(tmp_path / "out"), "report")
    runs = spark.createDataFrame([("{}", None), ("[]", "not-an-object"), ("x" * (2 * 1024 * 1024 + 1), None)], "raw string, reason string")
    report.write_valid(runs, str(tmp_path / "conv"), "one")
    assert [r.value for r in verified.read_committed(spark, str(tmp_path / "conv"), "runs").collect()] == ["{}"]
    assert {json.loads(r.value)["reason"] for r in verified.read_committed(spark, str(tmp_path / "conv"), "quarantine").collect()} == {"not-an-object", "too-large"}
    assert json.loads(report.results_json({"t": made.select("run_id")})) == {"t": [{"run_id": "r"}]}
    report.attempt(str(tmp_path / "a.json"), {"s": 1})
    with pytest.raises(FileExistsError):
        report.attempt(str(tmp_path / "a.json"), {})


def test_publication(tmp_path):
    stage = tmp_path / "stage"
    stage.mkdir()
    (stage / "head.json").write_text("{}")
    pin = {"head.json": {"bytes": 2, "sha256": _sha(stage / "head.json")}}
    gate = {"selected_threshold": 0.7, "candidates": [{"threshold": 0.7, "eligible": True}]}
    used = {"exit_code": 0, "stop_reason": None, "elapsed_seconds": 3.0, "peak_kib": 1000}
    good = {"status": "completed", "fits": 1, "resource": used, "gate": gate, "files": pin}
    assert governance.publication_problems(good, gate, stage) == []
    assert governance.publication_problems(good | {"fits": 2}, gate, stage) and governance.publication_problems(good, gate | {"selected_threshold": 0.5}, stage)
    for bad in [{"exit_code": False}, {"exit_code": 1}, {"stop_reason": "wall"}, {"elapsed_seconds": 2211}, {"elapsed_seconds": float("nan")}, {"peak_kib": True}, {"peak_kib": -1}]:
        assert not governance.resources_ok(used | bad)
    assert not governance.resources_ok({k: v for k, v in used.items() if k != "stop_reason"})

    def check(path):
        if governance.publication_problems(good, gate, path):
            raise ValueError("not ready")

    report.publish(str(stage), str(tmp_path / "out"), check)
    assert (tmp_path / "out" / "head.json").exists() and not stage.exists()
    stage.mkdir()
    (stage / "head.json").write_text("[]")
    with pytest.raises(ValueError):
        report.publish(str(stage), str(tmp_path / "out"), check)
    with pytest.raises(ValueError):
        report.publish(str(stage), str(tmp_path / "out2"), check)
    assert not stage.exists() and not (tmp_path / "out2").exists()
    (tmp_path / "out" / "more").symlink_to(tmp_path / "out" / "head.json")
    assert governance.lock_problems(str(tmp_path / "out"), pin, {"numpy": "0"}) == ["unexpected more", "package numpy"]


def test_supervision():
    assert governance.supervise([sys.executable, "-c", "pass"], 20, 500_000)["exit_code"] == 0
    assert governance.supervise([sys.executable, "-c", "import time; time.sleep(30)"], 0.5, 500_000)["stop_reason"] == "wall"
    assert governance.supervise([sys.executable, "-c", "x = bytearray(200_000_000); import time; time.sleep(30)"], 20, 100_000)["stop_reason"] == "memory"
    with pytest.raises(ValueError):
        governance.supervise(["true"], 10_000, 1)
    with pytest.raises(PermissionError):
        governance.approved(1)
    import socket

    with governance.offline(), socket.socket() as s, pytest.raises(RuntimeError):
        s.connect(("192.0.2.1", 9))


def test_encode_and_head(spark):
    def load():
        def call(lists):
            v = np.array([[len(x), sum(x) + 1.0] for x in lists])
            return v / np.linalg.norm(v, axis=1, keepdims=True)

        return call

    rows = [("a", [1, 2], [3, 4, 5]), ("a", [1, 2], [3, 4, 5]), ("b", [9, 9, 9], [1, 1])]
    got = {r.k: r.pair for r in semantic.encode(spark.createDataFrame(rows, "k string, context array<int>, action array<int>"), "k", load, 2).collect()}
    assert set(got) == {"a", "b"} and got["a"][:2] == pytest.approx([2 / math.hypot(2, 4), 4 / math.hypot(2, 4)])
    with pytest.raises(Exception, match="2 to 256"):
        semantic.encode(spark.createDataFrame([("a", [1], [2, 3])], "k string, context array<int>, action array<int>"), "k", load, 2).collect()
    rng = random.Random(2)
    rows = [("train", y, None, [rng.random() + 3 * (y == j - 1) for j in range(3)]) for _ in range(20) for y in (-1, 0, 1)]
    schema = "split string, label int, support_reason string, pair array<float>"
    w, b = semantic.fit_head(spark.createDataFrame(rows, schema))
    assert all(int(np.argmax(w @ np.array(p) + b)) == y + 1 for _, y, _, p in rows)
    for bad in (rows + [("test", 0, None, [0.0] * 3)], [r for r in rows if r[1] != 0]):
        with pytest.raises(ValueError):
            semantic.fit_head(spark.createDataFrame(bad, schema))
    one = semantic.allocate(spark.range(1).select(*[F.sequence(F.lit(1), F.lit(n)).alias(c) for c, n in (("task", 100), ("prefix", 300), ("action_ids", 400))]), 101, 102).first()
    assert len(one.context) == 256 and len(one.action) == 256 and one.context[65:67] == [111, 112] and one.token_counts.action_ids.removed == 146 and all(one.truncated)


def test_calls_in_semantic_inputs(spark):
    long = "h" * 3000 + "t" * 3000
    call = [(None, ("n" * 130, long))] + [(None, ("get", "<answer>x</answer>"))] * 5
    schema = "run_id string, msg_index int, role string, content string, question string, tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>"
    rows = [("r", 0, "user", "u", "q", None), ("r", 1, "assistant", "x", "q", call), ("r", 2, "assistant", "last", "q", None)]
    got = semantic.prepare(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0].prefix == "user u" and got[0].call_count == 6 and len(got[0].calls) == 4 and got[0].name_overflow
    assert got[0].calls[0].arguments == "h" * 2000 + "t" * 2000 and len(got[0].calls[0].name) == 128 and got[0].calls[1].arguments == "[answer omitted]"
    assert got[0].audit.calls_removed == 2000 + 2
    changed = [r if r[1] != 2 else ("r", 2, "assistant", "poison", "q", call) for r in rows]
    assert semantic.prepare(spark.createDataFrame(changed, schema)).collect() == got


def test_texts():
    assert texts.json_text("null", falsy_is_empty=True) == "" and texts.json_text('{"a":[1,2]}') == '{"a": [1, 2]}' and texts.json_text(None) is None
    with pytest.raises(ValueError):
        texts.canonical_json('{"a": NaN}')
    assert texts.unicode_words("Ünder_1 a 漢字 x2") == ["ünder_1", "漢字", "x2"]


def test_differences(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in governance.differences(a, b).collect()) == [(1, "expected"), (3, "actual")]
    assert governance.differences(a, a).count() == 0
