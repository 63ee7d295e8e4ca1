"""Verified byte ranges, and the sink that publishes all or nothing."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, IsNotNull, Not

from stepaudit.sources import files, verified


def _sha(p):
    return hashlib.sha256(p.read_bytes()).hexdigest()


def _folder(tmp_path, lines):
    data = tmp_path / "data"
    data.mkdir()
    (data / "set.jsonl").write_bytes(lines)
    return data, {"set.jsonl": _sha(data / "set.jsonl")}


def _line(q, text="t"):
    return json.dumps({"note": {"query_index": 99}, "query_index": q, "sample_index": 0, "question": text, "messages": [{"role": "user", "content": text}]}, ensure_ascii=False)


GROUPS = {f"set:{k}": ("train", "validation", "test")[k % 3] for k in range(60)}


def test_ranges(spark, tmp_path):
    lines = [_line(k, 'q "é" \\ {[' * (k % 9)) for k in range(60)]
    data, digests = _folder(tmp_path, ("\n".join(lines[:30]) + "\n\n" + "\n".join(lines[30:])).encode())
    paths = {"set.jsonl": str(data / "set.jsonl")}
    for size in (1, 100, 1000, 10**6):
        found = sorted(verified.byte_ranges(spark, paths, size).collect(), key=lambda r: r.start)
        raw = (data / "set.jsonl").read_bytes()
        assert [r.start for r in found[1:]] == [r.stop for r in found[:-1]] and (found[0].start, found[-1].stop) == (0, len(raw))
        for r in found:
            own = raw[r.start : r.stop]
            assert r.part == hashlib.sha256(own).hexdigest() and (own.endswith(b"\n") or r.stop == len(raw)) and r.lines == len(own.rstrip(b"\n").split(b"\n")) + (own.endswith(b"\n\n"))
            assert own[: max(size - 1, 0)].count(b"\n") == own.count(b"\n") - 1 or r.stop == len(raw) or size > 100
    routed = verified.routed_rows(spark, paths, GROUPS, digests, 1000)
    rows = routed.collect()
    assert routed.rdd.getNumPartitions() > 3 and {r.query_index: r.line for r in rows} == dict(enumerate(lines))
    assert all(r.question == json.loads(r.line)["question"] for r in rows)
    kept = routed.where("split != 'test'")
    assert {r.split for r in kept.collect()} == {"train", "validation"} and kept.count() == 40
    assert files.row_at(spark, paths["set.jsonl"], 3) == lines[3] and files.row_at(spark, paths["set.jsonl"], 60) == lines[59]


def test_test_rows_are_not_parsed(spark, tmp_path):
    """A TEST row whose payload is no JSON value does not matter; another's does."""
    bad = '{"query_index": 2, "sample_index": 0, "messages": [nonsense]}'
    data, digests = _folder(tmp_path, f"{_line(1)}\n{bad}\n".encode())
    reader = verified.VerifiedReader({"ranges": json.dumps([(r.file, r.path, r.start, r.stop, r.part) for r in verified.byte_ranges(spark, {"set.jsonl": str(data / 'set.jsonl')}).collect()]), "groups": json.dumps(GROUPS)})
    left = list(reader.pushFilters([Not(EqualTo(("split",), "test")), IsNotNull(("split",)), EqualTo(("grp",), "set:1")]))
    assert left == [EqualTo(("grp",), "set:1")] and reader.wanted == {"train", "validation"}
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]
    split = spark.createDataFrame(list(GROUPS.items()), "grp string, split string")
    listed = spark.createDataFrame(list(digests.items()), "file string, sha256 string")
    assert [r.grp for r in files.read_verified(spark, str(data), split, listed).collect()] == ["set:1"]
    (data / "set.jsonl").write_text(bad.replace('"query_index": 2', '"query_index": 1') + "\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_verified(spark, str(data), split, spark.createDataFrame([("set.jsonl", _sha(data / "set.jsonl"))], "file string, sha256 string")).collect()


@pytest.mark.parametrize("line, said", [('{"query_index": 1}', "routing ids"), ('{"query_index": true, "sample_index": 0}', "routing ids"), ('{"query_index": 77, "sample_index": 0}', "unknown group")])
def test_bad_rows(spark, tmp_path, line, said):
    data, digests = _folder(tmp_path, f"{line}\n".encode())
    with pytest.raises(Exception, match=said):
        verified.routed_rows(spark, {"set.jsonl": str(data / "set.jsonl")}, GROUPS, digests).collect()


def test_changed_bytes(spark, tmp_path):
    data, digests = _folder(tmp_path, f"{_line(1)}\n{_line(4)}\n".encode())
    paths = {"set.jsonl": str(data / "set.jsonl")}
    with pytest.raises(ValueError, match="digest"):
        verified.routed_rows(spark, paths, GROUPS, {"set.jsonl": "0" * 64})
    with pytest.raises(ValueError, match="manifest"):
        verified.routed_rows(spark, paths, GROUPS, digests | {"more.jsonl": "0" * 64})
    routed = verified.routed_rows(spark, paths, GROUPS, digests)
    assert routed.count() == 2
    (data / "set.jsonl").write_text(f"{_line(1)}\n{_line(4, 'u')}\n")
    with pytest.raises(Exception, match="changed"):
        routed.collect()


def test_publication(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("folder"), F.lit(None).cast("string").alias("file"), F.concat(F.lit("é"), "id").alias("line")).repartition(4)
    broken = rows.withColumn("line", F.when(F.col("line") == "é42", F.raise_error(F.lit("no line")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no line"):
        verified.write_committed(broken, path, "one")
    assert verified.committed_files(spark, path).count() == 0 and verified.read_committed(spark, path, "a").count() == 0
    for _ in range(2):  # the second changes nothing
        verified.write_committed(rows, path, "one")
        listed = verified.committed_files(spark, path).collect()
        assert sum(r["rows"] for r in listed) == 100 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["manifest-one.json", "one"]
    for r in listed:
        assert _sha(tmp_path / "out" / "one" / r["name"]) == r.sha256
    assert {r.value for r in verified.read_committed(spark, path, "a").collect()} == {f"é{k}" for k in range(0, 100, 3)}
    with pytest.raises(ValueError, match="new"):
        verified.write_committed(rows, path, "two")
    named = rows.withColumn("file", F.lit("all.jsonl"))
    with pytest.raises(Exception, match="two tasks"):
        verified.write_committed(named, str(tmp_path / "named"), "one")
    verified.write_committed(named.coalesce(1), str(tmp_path / "named"), "one")
    assert [r["name"] for r in verified.committed_files(spark, str(tmp_path / "named")).orderBy("name").collect()] == ["a/all.jsonl", "b/all.jsonl"]
    verified.write_committed(rows.limit(0), str(tmp_path / "none"), "one")
    assert verified.read_committed(spark, str(tmp_path / "none"), "a").count() == 0
