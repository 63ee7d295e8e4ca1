"""JSON lines that are verified while they are read, and a sink that shows all of its files or none.

``verified_jsonl`` is a data source over byte ranges. A first pass streams every file once, in
constant memory: its whole digest must be the manifest's, and it leaves the digest of every range
(cut after a line, of about ``range_bytes``). Each range is then a partition of its own, so that a file
of any size is split; a partition hashes its bytes again before it gives a row, so bytes that changed
in between raise. Only the routing keys of a line are decoded in the reader; with a filter on
``split`` pushed down, rows of the other splits never leave it, and their payloads are never parsed.

``committed_jsonl`` is a sink of rows ``folder, file, line``. Tasks write to a staging folder and
report names, rows and digests; the commit moves what the reported attempts wrote and then writes the
manifest, without which :func:`read_committed` sees nothing. A failed job leaves no manifest, and a
rerun of a publication that is there already changes nothing.

Files are reached by ``pyarrow.fs``: local and shared folders, or any URI that it knows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, Not, WriterCommitMessage

from stepaudit.session import ship

RANGE_BYTES, BATCH_BYTES, BLOCK = 64 << 20, 4 << 20, 1 << 20
ROUTED = "file string, subset string, grp string, split string, query_index bigint, sample_index bigint, question string, line string"
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]|[^\s{}\[\],:"]+')
_ROUTE = {'"query_index"': "query_index", '"sample_index"': "sample_index", '"question"': "question"}


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def routing(line: str) -> dict:
    """The top-level routing keys of one JSON object; other values are stepped over, not decoded. The last of equal keys counts."""
    out: dict = {}
    depth, key, before = 0, None, ""
    for m in _TOKEN.finditer(line):
        t = m.group()
        if t in "{[":
            depth += 1
        elif t in "}]":
            depth -= 1
        elif depth == 1 and t == ":":
            key = _ROUTE.get(before)
        elif depth == 1 and t == ",":
            key = None
        elif depth == 1 and key and before == ":":
            out[key] = json.loads(t)
        before = t
    return out


def _ranges(size: int):
    """For each file: its digest, and ranges that end with a line, with their digests and numbers of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(batch["file"].to_pylist(), batch["path"].to_pylist(), strict=True):
                whole, part = hashlib.sha256(), hashlib.sha256()
                rows, start, at, lines, last = [], 0, 0, 0, b"\n"
                system, name = located(path)
                with system.open_input_stream(name) as f:
                    while block := f.read(BLOCK):
                        whole.update(block)
                        while block:
                            cut = block.find(b"\n", max(0, size - 1 - (at - start))) + 1 if at + len(block) - start >= size else 0
                            own, block = (block[:cut], block[cut:]) if cut else (block, b"")
                            part.update(own)
                            at, lines, last = at + len(own), lines + own.count(b"\n"), own[-1:]
                            if cut:
                                rows.append((start, at, part.hexdigest(), lines))
                                start, lines, part = at, 0, hashlib.sha256()
                if at > start or not rows:
                    rows.append((start, at, part.hexdigest(), lines + (last != b"\n")))
                n = len(rows)
                columns = [pa.array([file] * n), pa.array([path] * n), pa.array([whole.hexdigest()] * n), *(pa.array(c) for c in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "path", "sha256", "start", "stop", "part", "lines"])

    return run


def byte_ranges(spark: SparkSession, paths: dict[str, str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, path, sha256, start, stop, part, lines`` of every range of the files named; one task a file, one pass, constant memory."""
    ship(spark)
    listed = spark.createDataFrame(sorted(paths.items()) or [], "file string, path string").repartition(max(1, len(paths)), "file")
    return listed.mapInArrow(_ranges(range_bytes), "file string, path string, sha256 string, start bigint, stop bigint, part string, lines bigint")


class _Range(InputPartition):
    def __init__(self, *value):
        super().__init__(value)


class VerifiedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.ranges, self.groups = json.loads(options["ranges"]), json.loads(options["groups"])
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests of ``split`` against constants; all others stay with Spark."""
        every = set(self.groups.values())
        for f in filters:
            test = f.child if isinstance(f, Not) else f
            if not isinstance(test, (EqualTo, In, IsNotNull)) or test.attribute != ("split",):
                yield f
                continue
            named = every if isinstance(test, IsNotNull) else set(test.value) if isinstance(test, In) else {test.value}
            self.wanted = (every if self.wanted is None else self.wanted) & (every - named if isinstance(f, Not) else named)

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in self.ranges] or [_Range("", "", 0, 0, "")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file, path, start, stop, digest = partition.value
        schema = pa.schema([pa.field(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in ROUTED.split(", ")])
        if stop <= start:
            return
        system, name = located(path)
        with system.open_input_file(name) as f:
            f.seek(start)
            data = f.read(stop - start)
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"{file}: bytes {start} to {stop} changed while they were read")
        subset = file.removesuffix(".jsonl")
        rows, held = [], 0
        for raw in data.split(b"\n"):
            if not raw.strip():
                continue
            line = raw.decode()
            r = routing(line)
            query, sample = r.get("query_index"), r.get("sample_index")
            if type(query) is not int or type(sample) is not int:
                raise ValueError(f"{file}: a line without integer routing ids")
            group = f"{subset}:{query}"
            split = self.groups.get(group)
            if split is None:
                raise ValueError(f"{file}: a row of an unknown group")
            if self.wanted is not None and split not in self.wanted:
                continue
            question = r.get("question")
            rows.append((file, subset, group, split, query, sample, question if isinstance(question, str) else None, line))
            held += len(raw)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class VerifiedJsonl(DataSource):
    @classmethod
    def name(cls) -> str:
        return "verified_jsonl"

    def schema(self) -> str:
        return ROUTED

    def reader(self, schema) -> VerifiedReader:
        return VerifiedReader(self.options)


def routed_rows(spark: SparkSession, paths: dict[str, str], groups: dict[str, str], digests: dict[str, str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All rows of verified files by their routing keys (``ROUTED``); a filter on ``split`` is done in the reader.

    ``groups`` (group to split) and ``digests`` (file to SHA-256) are the manifest's, small by contract.
    A file too many, too few or of another digest raises before any row is read; so does, when it is read,
    a row of an unknown group, one without integer ids, and a range whose bytes have changed.
    """
    if set(paths) != set(digests):
        raise ValueError("the folder's files are not those of the manifest")
    found = byte_ranges(spark, paths, range_bytes).collect()  # a row a range, as the scan's partitions are
    for r in found:
        if r.sha256 != digests[r.file]:
            raise ValueError(f"{r.file}: digest")
    spark.dataSource.register(VerifiedJsonl)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ranges = json.dumps([(r.file, r.path, r.start, r.stop, r.part) for r in found])
    return spark.read.format("verified_jsonl").option("ranges", ranges).option("groups", json.dumps(groups)).load()


class _Done(WriterCommitMessage):
    def __init__(self, staged: str, files: list[dict]):
        self.staged, self.files = staged, files


class CommittedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.id = options["path"].rstrip("/"), options["publication"]

    def write(self, iterator: Iterator[Row]) -> _Done:
        system, top = located(self.path)
        staged = f"{top}/.staging-{self.id}/{uuid.uuid4().hex}"
        held: dict = {}
        for r in iterator:
            name = f"{r.folder}/{r.file or 'part-' + staged[-32:] + '.jsonl'}"
            if name not in held:
                system.create_dir(f"{staged}/{r.folder}", recursive=True)
                held[name] = [system.open_output_stream(f"{staged}/{name}"), hashlib.sha256(), 0, 0]
            raw = r.line.encode() + b"\n"
            held[name][0].write(raw)
            held[name][1].update(raw)
            held[name][2] += 1
            held[name][3] += len(raw)
        for h in held.values():
            h[0].close()
        return _Done(staged, [{"name": k, "sha256": h[1].hexdigest(), "rows": h[2], "bytes": h[3]} for k, h in sorted(held.items())])

    def commit(self, messages: list[_Done | None]) -> None:
        system, top = located(self.path)
        if not _published(system, top, self.id):
            files = [(m.staged, f) for m in messages if m for f in m.files]
            names = [f["name"] for _, f in files]
            if len(set(names)) != len(names):
                self.abort(messages)
                raise ValueError("a file has rows in two tasks")
            # What a commit that broke off has moved is replaced; without a manifest nobody has seen it.
            if system.get_file_info(f"{top}/{self.id}").type != pafs.FileType.NotFound:
                system.delete_dir(f"{top}/{self.id}")
            for staged, f in files:
                system.create_dir(f"{top}/{self.id}/{f['name'].rsplit('/', 1)[0]}", recursive=True)
                system.move(f"{staged}/{f['name']}", f"{top}/{self.id}/{f['name']}")
            body = "\n".join(json.dumps(f, sort_keys=True) for f in sorted((f for _, f in files), key=lambda f: f["name"]))
            with system.open_output_stream(f"{top}/.staging-{self.id}/manifest") if files else _empty(system, f"{top}/.staging-{self.id}") as out:
                out.write(body.encode())
            system.move(f"{top}/.staging-{self.id}/manifest", f"{top}/manifest-{self.id}.json")
        self.abort(messages)

    def abort(self, messages: list[_Done | None]) -> None:
        system, top = located(self.path)
        if system.get_file_info(f"{top}/.staging-{self.id}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{top}/.staging-{self.id}")


def _empty(system: pafs.FileSystem, folder: str):
    system.create_dir(folder, recursive=True)
    return system.open_output_stream(f"{folder}/manifest")


def _published(system: pafs.FileSystem, top: str, publication: str) -> bool:
    """Whether this publication is there; another one in the same folder raises."""
    seen = [f.base_name for f in system.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if re.fullmatch(r"manifest-.*\.json", f.base_name)]
    if seen and f"manifest-{publication}.json" not in seen:
        raise ValueError("the output must be new")
    return bool(seen)


class CommittedJsonl(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_jsonl"

    def schema(self) -> str:
        return "folder string, file string, line string"

    def writer(self, schema, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options)


def write_committed(rows: DataFrame, path: str, publication: str) -> None:
    """Publish ``folder, file, line`` (file null: one a task) under ``path`` in one job, all or nothing.

    The same publication again changes nothing; another one into the same folder raises, and so does
    a named file whose rows are in two tasks (deal the rows by the file first). Lines must not be null.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", publication):
        raise ValueError("a publication is named by letters, digits, _ and -")
    spark = ship(rows.sparkSession)
    spark.dataSource.register(CommittedJsonl)
    if _published(*located(path.rstrip("/")), publication):
        return
    rows.select("folder", "file", "line").write.format("committed_jsonl").option("path", path).option("publication", publication).mode("append").save()


def committed_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, sha256, rows, bytes, at`` of the files of the publication under ``path``; none without a manifest."""
    system, top = located(path.rstrip("/"))
    seen = [f for f in system.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if re.fullmatch(r"manifest-.*\.json", f.base_name)]
    schema = "name string, sha256 string, rows bigint, bytes bigint"
    if not seen:
        return spark.createDataFrame([], f"{schema}, at string")
    publication = seen[0].base_name[len("manifest-") : -len(".json")]
    listed = spark.read.schema(schema).json(f"{path.rstrip('/')}/{seen[0].base_name}")
    return listed.withColumn("at", F.concat(F.lit(f"{path.rstrip('/')}/{publication}/"), "name"))


def read_committed(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """``file, value``: the lines of one folder of a publication; only files that its manifest names."""
    at = [r["at"] for r in committed_files(spark, path).where(F.col("name").startswith(f"{folder}/")).collect()]
    if not at:
        return spark.createDataFrame([], "file string, value string")
    return spark.read.text(at).select(F.col("_metadata.file_name").alias("file"), "value")
