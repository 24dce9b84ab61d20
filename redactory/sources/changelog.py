"""Logs of captured changes: a Spark data source for batches and streams, and a writer.

A log is a folder of segments, files of JSON lines that are named by the commit they begin in and
sorted by name. It holds transactions in the order of their commits: ``begin``, then inserts, updates, deletes
and truncations, then ``commit``; a ``relation`` record says what the columns of a table are from there on (one without a type is a
key alone). A segment's
first line repeats the relations in use and the open transaction, so that segments are read
alone, each by a task of its own.

Places in a stream are commits. A transaction appears only once its ``commit`` is in the log, whole and in one
micro-batch, whichever segments it is in; the last line of a segment that is still being written is left until
its end is there. So a query that is stopped in the middle of a transaction goes on without losing or repeating
a change.

Commits are any numbers but the least of 64 bits. Changes that name no commit are one transaction before all others, and are
read without one; a change may lack its action, place or key too.

Rows are :data:`events.EVENT`: an update has the columns that were sent, cells of types that are not scanned are
null, keys are text of any type. Deletions and truncations are rows without columns; :func:`events.changes` drops them.

Options: ``path``, ``database``, and ``maxSegmentsPerTrigger`` for a stream, which bounds how many segments a micro-batch
begins to read. The first micro-batch after a start has no such bound, since Spark does not tell a source of Python
where a query stands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .events import EVENT, NOT_SCANNED

#: Rows of a batch, and bytes read at a time in looking for commits.
ROWS, PIECE = 1000, 1 << 20
SUFFIX = ".jsonl"
#: What stands in a log for a commit that changes do not name, and the place before all commits.
NO_COMMIT = -(1 << 63)
START = NO_COMMIT - 1


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if not urlparse(folder).scheme:
        return fs.LocalFileSystem(), folder.rstrip("/")
    found, path = fs.FileSystem.from_uri(folder)
    return found, path.rstrip("/")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Hadoop takes for it: drivers and executors then mean the same place. On a cluster a ``file:`` one is a mounted folder.

    A folder of a view (``viewfs``) gets the name that it has in the store behind the view, which Arrow can open.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(hadoop)
    path = there = store.makeQualified(path)
    if path.toUri().getScheme() == "viewfs":
        while not store.exists(there):
            there = there.getParent()
        below = path.toUri().getPath()[len(there.toUri().getPath()) :].lstrip("/")
        path = jvm.org.apache.hadoop.fs.Path(store.resolvePath(there), below) if below else store.resolvePath(there)
    full = path.toUri()
    return f"file://{full.getPath()}" if full.getScheme() == "file" else full.toString()


@dataclass
class Segments:
    """The segments of a log: where each begins, and up to which commit they are whole."""

    folder: str
    done: dict[str, tuple[int, int]] = field(default_factory=dict)  # bytes looked at and last commit of a segment

    def names(self) -> list[str]:
        store, path = opened(self.folder)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(SUFFIX)), key=lambda n: (self.begins(n), n))

    @staticmethod
    def begins(name: str) -> int:
        return int(name.rsplit("-", 1)[0])

    def last_commit(self, names: list[str]) -> int:
        """The last commit in the named segments, ``START`` if there is none; only what was added since the last look is read."""
        store, path = opened(self.folder)
        for name in reversed(names):
            at, commit = self.done.get(name, (0, START))
            with store.open_input_file(f"{path}/{name}") as f:
                size, rest = f.size(), b""
                f.seek(at)
                while at + len(rest) < size:
                    *lines, rest = (rest + f.read(PIECE)).split(b"\n")
                    at += sum(len(x) + 1 for x in lines)
                    commit = max([commit, *(json.loads(x)["commit"] for x in lines if x.startswith(b'{"k":"commit"'))])
            self.done[name] = at, commit
            if commit > START:
                return commit
        return START

    def between(self, names: list[str], after: int, upto: int) -> list[str]:
        """Those that may hold transactions with commits in ``(after, upto]``."""
        ends = [*(self.begins(n) for n in names[1:]), *([None] if names else [])]
        return [n for n, end in zip(names, ends, strict=True) if self.begins(n) <= upto and (end is None or end > after)]


def changes_of(lines: Iterator[bytes], database: str, after: int, upto: int) -> Iterator[dict]:
    """Events of the transactions in ``(after, upto]`` of one segment."""
    relations, commit = {}, None
    for line in lines:
        if not line.endswith(b"\n"):
            return
        r = json.loads(line)
        kind = r["k"]
        if kind == "header":
            relations, commit = {x["id"]: x for x in r["relations"]}, r["commit"]
        elif kind == "relation":
            relations[r["id"]] = r
        elif kind == "begin":
            commit = r["commit"]
            if commit > upto:
                return
        elif kind != "commit" and commit is not None and after < commit <= upto:
            of, missing = relations[r["rel"]], set(r.get("missing", ()))
            sent = [c for i, c in enumerate(of["columns"]) if i not in missing]
            cells = list(zip(sent, r.get("values", ()), strict=False))
            yield {
                "database": database, "table_id": of["id"], "schema_name": of["schema"], "table_name": of["table"], "action": kind and kind.upper(),
                "columns": [{"name": n, "type_name": t, "value": None if t in NOT_SCANNED else v} for (n, t, _), v in cells if t is not None] if kind in ("insert", "update") else [],
                "primary_keys": [{"name": n, "value": v} for (n, _, key), v in cells if key and v is not None], "start_lsn": r["lsn"], "commit_lsn": None if commit == NO_COMMIT else commit,
            }


@dataclass
class Part(InputPartition):
    name: str
    after: int
    upto: int


class _Reads:
    """What batch and stream have in common."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.database, self.schema = options["path"], options.get("database", ""), schema
        self.most = int(options.get("maxSegmentsPerTrigger", 0))

    def parts(self, after: int, upto: int) -> list[Part]:
        log = Segments(self.folder)
        return [Part(n, after, upto) for n in log.between(log.names(), after, upto)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives where there are no parts
            return
        store, path = opened(self.folder)
        kind, held = to_arrow_schema(self.schema), []
        with store.open_input_stream(f"{path}/{partition.name}") as raw:
            for event in changes_of(_lines(raw), self.database, partition.after, partition.upto):
                held.append(event)
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)


def _lines(raw) -> Iterator[bytes]:
    """Lines with their ends; a last one without end is given as it is."""
    rest = b""
    while piece := raw.read(PIECE):
        *lines, rest = (rest + piece).split(b"\n")
        yield from (x + b"\n" for x in lines)
    if rest:
        yield rest


class BatchReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Part]:
        log = Segments(self.folder)
        return self.parts(START, log.last_commit(log.names()))


class StreamReader(_Reads, DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.log, self.at = Segments(self.folder), None

    def initialOffset(self) -> dict:
        return {"commit": START}

    def latestOffset(self) -> dict:
        names = self.log.names()
        if self.most and self.at is not None:
            ahead = self.log.between(names, self.at, 1 << 63)
            for n in range(self.most, len(ahead) + 1):  # a transaction longer than the bound is taken whole
                upto = self.log.last_commit(names[: names.index(ahead[n - 1]) + 1])
                if upto > self.at or n == len(ahead):
                    return {"commit": max(upto, self.at)}
        return {"commit": max(self.log.last_commit(names), START if self.at is None else self.at)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = end["commit"]
        return self.parts(start["commit"], end["commit"])


class ChangeLog(DataSource):
    """``spark.read`` and ``spark.readStream`` of a log, once :func:`register` was called."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options, schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeLog)


def read(spark: SparkSession, folder: str, database: str = "") -> DataFrame:
    """All committed changes of a log."""
    register(spark)
    return spark.read.format("change_log").option("path", qualified(spark, folder)).option("database", database).load()


def stream(spark: SparkSession, folder: str, database: str = "", max_segments: int = 0) -> DataFrame:
    """The same as a stream, transaction by transaction."""
    register(spark)
    return spark.readStream.format("change_log").option("path", qualified(spark, folder)).option("database", database).option("maxSegmentsPerTrigger", str(max_segments)).load()


class Segment:
    """Writes the lines of one segment from rows in the order of the log."""

    def __init__(self):
        self.relations: dict[int, dict] = {}
        self.commit: int | None = None

    def header(self, commit: int | None) -> bytes:
        self.commit = commit
        return self.line({"k": "header", "relations": list(self.relations.values()), "commit": commit})

    @staticmethod
    def line(record: dict) -> bytes:
        return json.dumps(record, ensure_ascii=False, separators=(",", ":")).encode() + b"\n"

    def lines(self, r: dict) -> Iterator[bytes]:
        if r["commit_lsn"] != self.commit:
            self.commit = r["commit_lsn"]
            yield self.line({"k": "begin", "commit": self.commit})
        if r["action"] == "COMMIT":
            yield self.line({"k": "commit", "commit": r["commit_lsn"]})
            return
        keys = {k["name"]: k["value"] for k in r["primary_keys"] or ()}
        cells = [(c["name"], c["type_name"], c["value"]) for c in r["columns"] or ()]
        cells += [(n, None, v) for n, v in keys.items() if n not in {c[0] for c in cells}]
        columns = [[n, t, n in keys] for n, t, _ in cells]
        known = self.relations.get(r["table_id"])
        if known is None or (known["schema"], known["table"], known["columns"]) != (r["schema_name"], r["table_name"], columns):
            self.relations[r["table_id"]] = known = {"k": "relation", "id": r["table_id"], "schema": r["schema_name"], "table": r["table_name"], "columns": columns}
            yield self.line(known)
        yield self.line({"k": r["action"] and r["action"].lower(), "rel": r["table_id"], "lsn": r["start_lsn"], "values": [keys.get(n, v) for n, _, v in cells]})


def write(changes: DataFrame, folder: str) -> None:
    """Events as a log: a segment for each range of commits and changes, so that a transaction of very many changes is divided among tasks.

    Rows are of :data:`events.EVENT`; a transaction's changes go by ``start_lsn``, those of one place by what they hold.
    Segments that tasks wrote and the driver does not see are an error: the folder is then each machine's own.
    """
    spark = changes.sparkSession
    place = qualified(spark, folder)
    changes = changes.withColumns({"commit_lsn": F.coalesce("commit_lsn", F.lit(NO_COMMIT)), "held": F.xxhash64("columns", "primary_keys")})
    ends = changes.select("commit_lsn").distinct().select("commit_lsn", F.lit(1).alias("end"), F.lit("COMMIT").alias("action"))
    rows = changes.withColumn("end", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    order = ["commit_lsn", "end", "start_lsn", "table_id", "held"]

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = opened(place)
        store.create_dir(path, recursive=True)
        out, made, name, at = None, Segment(), "", TaskContext.get()
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name = f"{path}/{r['commit_lsn']:020d}-{at.partitionId():06d}{SUFFIX}"
                    out = store.open_output_stream(f"{name}.{at.taskAttemptId()}")
                    out.write(made.header(r["commit_lsn"]))
                out.write(b"".join(made.lines(r)))
        if out is not None:
            out.close()
            store.move(f"{name}.{at.taskAttemptId()}", name)
            yield pa.RecordBatch.from_pydict({"name": [name]})

    made = {r.name.rpartition("/")[2] for r in rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(segment, "name string").collect()}
    if lost := made - set(Segments(place).names()):
        raise ValueError(f"executors do not share {folder}: {len(lost)} of {len(made)} segments that they wrote are not there")
