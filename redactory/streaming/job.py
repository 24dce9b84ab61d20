"""Streaming scans: events to findings to channels, with rules that can change meanwhile."""

from __future__ import annotations

import hashlib
import logging
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.dedup import KEY
from ..operators.rules import Engine, RuleError, load
from ..operators.scan import Filter, scan_events
from ..sources.changelog import qualified, register
from ..sources.events import EVENT
from .dedup import once, passing
from .folders import scratch
from .ledger import Ledger
from .messages import together
from .server import Server, add_to
from .sinks import Channel, Chat, Outbox, dispatch

log = logging.getLogger("redactory")


#: Formats that are files in a folder.
FILES = ("parquet", "json", "orc", "avro", "text", "csv", "xml", "binaryFile")
STORE, EMPTY = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


class Rules:
    """The rules of a file, read anew when it has changed; if it is wrong then, the old ones stay."""

    def __init__(self, path: str | Path):
        self.path, self.seen = Path(path), None
        self.reloads: Counter[str] = Counter()
        self.engine = Engine(load(self.path))
        self.seen = self._state()

    def _state(self) -> tuple[int, int]:
        s = self.path.stat()
        return s.st_mtime_ns, s.st_size

    def current(self) -> Engine:
        try:
            state = self._state()
            if state != self.seen:
                self.seen = state
                self.engine = Engine(load(self.path))
                self.reloads["ok"] += 1
        except (OSError, ValueError, RuleError):
            log.exception("the rules in %s stay as they were", self.path)
            self.reloads["error"] += 1
        return self.engine


class Progress(StreamingQueryListener):
    """Adds what a scan observes to the counts, micro-batch by micro-batch, and times them for the histograms."""

    def __init__(self, name: str, counts: Counter, database: str, scripts: list[str]):
        self.name, self.counts, self.database, self.scripts = name, counts, database, scripts
        self.ended, self.side = threading.Event(), None
        self.run_id: str | None = None
        #: Ends the query once its micro-batch is committed.
        self.stop: Callable[[], None] | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen, counts = event.progress.observedMetrics, self.counts
        if self.name not in seen:
            return
        own = seen[self.name]
        counts["queue", self.database] = own.events
        counts["events", self.database] += own.events
        for reason in ("schema", "table"):
            if n := own[f"skipped_{reason}"]:
                counts["skipped", reason] += n
        for r, n in zip(self.scripts, seen.get(f"{self.name}-failed", ()), strict=False):
            if n:
                counts["script_errors", r] += n
        add_to(counts, "batch_size", own.events)
        add_to(counts, "scan_duration_seconds", event.progress.durationMs.get("addBatch", 0) / 1000)
        if self.stop:
            threading.Thread(target=self.stop, daemon=True).start()

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.ended.set()


_STARTING = threading.Lock()
#: Of running queries, by run.
_PROGRESS: dict[str, Progress] = {}


def settled(query: StreamingQuery, wait: float = 10.0) -> None:
    """Wait until the counts of a query that has ended are complete."""
    own = _PROGRESS.pop(str(getattr(query, "runId", "")), None)
    if own:
        own.ended.wait(wait)
        spark = SparkSession.getActiveSession()
        if spark:
            spark.streams.removeListener(own)
        if own.side:
            own.side.processAllAvailable()
            own.side.stop()


def run(
    events: DataFrame, rules: Rules, channels: list[Channel], checkpoint: str, where: Filter | None = None, window_ms: int = 300_000, trigger: dict | None = None, metrics: Counter | None = None, profiling: bool = False, database: str = "",
) -> StreamingQuery:
    """Scan a stream of events. Offsets, the dedup window and the ledger of what was sent are kept at ``checkpoint``: a restarted query goes on where it was.

    Rules are in the part of the plan that has no state, the window is in the state store behind it. When rules have changed,
    the query ends after its micro-batch; started again, as :func:`supervised` does, it has the new rules and the window as it was.
    A micro-batch is one pass over its events, and one that is done again after a failure sends only what was not sent.
    Profiling reads the stream a second time, in a query of its own.
    """
    spark, counts, engine = events.sparkSession, metrics if metrics is not None else Counter(), rules.current()
    base = checkpoint.rstrip("/")
    job = database.replace("/", "-") or hashlib.sha256(base.encode()).hexdigest()[:12]
    ledger = Ledger(spark, f"{base}/ledger", job)
    name = f"scan-{uuid.uuid4().hex}"
    progress = Progress(name, counts, database, [r.id for r in engine.rules if r.kind == "script"])
    counts["rules",] = len(engine)

    def batch(df: DataFrame, number: int) -> None:
        for status in ("ok", "error"):
            counts["reloads", status] = rules.reloads[status]
        ledger.forget(number)
        found = df.persist()
        try:
            total = fresh = 0
            for r in found.groupBy("database", "category", "severity").agg(F.sum("n").alias("n"), F.count_if("fresh").alias("fresh")).collect():
                counts["findings", r.database, r.category, r.severity] += r.n
                total, fresh = total + r.n, fresh + r.fresh
            if fresh:
                start = time.perf_counter()
                for key, n in dispatch(found.where("fresh").drop("n", "fresh"), channels, ledger=ledger, number=number).items():
                    counts["alerts", *key] += n
                add_to(counts, "dispatch_duration_seconds", time.perf_counter() - start)
            if window_ms > 0:
                counts["suppressed", database] += total - fresh
        finally:
            found.unpersist()
        if rules.current() is not engine and progress.stop is None:
            progress.stop = query.stop

    if window_ms > 0 and "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = once(scan_events(events, engine, where, observed=name), window_ms)
    spark.streams.addListener(progress)
    writer = found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    with _STARTING:  # a query takes the setting with it; without it, one that is to end would run empty micro-batches for ever
        empty = spark.conf.get(EMPTY)
        spark.conf.set(EMPTY, "false")
        try:
            query = (writer.trigger(**trigger) if trigger else writer).start()
        finally:
            spark.conf.set(EMPTY, empty)
    progress.run_id = str(query.runId)
    _PROGRESS[progress.run_id] = progress
    if profiling:
        timed = events.writeStream.foreachBatch(lambda df, _: profile(df, engine, where, counts)).option("checkpointLocation", f"{base}/profiling")
        progress.side = (timed.trigger(**trigger) if trigger else timed).start()
    return query


def profile(df: DataFrame, engine: Engine, where: Filter | None, counts: Counter) -> None:
    """Seconds of each rule alone over a micro-batch; costs as many scans as there are rules."""
    df = df.persist()
    try:
        for rule in engine.rules:
            start = time.perf_counter()
            scan_events(df, Engine([rule]), where).write.format("noop").mode("overwrite").save()
            counts["rule_seconds", rule.id] += time.perf_counter() - start
            add_to(counts, "rule_scan_duration_seconds", time.perf_counter() - start, rule.id)
    finally:
        df.unpersist()


def chat(findings: DataFrame, channel: Chat, checkpoint: str, age_ms: int = 2000, shards: int = 1, trigger: dict | None = None, counts: Counter | None = None, name: str | None = None) -> StreamingQuery:
    """Messages of a stream of findings that close by size or by age, whatever micro-batches findings came in."""
    held = together(findings.select(channel.body().alias("body")), channel.batch_size, age_ms, shards)
    counts, ledger = counts if counts is not None else Counter(), Ledger(findings.sparkSession, f"{checkpoint.rstrip('/')}/ledger", channel.name)

    def batch(df: DataFrame, number: int) -> None:
        ledger.forget(number)
        for status, n in ledger.messages(channel, df, number).items():
            counts["alerts", channel.name, status] += n

    writer = held.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    with _STARTING:
        return (writer.trigger(**trigger) if trigger else writer).start()


class Window:
    """The dedup window between micro-batches, for callers that scan in ``foreachBatch`` themselves; :func:`run` has it in the state store.

    What a micro-batch lets through is a table of its own below ``folder``, named by its
    number and time; those of the last ``window_ms`` are the window. So it outlives the query and lost
    executors, no plan grows with the number of micro-batches, and one that is done again
    replaces what it wrote.
    """

    def __init__(self, spark, folder: str, window_ms: int):
        self.spark, self.folder, self.window_ms = spark, folder, window_ms
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _tables(self) -> list[tuple[int, int, str]]:
        """Number, time and path of each."""
        if not self.fs.exists(self.path):
            return []
        return sorted((*map(int, f.getPath().getName().split("-")), f.getPath().toString()) for f in self.fs.listStatus(self.path) if f.isDirectory())

    def passing(self, found: DataFrame, number: int) -> DataFrame:
        if self.window_ms <= 0:
            return found
        now, recent = time.time_ns() // 1_000_000, []
        for n, at, path in self._tables():
            if n >= number or now - at >= self.window_ms:
                self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
            else:
                recent.append(path)
        columns = F.struct(*found.columns)
        fresh = found.groupBy(*KEY).agg(F.min_by(columns, F.struct("lsn", "place")).alias("first")).select("first.*")
        if recent:
            same = self.spark.read.schema(found.select(*KEY).schema).parquet(*recent).distinct()
            fresh = fresh.join(same.withColumnsRenamed({k: f"of_{k}" for k in KEY}), [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in KEY], "left_anti")
        path = f"{self.folder}/{number}-{now}"
        fresh.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(found.schema).parquet(path)


def supervised(start: Callable[[], StreamingQuery], counts: Counter, database: str, attempts: int = 5, delay: float = 1.0, wait: Callable[[float], None] = time.sleep, changed: Callable[[], bool] | None = None) -> str:
    """Run a query until it ends; one that fails is started again, after waits that double, up to ``attempts`` times in a row without progress.

    One that has ended because its rules ``changed`` is started again at once.
    """
    failed = 0
    while True:
        query = start()
        counts["connected", database] = 1
        try:
            query.awaitTermination()
            counts["connected", database] = 0
            settled(query)
            if changed and changed():
                continue
            return status(query)
        except Exception:
            counts["connected", database] = 0
            settled(query)
            failed = 1 if query.lastProgress and query.lastProgress.batchId > 0 else failed + 1
            log.exception("the stream of %s failed", database)
            if failed > attempts:
                return "failed"
            counts["reconnects", database] += 1
            wait(delay * 2 ** (failed - 1))


def source(spark, said: dict, files: int) -> DataFrame:
    """A stream of events by settings: ``format``, ``path`` and ``options`` of any source that gives rows of :data:`EVENT`; a micro-batch takes at most ``files`` files, segments of a change log, or offsets, where ``options`` say no other number."""
    kind = said.get("format", "parquet")
    if kind == "change_log":
        register(spark)
    bound = {"change_log": "maxSegmentsPerTrigger", "kafka": "maxOffsetsPerTrigger"}.get(kind, "maxFilesPerTrigger" if kind in FILES else None)
    given = {k: str(v) for k, v in said.get("options", {}).items()} | ({"path": qualified(spark, said["path"])} if kind == "change_log" else {})
    reader = spark.readStream.format(kind).options(**(({bound: str(files)} if bound else {}) | given))
    if kind == "change_log":
        return reader.load()
    reader = reader.schema(EVENT) if kind in ("parquet", "json", "orc", "avro") else reader
    return reader.load(said["path"]) if "path" in said else reader.load()


def run_all(spark, config, trigger: dict | None = None, counts: Counter | None = None) -> dict[str, str]:
    """The job that settings describe: a supervised stream for each database, with its own filter; returns how each ended."""
    counts = counts if counts is not None else Counter()
    raw, rules, channels = config.raw, Rules(config.rules_path), config.channels()
    http = Server(counts, raw["server"].get("host", "127.0.0.1"), int(raw["server"].get("port", 0))) if raw.get("server", {}).get("enabled") else None
    ended: dict[str, str] = {}

    def one(d: dict) -> None:
        name = f"{d['host']}/{d['name']}"
        # Without a store that lasts, places in the stream are those of this run.
        base = raw["store"]["path"] if raw["store"]["type"] == "checkpoint" else scratch(spark, "job")

        used: list[Engine] = []

        # A stream that goes on puts findings for chats on a table, from which a query of its own makes messages by size and age.
        held = {c.name: Outbox(f"{base}/{name.replace('/', '-')}-{c.name}", c.name) for c in channels if isinstance(c, Chat)} if not trigger or "processingTime" in trigger else {}
        sending: list[StreamingQuery] = []

        def start() -> StreamingQuery:
            used[:] = [rules.current()]
            for c in channels:
                if c.name in held and not any(q.name == f"{name} {c.name}" and q.isActive for q in sending):
                    sending.append(chat(held[c.name].stream(spark), c, f"{base}/{name.replace('/', '-')}-{c.name}-sent", c.age_ms, counts=counts, trigger={"processingTime": "500 milliseconds"}, name=f"{name} {c.name}"))
            events = source(spark, d["source"], int(raw["pipeline"]["max_files_per_trigger"])).withColumn("database", F.lit(name))
            return run(events, rules, [held.get(c.name, c) for c in channels], f"{base}/{name.replace('/', '-')}", config.filter_of(d), int(raw["alerts"]["dedup_window_secs"] * 1000), trigger, counts, bool(raw["profiling"]), name)

        ended[name] = supervised(start, counts, name, int(raw["pipeline"]["retry_max_attempts"]), raw["pipeline"]["retry_delay_ms"] / 1000, changed=lambda: rules.engine is not used[0])
        for q in sending:
            q.stop()

    threads = [threading.Thread(target=one, args=(d,)) for d in raw["databases"]]
    for t in threads:
        t.start()
    if http:
        http.ready.set()
    for t in threads:
        t.join()
    if http:
        http.close()
    return ended


def alerts(findings: DataFrame, channels: list[Channel], checkpoint: str, window_ms: int = 300_000, time_col: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Findings of fixed rules: the window is kept in the state store and survives a restart."""
    fresh = passing(findings, window_ms, time=time_col)
    writer = fresh.writeStream.foreachBatch(lambda df, _: dispatch(df, channels) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def status(query: StreamingQuery) -> str:
    """``running``, ``failed`` or ``exited``."""
    return "running" if query.isActive else "failed" if query.exception() else "exited"


def all_terminated(queries: list[StreamingQuery]) -> bool:
    return all(not q.isActive for q in queries)
