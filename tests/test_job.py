"""The streaming job over restarts: rules that change inside a window, micro-batches done again, messages by age, live counts."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from redactory.config import Config
from redactory.operators.rules import Engine, Rule
from redactory.operators.scan import scan_events, scan_table
from redactory.sources import changelog, events
from redactory.streaming import dedup, job, messages, server, sinks

RULES = '[[rules]]\nid = "alpha"\ncategory = "CAT"\nseverity = "critical"\npattern = "ALPHA-[0-9]+"\n'


def rows_of(spark, values, start=0):
    rows = [("h/d", 1, "public", "t1", "INSERT", [("c1", "text", v)], [("id", str(start + i))], 1, start + i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, events.EVENT).coalesce(1)


class Kept(sinks.Channel):
    def __init__(self, name="kept"):
        self.name, self.rows = name, []

    def send(self, findings):
        self.rows += findings.collect()


@pytest.fixture
def web():
    """A server that takes what it gets until ``left`` is used up, then fails."""
    state = SimpleNamespace(left=10**9, got=[])

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            fine = state.left > 0
            state.left -= 1
            if fine:
                state.got.append(body)
            self.send_response(200 if fine else 500)
            self.end_headers()

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    state.url = f"http://127.0.0.1:{http.server_port}/hook"
    yield state
    http.shutdown()


def until(done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)
    assert done()


def test_rules_change_inside_a_window_while_the_job_runs(spark, tmp_path):
    """The query ends by itself, goes on with the new rules, and still holds back what passed under the old ones."""
    src, rules = tmp_path / "in", tmp_path / "rules.toml"
    rules.write_text(RULES)
    rows_of(spark, ["ALPHA-1", "BETA-1"]).write.parquet(str(src))
    kept, held, counts, ended = Kept(), job.Rules(rules), Counter(), []
    used, runs = [], []

    def start():
        used[:] = [held.current()]
        q = job.run(spark.readStream.schema(events.EVENT).parquet(str(src)), held, [kept], str(tmp_path / "cp"), trigger={"processingTime": "500 milliseconds"}, metrics=counts, database="h/d")
        runs.append(q)
        return q

    t = threading.Thread(target=lambda: ended.append(job.supervised(start, counts, "h/d", changed=lambda: held.engine is not used[0])))
    t.start()
    until(lambda: len(kept.rows) == 1)
    rules.write_text(RULES + '[[rules]]\nid = "beta"\ncategory = "CAT"\nseverity = "low"\npattern = "BETA-[0-9]+"\n')
    rows_of(spark, ["ALPHA-1", "ALPHA-2"], 10).write.mode("append").parquet(str(src))
    until(lambda: len(runs) == 2)
    rows_of(spark, ["ALPHA-1", "BETA-1", "BETA-1", "ALPHA-2"], 20).write.mode("append").parquet(str(src))
    until(lambda: any(r.rule_id == "beta" for r in kept.rows))
    until(lambda: counts["suppressed", "h/d"] == 4 and counts["events", "h/d"] == 8)  # the latter once the micro-batch is committed
    rules.write_text(RULES)  # and back, to end it
    held.current()
    used[:] = [held.engine]
    runs[-1].stop()
    t.join(60)
    assert ended == ["exited"] and len(runs) == 2
    assert sorted((r.rule_id, r.lsn) for r in kept.rows) == [("alpha", 0), ("alpha", 11), ("beta", 21)]
    assert counts["findings", "h/d", "CAT", "critical"] == 5 and counts["findings", "h/d", "CAT", "low"] == 2 and counts["events", "h/d"] == 8


def test_a_failed_batch_sends_the_rest(spark, tmp_path, web):
    """After half of the messages the server fails; when the micro-batch is done again, only the other half goes out, and tables hold it once."""
    src, rules = tmp_path / "in", tmp_path / "rules.toml"
    rules.write_text(RULES)
    rows_of(spark, [f"ALPHA-{i}" for i in range(10)]).write.parquet(str(src))
    web.left, counts, cp = 5, Counter(), tmp_path / "cp"
    channels = [sinks.Webhook(web.url), sinks.Table(str(tmp_path / "table")), sinks.Jsonl(str(tmp_path / "lines")), Kept()]

    def go():
        q = job.run(spark.readStream.schema(events.EVENT).parquet(str(src)), job.Rules(rules), channels, str(cp), trigger={"availableNow": True}, metrics=counts)
        q.awaitTermination(120)
        job.settled(q)

    go()
    assert len(web.got) == 5 and counts["alerts", "webhook", "ok"] == 5 and counts["alerts", "webhook", "error"] == 5
    for mark in (cp / "commits").iterdir():  # as if the driver had been lost before the commit
        mark.unlink()
    web.left = 10**9
    go()
    assert sorted(b["lsn"] for b in web.got) == list(range(10)) and counts["alerts", "webhook", "ok"] == 10
    assert spark.read.parquet(str(tmp_path / "table")).count() == 10 and spark.read.text(str(tmp_path / "lines")).count() == 10
    assert len(channels[-1].rows) == 10


def test_a_value_that_is_everywhere_is_merged_before_the_shuffle(spark):
    found = scan_events(rows_of(spark, ["ALPHA-1"] * 500 + ["ALPHA-2"]), Engine([Rule("alpha", category="CAT", severity="high", pattern=r"ALPHA-\d+")]))
    got = dedup.merged(found, ["lsn", "place"], dedup.KEY).collect()
    assert sorted((r.lsn, r.n) for r in got) == [(0, 500), (500, 1)]


class Handle:
    """State and timers of one key in memory."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def _state(self, name):
        handle = self

        class State:
            exists = staticmethod(lambda: name in handle.values)
            get = staticmethod(lambda: handle.values.get(name, ()))
            clear = staticmethod(lambda: handle.values.pop(name, None))
            update = put = staticmethod(lambda v: handle.values.__setitem__(name, v))

        return State()

    def getListState(self, name, schema):
        return self._state(name)

    def getValueState(self, name, schema, ttl=None):
        return self._state(name)

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_messages_close_by_size_or_age():
    """With a clock: a message goes out two seconds after its first finding, however many came later, or when it is full."""
    p, h = messages.Together(3, 2000), Handle()
    p.init(h)

    def rows(now, *bodies):
        return [r.bodies for r in p.handleInputRows((0,), iter([Row(body=b) for b in bodies]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now))]

    def expire(now):
        due = {t for t in h.timers if t <= now}
        h.timers -= due
        return [r.bodies for _ in due for r in p.handleExpiredTimer((0,), None, None)]

    assert rows(1000, "a") == [] and h.timers == {3000}
    assert rows(2500, "b") == [] and h.timers == {3000} and expire(2999) == []
    assert expire(3000) == [["a", "b"]] and not h.timers and not h.values
    assert rows(4000, "c", "d", "e", "f") == [["c", "d", "e"]] and h.timers == {6000}
    assert rows(5000, "g", "h") == [["f", "g", "h"]] and not h.timers and expire(9000) == []


def test_findings_wait_between_micro_batches(spark, tmp_path, web):
    src, engine = str(tmp_path / "in"), Engine([Rule("alpha", category="CAT", severity="high", pattern=r"ALPHA-\d+")])
    scan_events(rows_of(spark, ["ALPHA-1"]), engine).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    counts = Counter()
    q = job.chat(stream, sinks.Chat(web.url, batch_size=3), str(tmp_path / "cp"), age_ms=15_000, trigger={"processingTime": "200 milliseconds"}, counts=counts)
    try:
        until(lambda: q.lastProgress and q.lastProgress.numInputRows == 0)
        for i in (2, 3):
            scan_events(rows_of(spark, [f"ALPHA-{i}"], i), engine).write.mode("append").parquet(src)
        until(lambda: len(web.got) == 1)  # full, from three files
        scan_events(rows_of(spark, ["ALPHA-9"], 9), engine).write.mode("append").parquet(src)
        until(lambda: counts["alerts", "slack", "ok"] == 2)  # by age, without more findings
    finally:
        q.stop()
    assert web.got[0]["attachments"][0]["blocks"][0]["text"]["text"] == f"{sinks.SIGNS['high']} 3 Sensitive Data Findings" and len(web.got[1]["attachments"][0]["blocks"]) == 4
    assert len(web.got) == 2


def test_live_counts_equal_those_of_a_batch(spark, tmp_path):
    """From a log of captured changes, by settings: events, skips, findings, failed functions and histograms."""
    made = rows_of(spark, ["ALPHA-1", "no", "ALPHA-2 ALPHA-3", "ALPHA-4"]).withColumn("commit_lsn", F.col("start_lsn") * 0 + 10)
    made = made.withColumn("start_lsn", F.element_at("primary_keys", 1)["value"].cast("long")).unionByName(made.withColumns({"table_name": F.lit("skipped"), "table_id": F.lit(2).cast("long"), "commit_lsn": F.lit(20).cast("long")}))
    changelog.write(spark.createDataFrame(made.rdd, events.EVENT), str(tmp_path / "log"))
    (tmp_path / "broken.py").write_text("def detect(value):\n    return [] if value == '' else [1 / 0]\n")
    (tmp_path / "rules.toml").write_text(RULES + '[[rules]]\nid = "broken"\ncategory = "CAT"\nseverity = "low"\ntype = "script"\nscript = "broken.py"\n')
    (tmp_path / "c.toml").write_text(f"""rules = "rules.toml"
store = {{ type = "checkpoint", path = "{tmp_path}/store" }}
[[databases]]
host = "h"
name = "a"
source = {{ format = "change_log", path = "{tmp_path}/log" }}
filter = {{ exclude_tables = ["skipped"] }}
[alerts.jsonl]
path = "{tmp_path}/out"
""")
    counts = Counter()
    assert job.run_all(spark, Config.load(tmp_path / "c.toml", {}), {"availableNow": True}, counts) == {"h/a": "exited"}
    assert counts["events", "h/a"] == 8 and counts["skipped", "table"] == 4 and counts["findings", "h/a", "CAT", "critical"] == 3 and counts["script_errors", "broken"] == 4
    text = server.render(counts)
    assert 'redactory_batch_size_bucket{le="5"} 0\nredactory_batch_size_bucket{le="10"} 1' in text and "redactory_batch_size_sum 8\nredactory_batch_size_count 1" in text
    assert 'redactory_scan_duration_seconds_bucket{le="+Inf"} 1' in text and "# TYPE redactory_dispatch_duration_seconds histogram" in text


def test_functions_of_python_have_no_item_bound(spark):
    """Bounds are for functions given as source: 1,200 findings of a trusted one all stay, 1,200 of a bounded one are a failure."""
    df = spark.createDataFrame([(1, "x")], "id long, v string")
    many = Rule("many", category="CAT", severity="low", kind="script", script=lambda v: [f"{v}{i}" for i in range(1200)])
    assert scan_table(df, Engine([many]), "d", "s", "t", ["id"]).count() == 1200
    bounded = Rule("many", category="CAT", severity="low", kind="script", script="def detect(value):\n    return [value + str(i) for i in range(0 if value == '' else 1200)]\n")
    assert scan_table(df, Engine([bounded]), "d", "s", "t", ["id"]).count() == 0


def test_chats_of_a_job_wait_by_age(spark, tmp_path, web):
    """Two micro-batches of one finding each make one message."""
    src = tmp_path / "in"
    rows_of(spark, ["ALPHA-1"]).write.parquet(str(src))
    (tmp_path / "rules.toml").write_text(RULES)
    (tmp_path / "c.toml").write_text(f"""rules = "rules.toml"
store = {{ type = "checkpoint", path = "{tmp_path}/store" }}
[[databases]]
host = "h"
name = "a"
source = {{ path = "{src}" }}
""")
    config, counts, ended = Config.load(tmp_path / "c.toml", {}), Counter(), []
    config.channels = lambda: [sinks.Chat(web.url, age_ms=12_000)]
    t = threading.Thread(target=lambda: ended.append(job.run_all(spark, config, {"processingTime": "200 milliseconds"}, counts)))
    t.start()
    until(lambda: counts["findings", "h/a", "CAT", "critical"] == 1)
    rows_of(spark, ["ALPHA-2"], 5).write.mode("append").parquet(str(src))
    until(lambda: counts["findings", "h/a", "CAT", "critical"] == 2)
    until(lambda: web.got)
    for q in spark.streams.active:
        if not q.name:
            q.stop()
    t.join(60)
    assert [m["attachments"][0]["blocks"][0]["text"]["text"] for m in web.got] == [f"{sinks.SIGNS['critical']} 2 Sensitive Data Findings"] and ended == [{"h/a": "exited"}]
