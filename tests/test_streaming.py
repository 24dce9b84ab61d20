"""Streams from files, run until there is no more; sinks, settings and the command line."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from redactory import cli
from redactory.config import Config, probe, secret, validate
from redactory.operators.rules import Engine, Rule
from redactory.operators.scan import failures, scan_cells, scan_events
from redactory.sources import events
from redactory.streaming import dedup, job, server, sinks

RULES = '[[rules]]\nid = "alpha"\ncategory = "CAT"\nseverity = "critical"\npattern = "ALPHA-[0-9]+"\n'


def _rows(spark, values, start=0):
    rows = [("localhost/db", 1, "public", "t1", "INSERT", [("c1", "text", v)], [("id", str(start + i))], 1, start + i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, events.EVENT)


class Kept(sinks.Channel):
    def __init__(self, name):
        self.name, self.rows = name, []

    def send(self, findings):
        self.rows += findings.collect()


class Broken(sinks.Channel):
    name = "broken"

    def send(self, findings):
        raise OSError("gone")


def test_rules_change_and_the_stream_goes_on(spark, tmp_path):
    src, rules = tmp_path / "in", tmp_path / "rules.toml"
    rules.write_text(RULES)
    _rows(spark, ["ALPHA-1", "ALPHA-1", "no", "ALPHA-2"]).write.parquet(str(src))
    kept, held, counts = Kept("kept"), job.Rules(rules), Counter()

    def go():
        stream = spark.readStream.schema(events.EVENT).parquet(str(src))
        q = job.run(stream, held, [Broken(), kept], str(tmp_path / "cp"), window_ms=300_000, trigger={"availableNow": True}, metrics=counts)
        q.awaitTermination(120)
        assert job.status(q) == "exited" and job.all_terminated([q])

    go()
    assert sorted(r.lsn for r in kept.rows) == [0, 3]
    assert counts["findings", "localhost/db", "CAT", "critical"] == 3 and counts["alerts", "kept", "ok"] == 2 and counts["alerts", "broken", "error"] == 2
    rules.write_text(RULES.replace("ALPHA", "BETA") + " ")
    _rows(spark, ["ALPHA-9", "BETA-1"], 10).write.mode("append").parquet(str(src))
    go()
    assert sorted(r.lsn for r in kept.rows) == [0, 3, 11] and held.reloads["ok"] == 1
    rules.write_text("[[rules]]\n")
    assert len(held.current()) == 1 and held.reloads["error"] == 1


def test_window_in_the_state_store(spark, tmp_path):
    schema = "k string, t long, lsn long"
    src, out = str(tmp_path / "in"), []

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = dedup.passing(stream, 300, order=("lsn",), time="t", key=["k"]).writeStream.foreachBatch(lambda df, _: out.extend((r.k, r.t) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    go([("a", 0, 1), ("a", 299, 2), ("a", 300, 3), ("b", 7, 4)])
    go([("a", 599, 5), ("a", 600, 6), ("b", 8, 7)])
    assert sorted(out) == [("a", 0), ("a", 300), ("a", 600), ("b", 7)]


def test_webhooks_and_chat(spark):
    got, refuse = [], [1]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            busy = self.path == "/chat" and refuse and refuse.pop()
            self.send_response(429 if busy else 200)
            if busy:
                self.send_header("Retry-After", "1")
            self.end_headers()
            if not busy:
                got.append((self.path, self.headers.get("X-Key") or self.headers.get("Authorization"), body))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    found = scan_cells(_rows(spark, [f"ALPHA-{i}" for i in range(10)]).coalesce(1), Engine([Rule("alpha", category="CAT", severity="high", pattern=r"ALPHA-\d+")])).coalesce(1)
    sinks.Webhook(f"{url}/hook", {"X-Key": "k"}).send(found)
    sinks.Chat(f"{url}/chat", batch_size=8, channel="#alerts", token="t0k").send(found)
    server.shutdown()
    hooks, chats = ([x for x in got if x[0] == p] for p in ("/hook", "/chat"))
    assert len(hooks) == 10 and hooks[0][1] == "k" and hooks[0][2]["severity"] == "HIGH"
    heads = sorted(c[2]["attachments"][0]["blocks"][0]["text"]["text"] for c in chats)
    assert {c[1] for c in chats} == {"Bearer t0k"} and {c[2]["channel"] for c in chats} == {"#alerts"}
    assert heads == [f"{sinks.SIGNS['high']} {n} Sensitive Data Findings" for n in (2, 8)]


def test_messages():
    f = {"schema_name": "s", "table_name": "t", "column_name": "c", "database": "d", "severity": "LOW", "rule_id": "r", "masked_sample": "**", "category": "C", "lsn": 1}
    assert len(sinks.message([f])["attachments"][0]["blocks"]) == 4
    many = sinks.message([f, f | {"severity": "CRITICAL"}, f])["attachments"][0]
    assert many["color"] == sinks.COLOURS["critical"] and many["blocks"][0]["text"]["text"] == f"{sinks.SIGNS['critical']} 3 Sensitive Data Findings"
    one = sinks.message([f | {"description": "What"}], channel="#alerts", username="bot", icon_emoji=None)
    assert one["channel"] == "#alerts" and one["username"] == "bot" and "icon_emoji" not in one
    first, fields, sample, context = one["attachments"][0]["blocks"]
    assert first["text"]["text"].endswith("*LOW* \u2014 What") and [x["text"].split("\n") for x in fields["fields"]] == [["*Rule*", "r"], ["*Category*", "C"], ["*Database*", "d"], ["*Table*", "s.t"], ["*Column*", "c"]]
    assert sample["text"]["text"] == "*Sample*\n`**`" and context["elements"][0]["text"] == "LSN: 1"


def test_waits_double():
    waits = []

    class Busy(BaseHTTPRequestHandler):
        def do_POST(self):
            self.send_response(429)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Busy)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with pytest.raises(Exception, match="429"):
        sinks.post(f"http://127.0.0.1:{server.server_port}", b"{}", {}, retries=3, wait=waits.append)
    server.shutdown()
    assert waits == [1.0, 2.0, 4.0]


def test_names_of_channels():
    one, two = sinks.Webhook("http://a"), sinks.Webhook("http://b")
    assert [c.name for c in sinks.numbered([one, two, sinks.Chat("http://c")])] == ["webhook-1", "webhook-2", "slack"]


def test_file_and_table_sinks(spark, tmp_path):
    found = scan_cells(_rows(spark, ["ALPHA-1"]), Engine([Rule("alpha", category="CAT", severity="high", pattern=r"ALPHA-\d+")]))
    sinks.Jsonl(str(tmp_path / "j")).send(found)
    sinks.Table(str(tmp_path / "t")).send(found)
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0])["primary_key"] == {"id": "0"}
    row = spark.read.parquet(str(tmp_path / "t")).first()
    assert row.rule_id == "alpha" and row.primary_key == '{"id":"0"}' and len(row) == 12


CONFIG = """rules = "rules.toml"
[[databases]]
host = "localhost"
name = "a"
[[databases]]
host = "localhost"
name = "b"
filter = { exclude_tables = ["x"] }
[filter]
include_schemas = ["public"]
[alerts]
dedup_window_secs = 60
[[alerts.webhook]]
url = { file = "%s" }
"""


def test_settings(tmp_path):
    (tmp_path / "url").write_text("https://example.test/hook \n")
    (tmp_path / "rules.toml").write_text(RULES + 'channels = ["pager"]\n')
    (tmp_path / "c.toml").write_text(CONFIG % (tmp_path / "url"))
    c = Config.load(tmp_path / "c.toml", {"REDACTORY__ALERTS__DEDUP_WINDOW_SECS": "5", "OTHER": "x"})
    assert c.raw["alerts"]["dedup_window_secs"] == 5 and c.raw["alerts"]["log"]["enabled"]
    assert [c.filter_of(d).include_schemas for d in c.raw["databases"]] == [["public"], []]
    assert secret({"file": str(tmp_path / "url")}) == "https://example.test/hook"
    assert [x.name for x in c.channels()] == ["log", "webhook"]
    report = validate(c)
    assert ("rules", "warning", "alpha: no channel pager") in report and not [r for r in report if r[1] == "error"]
    (tmp_path / "bad.toml").write_text('rules = "none.toml"\n[[databases]]\nhost = "h"\nname = "a"\n[[databases]]\nhost = "h"\nname = "a"\n[[alerts.slack]]\nurl = "ftp://x"\n')
    bad = validate(Config.load(tmp_path / "bad.toml", {}))
    assert {p for p, s, _ in bad if s == "error"} == {"databases", "alerts", "rules"}


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["rules", "list"]) == 0 and "22 rules loaded" in capsys.readouterr().out
    assert cli.main(["rules", "test", "--input", "card 4111111111111111"]) == 0
    assert "credit-card  CRITICAL  PCI_DSS  41************11" in capsys.readouterr().out
    (tmp_path / "rules.toml").write_text(RULES)
    (tmp_path / "c.toml").write_text('rules = "rules.toml"\n[[databases]]\nhost = "h"\nname = "a"\n')
    assert cli.main(["validate", "--config", str(tmp_path / "c.toml")]) == 0 and "0 errors" in capsys.readouterr().out
    assert cli.main(["rules", "bench", "--rules", str(tmp_path / "rules.toml"), "--generate", "50", "--iterations", "2"]) == 0
    assert "all rules" in capsys.readouterr().out
    _rows(spark, ["ALPHA-1", "x"]).select(F.col("commit_lsn").alias("id"), F.col("columns")[0]["value"].alias("v")).write.parquet(str(tmp_path / "in"))
    assert cli.main(["scan", "--rules", str(tmp_path / "rules.toml"), "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out.json"), "--key", "id"]) == 0
    assert spark.read.json(str(tmp_path / "out.json")).count() == 1


def test_events_that_look_alike_stay_apart(spark):
    """Two updates of one row in one transaction, and two rows without keys: each has its own places and its own redaction."""
    rows = [("h/d", 1, "public", "t", "UPDATE", [("id", "text", v), ("b", "text", w)], k, 1, 7) for v, w, k in (("ALPHA-1", "x", [("id", "ALPHA-1")]), ("y", "ALPHA-2", [("id", "ALPHA-1")]), ("ALPHA-3", "ALPHA-4", []), ("z", "ALPHA-5", []))]
    df = spark.createDataFrame(rows, events.EVENT)
    pattern, function = Rule("alpha", category="CAT", severity="high", pattern=r"ALPHA-\d+"), Rule("words", category="CAT", severity="low", kind="script", script=lambda v: [w for w in v.split() if w.startswith("ALPHA")])
    for engine, each in ((Engine([pattern]), 1), (Engine([pattern, function]), 2)):
        found = scan_events(df, engine)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
        alpha = [r for r in got if r.rule_id == "alpha"]
        assert sorted(r.place for r in alpha) == [0, 0, 0, 0, each] and len(got) == 5 * each
        assert sorted((r.column_name, len(r.primary_keys)) for r in alpha) == [("b", 0), ("b", 0), ("b", 1), ("id", 0), ("id", 0)]
    broken = Rule("broken", category="CAT", severity="low", kind="script", script=lambda v: [] if v == "" else 1 / 0)
    assert [(r.rule_id, r.n) for r in failures(df, Engine([broken, function])).collect()] == [("broken", 8)]


def test_rules_are_run_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(v):
        calls.add(len(v) > 0)
        return [v]

    scan_events(_rows(spark, ["a", "b", "c"]), Engine([Rule("all", category="C", severity="low", kind="script", script=counted)])).collect()
    assert calls.value == 3


def test_restart_inside_the_window(spark, tmp_path):
    src, rules = tmp_path / "in", tmp_path / "rules.toml"
    rules.write_text(RULES)
    got = []
    for start in (0, 10):
        _rows(spark, ["ALPHA-1", f"ALPHA-{start + 2}"], start).write.mode("append").parquet(str(src))
        kept = Kept("kept")
        job.run(spark.readStream.schema(events.EVENT).parquet(str(src)), job.Rules(rules), [kept], str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination(120)
        got.append(sorted(r.lsn for r in kept.rows))
    assert got == [[0, 1], [11]]


def test_a_batch_done_again_passes_again(spark, tmp_path):
    found = scan_events(_rows(spark, ["ALPHA-1"]), Engine([Rule("alpha", category="CAT", severity="high", pattern=r"ALPHA-\d+")]))
    window = job.Window(spark, str(tmp_path / "w"), 300_000)
    assert [window.passing(found, n).count() for n in (0, 1, 1, 0)] == [1, 0, 0, 1]


def test_the_whole_job_from_settings(spark, tmp_path, capsys):
    _rows(spark, ["ALPHA-1", "x", "ALPHA-2"]).write.parquet(str(tmp_path / "in"))
    (tmp_path / "rules.toml").write_text(RULES)
    (tmp_path / "c.toml").write_text(f"""rules = "rules.toml"
profiling = true
store = {{ type = "checkpoint", path = "{tmp_path}/store" }}
log = {{ level = "warn", format = "json", output = "{tmp_path}/log" }}
server = {{ enabled = true }}
[[databases]]
host = "h"
name = "a"
source = {{ path = "{tmp_path}/in", options = {{ maxFilesPerTrigger = 1 }} }}
[[databases]]
host = "h"
name = "b"
source = {{ path = "{tmp_path}/in" }}
filter = {{ include_schemas = ["other"] }}
[alerts.jsonl]
path = "{tmp_path}/out"
""")
    counts = Counter()
    config = Config.load(tmp_path / "c.toml", {})
    assert job.run_all(spark, config, {"availableNow": True}, counts) == {"h/a": "exited", "h/b": "exited"}
    assert {json.loads(r.value)["database"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"h/a"}
    assert counts["findings", "h/a", "CAT", "critical"] == 2 and counts["skipped", "schema"] == 3 and counts["events", "h/b"] == 3 and counts["rule_seconds", "alpha"] > 0
    text = server.render(counts)
    assert 'redactory_findings_total{database="h/a",category="CAT",severity="critical"} 2' in text and "# TYPE redactory_rules_loaded gauge" in text and "redactory_rules_loaded 1" in text
    assert cli.main(["run", "--config", str(tmp_path / "c.toml"), "--once"]) == 0 and "h/a: exited" in capsys.readouterr().out
    assert {s for _, s, _ in probe(config, spark)} == {"ok"}


def test_failed_streams_start_again():
    class Query:
        lastProgress = None
        isActive = False

        def __init__(self, error):
            self.error = error

        def awaitTermination(self):
            if self.error:
                raise OSError("gone")

        def exception(self):
            return self.error

    left, waits, counts = [True, True, False], [], Counter()
    assert job.supervised(lambda: Query(left.pop(0)), counts, "h/a", attempts=3, delay=1.0, wait=waits.append) == "exited"
    assert waits == [1.0, 2.0] and counts["reconnects", "h/a"] == 2
    assert job.supervised(lambda: Query(True), counts, "h/a", attempts=1, wait=waits.append) == "failed"


def test_health_and_metrics():
    from urllib.error import HTTPError
    from urllib.request import urlopen

    counts = Counter({("script_errors", 'a"b\n'): 2})
    s = server.Server(counts)
    url = f"http://127.0.0.1:{s.port}"
    assert json.load(urlopen(f"{url}/health")) == {"status": "ok"}
    with pytest.raises(HTTPError, match="503"):
        urlopen(f"{url}/ready")
    s.ready.set()
    assert json.load(urlopen(f"{url}/ready")) == {"status": "ready"}
    assert 'redactory_script_errors_total{rule_id="a\\"b\\n"} 2' in urlopen(f"{url}/metrics").read().decode()
    s.close()
