"""Channels: where findings go, for batches and for micro-batches.

File and table channels are Spark writers. Channels that talk to a server send from
the executors, partition by partition, and retry where the server asks them to.
A channel that fails is logged and counted; the others go on.
"""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LOG_LEVELS, SEVERITIES, keys_as_text
from ..operators.routing import payload, route
from .ledger import Ledger

log = logging.getLogger("redactory")
#: A colour for each severity in chat messages.
COLOURS = dict(zip(SEVERITIES, ("#d32f2f", "#e65100", "#f9a825", "#1565c0", "#757575"), strict=True))


#: A sign for each severity.
SIGNS = dict(zip(SEVERITIES, ("\U0001f534", "\U0001f7e0", "\U0001f7e1", "\U0001f535", "\u26aa"), strict=True))


class Channel:
    name = "channel"

    def send(self, findings: DataFrame) -> None:
        raise NotImplementedError

    def put(self, findings: DataFrame, job: str, number: int) -> None:
        """Send a micro-batch's findings; files and tables replace what the same micro-batch of the same job wrote."""
        self.send(findings)

    def body(self) -> Column:
        """What a sender gets of a finding."""
        return payload(F.current_timestamp())

    def sender(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None:
        """A function of rows ``(delivery, body)`` that sends them from the executors and gives :data:`ledger.DELIVERY`; none where findings are sent whole."""
        return None


@dataclass
class Jsonl(Channel):
    """Lines of JSON, appended to a folder."""

    path: str
    name: str = "jsonl"

    def send(self, findings: DataFrame) -> None:
        findings.select(payload(F.current_timestamp()).alias("value")).write.mode("append").text(self.path)

    def put(self, findings: DataFrame, job: str, number: int) -> None:
        findings.select(payload(F.current_timestamp()).alias("value")).write.mode("overwrite").text(f"{self.path}/job={job}/micro_batch={number}")


@dataclass
class Table(Channel):
    """A table of findings, appended: Parquet, or a JDBC table with ``options``."""

    path: str
    name: str = "table"
    options: dict = field(default_factory=dict)

    def rows(self, findings: DataFrame) -> DataFrame:
        columns = ["database", "rule_id", "description", "category", "severity", "schema_name", "table_name", "column_name", "masked_sample"]
        return findings.select(*columns, F.to_json(F.map_from_entries("primary_keys")).alias("primary_key"), "lsn", F.current_timestamp().alias("detected_at"))

    def send(self, findings: DataFrame) -> None:
        writer = self.rows(findings).write.mode("append")
        writer.format("jdbc").options(**self.options).save() if self.options else writer.parquet(self.path)

    def put(self, findings: DataFrame, job: str, number: int) -> None:
        if self.options:
            self.send(findings)
        else:
            self.rows(findings).write.mode("overwrite").parquet(f"{self.path}/job={job}/micro_batch={number}")


@dataclass
class Outbox(Channel):
    """Findings as they are, for another query to stream: a micro-batch that is done again adds nothing."""

    path: str
    name: str

    def send(self, findings: DataFrame) -> None:
        findings.write.mode("append").parquet(self.path)

    def put(self, findings: DataFrame, job: str, number: int) -> None:
        self.send(findings)

    def stream(self, spark: SparkSession) -> DataFrame:
        from ..operators.scan import FINDING

        empty = spark.createDataFrame([], f"{FINDING}, place int")
        empty.write.mode("append").parquet(self.path)  # so that the folder is there
        return spark.readStream.schema(empty.schema).parquet(self.path)


@dataclass
class Log(Channel):
    """The driver's log, by severity; for the few findings a person reads."""

    name: str = "log"

    def send(self, findings: DataFrame) -> None:
        for f in findings.select("*", keys_as_text(F.col("primary_keys")).alias("keys")).toLocalIterator():
            level = {"error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO}[LOG_LEVELS[f.severity]]
            log.log(level, "%s in %s.%s.%s (%s): %s [%s]", f.rule_id, f.schema_name, f.table_name, f.column_name, f.database, f.masked_sample, f["keys"])


@dataclass
class Stdout(Channel):
    name: str = "stdout"

    def send(self, findings: DataFrame) -> None:
        for r in findings.select(payload(F.current_timestamp()).alias("value")).toLocalIterator():
            print(r.value)


def post(url: str, body: bytes, headers: dict[str, str], timeout: float = 5.0, retries: int = 0, wait: Callable[[float], None] = time.sleep) -> None:
    """POST; a server that is asked too much (429) is asked again after the longer of what it says and ``2 ** attempt`` seconds."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json", **headers}, method="POST"), timeout=timeout):
                return
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == retries:
                raise
            said = e.headers.get("Retry-After", "")
            wait(max(float(said) if said.isdigit() else 0.0, float(2**attempt)))


@dataclass
class Webhook(Channel):
    """A POST for each finding, from the executors."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 5.0
    name: str = "webhook"

    def send(self, findings: DataFrame) -> None:
        url, headers, timeout = self.url, self.headers, self.timeout

        def partition(rows) -> None:
            for r in rows:
                post(url, r.value.encode(), headers, timeout)

        findings.select(payload(F.current_timestamp()).alias("value")).foreachPartition(partition)

    def sender(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        url, headers, timeout = self.url, self.headers, self.timeout
        return lambda parts: each(parts, 1, lambda bodies: post(url, bodies[0].encode(), headers, timeout))


def each(parts: Iterator[pd.DataFrame], size: int, send: Callable[[list[str]], None]) -> Iterator[pd.DataFrame]:
    """Rows ``(delivery, body)`` in groups of up to ``size``, sent one after the other; a group that fails does not keep the others."""
    ids, bodies = [], []

    def out() -> pd.DataFrame:
        error = None
        try:
            send(bodies)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        return pd.DataFrame({"delivery": ids, "ok": [error is None] * len(ids), "error": [error] * len(ids)})

    for part in parts:
        for delivery, body in zip(part["delivery"], part["body"], strict=True):
            ids.append(delivery)
            bodies.append(body)
            if len(ids) == size:
                yield out()
                ids, bodies = [], []
    if ids:
        yield out()


def message(findings: list[dict], **sender: str | None) -> dict:
    """A chat message, coloured by the gravest: one finding as what, where, sample and place in the log, more as a heading and two blocks each.

    ``sender`` has what a message says of itself: ``channel``, ``username``, ``icon_emoji``; what is none is left out.
    """

    def text(said: str) -> dict:
        return {"type": "mrkdwn", "text": said}

    def title(f: dict) -> str:
        return f"{SIGNS[f['severity'].lower()]} *{f['severity'].upper()}* \u2014 {f.get('description') or f['rule_id']}"

    gravest = min((f["severity"].lower() for f in findings), key=SEVERITIES.index)
    if len(findings) == 1:
        f = findings[0]
        named = {"Rule": f["rule_id"], "Category": f["category"], "Database": f["database"], "Table": f"{f['schema_name']}.{f['table_name']}", "Column": f["column_name"]}
        blocks = [
            {"type": "section", "text": text(title(f))}, {"type": "section", "fields": [text(f"*{name}*\n{value}") for name, value in named.items()]},
            {"type": "section", "text": text(f"*Sample*\n`{f['masked_sample']}`")}, {"type": "context", "elements": [text(f"LSN: {f['lsn']}")]},
        ]
    else:
        blocks = [{"type": "header", "text": {"type": "plain_text", "text": f"{SIGNS[gravest]} {len(findings)} Sensitive Data Findings"}}]
        for i, f in enumerate(findings):
            where = " \u00b7 ".join([f"`{f['database']}`", f"`{f['schema_name']}.{f['table_name']}.{f['column_name']}`", f"Rule: *{f['rule_id']}*", f"Category: *{f['category']}*", f"LSN: `{f['lsn']}`"])
            blocks += [{"type": "divider"}] if i else []
            blocks += [{"type": "section", "text": text(f"{title(f)}\nSample: `{f['masked_sample']}`")}, {"type": "context", "elements": [text(where)]}]
    return {name: said for name, said in sender.items() if said} | {"attachments": [{"color": COLOURS[gravest], "blocks": blocks}]}


@dataclass
class Chat(Channel):
    """Messages of up to ``batch_size`` findings, from the executors."""

    url: str
    batch_size: int = 8
    retries: int = 3
    name: str = "slack"
    #: How long a finding waits for others, where a stream goes on.
    age_ms: int = 2000
    channel: str | None = None
    username: str | None = None
    icon_emoji: str | None = None
    #: Of servers that want one, as a bearer.
    token: str | None = None

    def send(self, findings: DataFrame) -> None:
        size, send = self.batch_size, self._posts()

        def partition(rows) -> None:
            held: list[str] = []
            for r in rows:
                held.append(r.value)
                if len(held) == size:
                    send(held)
                    held = []
            if held:
                send(held)

        # Severities stay as they are inside messages; payloads have them in capitals.
        findings.select(payload().alias("value")).foreachPartition(partition)

    def body(self) -> Column:
        return payload()

    def sender(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        size, send = self.batch_size, self._posts()
        return lambda parts: each(parts, size, send)

    def message_sender(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Of rows ``(delivery, bodies)``, a message each."""
        send = self._posts()
        return lambda parts: each((p.rename(columns={"bodies": "body"}) for p in parts), 1, lambda one: send(list(one[0])))

    def _posts(self) -> Callable[[list[str]], None]:
        url, retries = self.url, self.retries
        sender = {"channel": self.channel, "username": self.username, "icon_emoji": self.icon_emoji}
        headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        return lambda bodies: post(url, json.dumps(message([json.loads(b) for b in bodies], **sender)).encode(), headers, retries=retries)


def numbered(channels: list[Channel]) -> list[Channel]:
    """Names for several channels of one kind: ``webhook``, or ``webhook-1``, ``webhook-2`` where there are more; repeated names are only warned of."""
    for kind in (Webhook, Chat):
        own = [c for c in channels if isinstance(c, kind)]
        for i, c in enumerate(own, 1):
            c.name = f"{c.name}-{i}" if len(own) > 1 else c.name
    names = [c.name for c in channels]
    for n in sorted({n for n in names if names.count(n) > 1}):
        log.warning("more than one channel is named %s", n)
    return channels


def dispatch(findings: DataFrame, channels: list[Channel], also: Column | None = None, ledger: Ledger | None = None, number: int = 0) -> dict[tuple[str, str], int]:
    """Send to every channel what is meant for it; returns how many findings went out, by (channel, ``ok`` or ``error``).

    With a ledger, what it says of the micro-batch ``number`` is not sent again.
    """
    routed = route(findings if also is None else findings.where(also), [c.name for c in channels]).persist()
    counts = {}
    try:
        sizes = {r.channel: r["count"] for r in routed.groupBy("channel").count().collect()}
        for c in channels:
            if not sizes.get(c.name):
                continue
            mine = routed.where(F.col("channel") == c.name).drop("channel")
            try:
                if ledger:
                    went = ledger.deliver(c, mine, number)
                else:
                    c.send(mine)
                    went = {"ok": sizes[c.name]}
            except Exception:
                log.exception("channel %s failed", c.name)
                went = {"error": sizes[c.name]}
            for status, n in went.items():
                counts[c.name, status] = counts.get((c.name, status), 0) + n
    finally:
        routed.unpersist()
    return counts
