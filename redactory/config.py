"""Settings: defaults, then a TOML file, then environment variables ``REDACTORY__A__B``; checked as a whole."""

from __future__ import annotations

import json
import logging
import os
import sys
import tomllib
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from pathlib import Path

from .operators.rules import RuleError, load
from .operators.scan import Filter
from .streaming.sinks import Channel, Chat, Jsonl, Log, Stdout, Table, Webhook, numbered

DEFAULTS = {"rules": "rules.toml", "databases": [], "filter": {}, "store": {"type": "memory"}, "alerts": {"dedup_window_secs": 300, "log": {"enabled": True}}, "profiling": False, "log": {"level": "info", "format": "console", "output": "stderr"}, "server": {"enabled": False}, "pipeline": {"max_files_per_trigger": 1000, "retry_delay_ms": 10_000, "retry_max_attempts": 5}}


def secret(value: str | dict) -> str:
    """A value as such, or ``{file = ...}``: the file's text without white space at its end."""
    return Path(value["file"]).read_text().rstrip() if isinstance(value, dict) else value


def _merge(base: dict, more: dict) -> dict:
    out = dict(base)
    for k, v in more.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _from_env(env: dict[str, str], prefix: str) -> dict:
    out: dict = {}
    for name, value in env.items():
        if name.startswith(f"{prefix}__"):
            *path, last = name[len(prefix) + 2 :].lower().split("__")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            try:
                at[last] = tomllib.loads(f"x = {value}")["x"]
            except tomllib.TOMLDecodeError:
                at[last] = value
    return out


@dataclass
class Config:
    raw: dict
    folder: Path = field(default_factory=Path)

    @classmethod
    def load(cls, path: str | Path, env: dict[str, str] | None = None) -> Config:
        path = Path(path)
        raw = _merge(_merge(DEFAULTS, tomllib.loads(path.read_text())), _from_env(dict(os.environ if env is None else env), "REDACTORY"))
        return cls(raw, path.parent)

    def filter_of(self, database: dict) -> Filter:
        """A database's own filter replaces the common one as a whole."""
        return Filter(**(database["filter"] if "filter" in database else self.raw["filter"]))

    def logging(self) -> None:
        """Set up the library's log: level, lines for people or JSON, and where they go."""
        said = self.raw["log"]
        handler = logging.FileHandler(said["output"]) if said["output"] not in ("stderr", "stdout") else logging.StreamHandler(getattr(sys, said["output"]))
        handler.setFormatter(JsonLines() if said["format"] == "json" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log = logging.getLogger("redactory")
        log.handlers, log.propagate = [handler], False
        log.setLevel({"trace": "DEBUG", "warn": "WARNING"}.get(said["level"], said["level"].upper()))

    @property
    def rules_path(self) -> Path:
        return self.folder / self.raw["rules"]

    def channels(self) -> list[Channel]:
        a, out = self.raw["alerts"], []
        if a.get("log", {}).get("enabled"):
            out.append(Log())
        if a.get("stdout", {}).get("enabled"):
            out.append(Stdout())
        for key, kind in (("jsonl", Jsonl), ("table", Table)):
            if key in a:
                out.append(kind(**a[key]))
        out += [Webhook(**w | {"url": secret(w["url"])}) for w in a.get("webhook", [])] + [Chat(**w | {"url": secret(w["url"])} | ({"token": secret(w["token"])} if "token" in w else {})) for w in a.get("slack", [])]
        return numbered(out)


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        said = {"time": self.formatTime(record), "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage()}
        return json.dumps(said | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}))


def probe(config: Config, spark=None, timeout: float = 5.0) -> list[tuple[str, str, str]]:
    """Whether channels and databases can be reached: a HEAD request, the smallest query, or the source's columns. Nothing stops at the first error."""
    out: list[tuple[str, str, str]] = []

    def attempt(phase: str, name: str, f) -> None:
        try:
            out.append((phase, "ok", f"{name}: {f()}"))
        except Exception as e:
            out.append((phase, "error", f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}"))

    def head(url: str) -> str:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
                return f"answered {r.status}"
        except urllib.error.HTTPError as e:
            return f"answered {e.code}"

    def query(options: dict) -> str:
        spark.read.format("jdbc").options(**{k: v for k, v in options.items() if k != "dbtable"}, query="SELECT 1 AS one").load().collect()
        return "SELECT 1 succeeded"

    for c in config.channels():
        if isinstance(c, Webhook | Chat):
            attempt("alerts", c.name, lambda c=c: head(c.url))
        elif isinstance(c, Table) and c.options and spark:
            attempt("alerts", c.name, lambda c=c: query(c.options))
    for d in config.raw["databases"] if spark else []:
        name, said = f"{d.get('host')}/{d.get('name')}", d.get("source")
        if said and "jdbc" in said:
            attempt("databases", name, lambda s=said: query(s["jdbc"]))
        elif said and "path" in said:
            attempt("databases", name, lambda s=said: f"{len(spark.read.format(s.get('format', 'parquet')).load(s['path']).columns)} columns")
    return out


def _is_url(value: object) -> bool:
    return isinstance(value, str) and value.strip() == value and value.startswith(("http://", "https://"))


def validate(config: Config) -> list[tuple[str, str, str]]:
    """``(phase, "ok" | "warning" | "error", message)`` for everything that is checked; nothing stops at the first error."""
    out: list[tuple[str, str, str]] = []
    add = lambda *x: out.append(x)
    raw = config.raw
    ids = [f"{d.get('host', '')}/{d.get('name', '')}" for d in raw["databases"]]
    if not ids:
        add("databases", "error", "no database is named")
    for d, i in zip(raw["databases"], ids, strict=True):
        for key in ("host", "name"):
            if not str(d.get(key, "")).strip():
                add("databases", "error", f"{i}: {key} is blank")
    for i in sorted({i for i in ids if ids.count(i) > 1}):
        add("databases", "error", f"{i} is named more than once")
    if ids and not any(p == "databases" for p, *_ in out):
        add("databases", "ok", ", ".join(sorted(ids)))
    if raw["store"].get("type") not in ("memory", "checkpoint"):
        add("store", "error", f"no store {raw['store'].get('type')!r}")
    elif raw["store"]["type"] == "memory":
        add("store", "warning", "places in the streams are lost when the job ends")
    if raw["store"].get("type") == "checkpoint" and not str(raw["store"].get("path", "")).strip():
        add("store", "error", "path is blank")
    level, shape = raw["log"].get("level"), raw["log"].get("format")
    if level not in ("trace", "debug", "info", "warn", "error") or shape not in ("console", "json"):
        add("log", "error", f"no level {level!r}" if shape in ("console", "json") else f"no format {shape!r}")
    a = raw["alerts"]
    for kind in ("webhook", "slack"):
        for n, w in enumerate(a.get(kind, []), 1):
            try:
                if not _is_url(secret(w.get("url", ""))):
                    add("alerts", "error", f"{kind}-{n}: not an address: {w.get('url')!r}")
            except OSError as e:
                add("alerts", "error", f"{kind}-{n}: {e}")
            if kind == "slack" and int(w.get("batch_size", 8)) < 1:
                add("alerts", "error", f"slack-{n}: batch_size must be at least 1")
    for key in ("jsonl", "table"):
        if key in a and not str(a[key].get("path", "")).strip():
            add("alerts", "error", f"{key}: path is blank")
    if a.get("dedup_window_secs", 0) < 0:
        add("alerts", "error", "dedup_window_secs is negative")
    names: set[str] = set()
    if not any(p == "alerts" and s == "error" for p, s, _ in out):
        names = {c.name for c in config.channels()}
        add("alerts", "ok" if names else "warning", ", ".join(sorted(names)) or "no channel")
    try:
        rules = load(config.rules_path)
        add("rules", "ok", f"{len(rules)} rules")
        for r in rules:
            for c in sorted(set(r.channels or []) - names):
                add("rules", "warning", f"{r.id}: no channel {c}")
    except (OSError, RuleError, ValueError) as e:
        add("rules", "error", str(e))
    return out
