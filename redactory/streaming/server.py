"""Health and metrics of a running job over HTTP, on the driver."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..operators.metrics import BUCKETS

#: Names of metrics with their kind, help text and labels.
METRICS = {
    "events": ("redactory_events_total", "counter", "Events of micro-batches", ("database",)),
    "findings": ("redactory_findings_total", "counter", "Findings before the dedup window", ("database", "category", "severity")),
    "alerts": ("redactory_alerts_total", "counter", "Findings sent", ("channel", "status")),
    "suppressed": ("redactory_suppressed_total", "counter", "Findings held back by the dedup window", ("database",)),
    "skipped": ("redactory_skipped_total", "counter", "Events that a filter skipped", ("reason",)),
    "script_errors": ("redactory_script_errors_total", "counter", "Cells for which a function failed", ("rule_id",)),
    "reconnects": ("redactory_restarts_total", "counter", "Restarts of a failed stream", ("database",)),
    "reloads": ("redactory_rule_reloads_total", "counter", "Rules read anew", ("status",)),
    "rules": ("redactory_rules_loaded", "gauge", "Rules in use", ()),
    "connected": ("redactory_stream_running", "gauge", "Whether a database's stream runs", ("database",)),
    "queue": ("redactory_input_rows", "gauge", "Rows of the last micro-batch", ("database",)),
    "rule_seconds": ("redactory_rule_seconds_total", "counter", "Seconds that a rule took alone, while profiling", ("rule_id",)),
}


#: Histograms with their help texts and labels; bounds are those of :data:`metrics.BUCKETS`.
HISTOGRAMS = {
    "batch_size": ("Events of a micro-batch", ()),
    "scan_duration_seconds": ("Seconds of a micro-batch from scan to delivery", ()),
    "dispatch_duration_seconds": ("Seconds of a micro-batch's deliveries", ()),
    "rule_scan_duration_seconds": ("Seconds that a rule took alone over a micro-batch, while profiling", ("rule_id",)),
}


def add_to(counts: Counter, name: str, value: float, *labels: str) -> None:
    """One more value of a histogram; counts add up over micro-batches and jobs."""
    counts["histogram", name, *labels, "sum"] += value
    counts["histogram", name, *labels, "count"] += 1
    for bound in BUCKETS[name]:
        counts["histogram", name, *labels, bound] += value <= bound


def _histograms(counts: Counter) -> list[str]:
    out, held = [], {k[1:]: v for k, v in list(counts.items()) if k[0] == "histogram"}
    for name, (said, labels) in HISTOGRAMS.items():
        full = f"redactory_{name}"
        out += [f"# HELP {full} {said}", f"# TYPE {full} histogram"]
        for of in sorted(k[1:-1] for k in held if k[0] == name and k[-1] == "count"):
            pairs = [f'{label}="{_quoted(x)}"' for label, x in zip(labels, of, strict=True)]
            ends = [(f"{b:g}", held[name, *of, b]) for b in BUCKETS[name]] + [("+Inf", held[name, *of, "count"])]
            out += [f"{full}_bucket{{{','.join([*pairs, f'le="{le}"'])}}} {n:g}" for le, n in ends]
            shown = f"{{{','.join(pairs)}}}" if pairs else ""
            out += [f"{full}_sum{shown} {held[name, *of, 'sum']:g}", f"{full}_count{shown} {held[name, *of, 'count']:g}"]
    return out


def _quoted(text: object) -> str:
    return str(text).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def render(counts: Counter) -> str:
    """The counts ``(metric, label values...)`` in the text format that metric collectors read."""
    out = []
    for key, (name, kind, said, labels) in METRICS.items():
        out += [f"# HELP {name} {said}", f"# TYPE {name} {kind}"]
        for of, value in sorted((k, v) for k, v in list(counts.items()) if k[0] == key):
            pairs = ",".join(f'{label}="{_quoted(x)}"' for label, x in zip(labels, of[1:], strict=True))
            out.append(f"{name}{f'{{{pairs}}}' if pairs else ''} {value:g}")
    return "\n".join([*out, *_histograms(counts), ""])


class Server:
    """``/health``, ``/ready`` and ``/metrics``; ready while :attr:`ready` is set."""

    def __init__(self, counts: Counter, host: str = "127.0.0.1", port: int = 0):
        self.ready = threading.Event()
        ready = self.ready

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                status, kind, body = 404, "application/json", json.dumps({"status": "not_found"})
                if self.path == "/health":
                    status, body = 200, json.dumps({"status": "ok"})
                elif self.path == "/ready":
                    status, body = (200, json.dumps({"status": "ready"})) if ready.is_set() else (503, json.dumps({"status": "not_ready"}))
                elif self.path == "/metrics":
                    status, kind, body = 200, "text/plain; version=0.0.4; charset=utf-8", render(counts)
                data = body.encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args) -> None:
                pass

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.port = self.http.server_port
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def close(self) -> None:
        self.http.shutdown()
        self.http.server_close()
