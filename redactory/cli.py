"""``python -m redactory rules list|test|bench``, ``scan`` (a table once), ``run`` (streams by settings) and ``validate``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config, probe, validate
from .functions.text import duration
from .operators.metrics import percentiles
from .operators.rules import Engine, load
from .operators.scan import scan_table, scan_values
from .sources.events import lines, synthetic
from .streaming.job import run_all

SHIPPED = Path(__file__).parent / "rules.toml"


def session() -> SparkSession:
    return SparkSession.builder.appName("redactory").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def list_rules(path: Path) -> int:
    rules = load(path)
    print(f"{'ID':<25} {'TYPE':<8} {'SEVERITY':<10} {'CATEGORY':<12} DESCRIPTION\n{'-' * 85}")
    for r in rules:
        print(f"{r.id:<25} {r.kind:<8} {r.severity.upper():<10} {r.category:<12} {r.description}")
    print(f"\n{len(rules)} rules loaded")
    return 0


def test_rules(path: Path, value: str) -> int:
    found = scan_values(session().createDataFrame([(value,)], "value string"), Engine(load(path))).orderBy("place").collect()
    for r in found:
        print(f"{r.rule_id}  {r.severity.upper()}  {r.category}  {r.masked_sample}")
    print(f"{len(found)} matches" if found else "no match")
    return 0


def bench_rules(path: Path, values, iterations: int, as_json: bool) -> int:
    """Each rule alone and all together over the same values; a row a run, then Spark's percentiles."""
    spark, rules = session(), load(path)
    values = values.persist()
    n = values.count()
    timed = []
    for name, engine in [*[(r.id, Engine([r])) for r in rules], ("all rules", Engine(rules))]:
        for _ in range(iterations):
            start = time.perf_counter()
            matches = values.select(F.sum(F.size(engine.matches(F.col("value"))))).first()[0]
            timed.append((name, (time.perf_counter() - start) * 1e6 / max(1, n), matches))
    runs = spark.createDataFrame(timed, "rule string, us double, matches long")
    stats = percentiles(runs, "us", [50, 95, 99], "rule").groupBy("rule").pivot("p", [50, 95, 99]).agg(F.first("value"))
    table = runs.groupBy("rule").agg(F.avg("us").alias("mean"), F.max("matches").alias("matches")).join(stats, "rule").orderBy(F.desc("mean"))
    for r in table.select("rule", "matches", *[(F.col(c) if as_json else duration(F.col(c))).alias(f"t{c}") for c in ("mean", "50", "95", "99")]).collect():
        print(json.dumps(r.asDict()) if as_json else f"{r.rule:<25} {r.matches:>8} matches  mean {r.tmean}  p50 {r.t50}  p95 {r.t95}  p99 {r.t99} a value")
    return 0


def check(path: Path, connect: bool = False) -> int:
    config = Config.load(path)
    report = validate(config)
    if connect and not any(phase == "alerts" and state == "error" for phase, state, _ in report):
        report += probe(config, session())
    for phase, state, message in report:
        print(f"[{state}] {phase}: {message}")
    errors, warnings = (sum(s == x for _, s, _ in report) for x in ("error", "warning"))
    print(f"{errors} errors, {warnings} warnings")
    return int(errors > 0)


def run(path: Path, once: bool) -> int:
    """The streams that settings describe, until they end; ``once``: what there is now."""
    config = Config.load(path)
    config.logging()
    if any(state == "error" for _, state, _ in validate(config)):
        return check(path)
    ended = run_all(session(), config, {"availableNow": True} if once else None)
    for name, how in sorted(ended.items()):
        print(f"{name}: {how}")
    return int("failed" in ended.values())


def scan(args) -> int:
    """A table of a file or folder, scanned once; findings go to the output as JSON or Parquet."""
    df = session().read.format(args.format).load(args.input)
    found = scan_table(df, Engine(load(args.rules)), args.database, args.schema, args.table, args.key)
    found.write.mode("overwrite").format("json" if args.output.endswith(".json") else "parquet").save(args.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="redactory")
    verbs = p.add_subparsers(dest="verb", required=True)
    rules = verbs.add_parser("rules").add_subparsers(dest="what", required=True)
    for what in ("list", "test", "bench"):
        sub = rules.add_parser(what)
        sub.add_argument("--rules", type=Path, default=SHIPPED)
        if what == "test":
            sub.add_argument("--input", required=True)
        if what == "bench":
            sub.add_argument("--file")
            sub.add_argument("--input")
            sub.add_argument("--generate", type=int, default=100)
            sub.add_argument("--iterations", type=int, default=5)
            sub.add_argument("--json", action="store_true")
    sub = verbs.add_parser("validate")
    sub.add_argument("--config", type=Path, required=True)
    sub.add_argument("--connect", action="store_true")
    sub = verbs.add_parser("run")
    sub.add_argument("--config", type=Path, required=True)
    sub.add_argument("--once", action="store_true")
    sub = verbs.add_parser("scan")
    sub.add_argument("--rules", type=Path, default=SHIPPED)
    sub.add_argument("--format", default="parquet")
    for name, default in (("input", None), ("output", None), ("database", "local"), ("schema", "public"), ("table", "table")):
        sub.add_argument(f"--{name}", default=default, required=default is None)
    sub.add_argument("--key", action="append", default=[])
    args = p.parse_args(argv)
    if args.verb == "validate":
        return check(args.config, args.connect)
    if args.verb == "run":
        return run(args.config, args.once)
    if args.verb == "scan":
        return scan(args)
    if args.what == "list":
        return list_rules(args.rules)
    if args.what == "test":
        return test_rules(args.rules, args.input)
    if not args.file and args.input is None and args.generate <= 0:
        p.error("--generate must be more than 0")
    spark = session()
    values = lines(spark, args.file) if args.file else spark.createDataFrame([(args.input,)], "value string") if args.input is not None else synthetic(spark, args.generate)
    return bench_rules(args.rules, values, args.iterations, args.json)


if __name__ == "__main__":
    sys.exit(main())
