"""Events, scans, windows, routing, and the queries against their SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactory.operators import dedup, metrics, routing, scan
from redactory.operators.rules import Engine, Rule, Scope
from redactory.plans import catalogue
from redactory.sources import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(map(tuple, df.select(*names).collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        order = sorted(range(len(r.description)), key=lambda i: r.description[i][0])
        assert [r.description[i][0] for i in order] == names
        assert got == sorted((tuple(row[i] for i in order) for row in r.fetchall()), key=repr)
    else:
        assert got


def test_only_needed_columns_are_read(spark):
    found = scan.scan_table(spark.read.parquet(f"{SF}/customer.parquet"), Engine([Rule("a", pattern="x", scope=Scope(include_columns=["c_name"]))]), "d", "s", "customer", ["c_custkey"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan and "Exchange" not in plan


def test_fnv():
    assert events.pipeline_id("localhost/postgres") == 4805646283342402756


def test_cells(spark):
    df = spark.range(1).select(
        F.lit(None).cast("string").alias("none"), F.lit("hello").alias("s"), F.lit(42).alias("i"), F.lit(True).alias("b"), F.lit(1.5).alias("d"), F.lit(1.0).alias("w"), F.lit(b"x").alias("x"), F.array(F.lit("a"), F.lit(None), F.lit("b")).alias("l"), F.array(F.lit(b"x"), F.lit(None)).alias("lb"),
        F.lit(1e10).alias("big"), F.lit(1.5e-7).alias("small"),
    )
    values = df.select(*[events.text(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert list(values) == [None, "hello", "42", "true", "1.5", "1", None, "{a,NULL,b}", "{<bytes>,NULL}", "10000000000", "0.00000015"]
    assert events.scanned_columns(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType()), T.StructField("c", T.ArrayType(T.LongType()))])) == ["a", "c"]


def _events(spark):
    rows = [
        ("localhost/db", 1, "public", "t1", "INSERT", [("c1", "text", "ALPHA-1"), ("c2", "text", "clean"), ("n", "int4", None), ("z", "text", None)], [("id", "1"), ("c1", "ALPHA-1"), ("c2", "clean")], 100, 200),
        ("localhost/db", 1, "public", "t1", "DELETE", [("c1", "text", "ALPHA-2")], [("id", "2")], 100, 201), ("localhost/db", 1, "audit", "t1", "UPDATE", [("c1", "text", "ALPHA-3"), ("c9", "text", "ALPHA-4")], [], 100, 202),
    ]
    return spark.createDataFrame(rows, events.EVENT)


@pytest.mark.parametrize("how", [scan.scan_events, scan.scan_cells])
def test_scan_of_events(spark, how):
    engine = Engine([Rule("alpha", category="CAT", severity="critical", pattern=r"ALPHA-\d+", scope=Scope(exclude_columns=["c9"]))])
    found = how(_events(spark), engine).orderBy("lsn").collect()
    assert [(f.lsn, f.column_name, [k.name for k in f.primary_keys]) for f in found] == [(200, "c1", ["id", "c2"]), (202, "c1", [])]
    kept = how(_events(spark), engine, scan.Filter(include_schemas=["pub*"], exclude_columns=["c1"]))
    assert kept.count() == 0


def test_scope_cases():
    cases = [({}, True), ({"include_schemas": ["public"]}, True), ({"include_schemas": ["other"]}, False), ({"include_tables": ["t*"]}, True), ({"exclude_tables": ["t1"]}, False), ({"include_columns": ["c2"]}, False), ({"exclude_columns": ["c?"]}, False), ({"include_tables": ["t1"], "exclude_columns": ["x"]}, True)]
    for given, there in cases:
        assert Scope(**given).matches("public", "t1", "c1") is there


def test_window(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 299, 300, 301, 599, 600)] + [("b", 5), ("b", 5), (None, 1), (None, 2)], "k string, t long")
    passed = sorted((r.k or "", r.t) for r in dedup.in_window(df, ["k"], "t", 300).collect())
    assert passed == [("", 1), ("a", 0), ("a", 300), ("a", 600), ("b", 5)]
    assert dedup.in_window(df, ["k"], "t", 0).count() == 10


def test_routing(spark):
    df = spark.createDataFrame([(1, None), (2, ["a"]), (3, ["a", "c", "no"]), (4, [])], "i int, channels array<string>")
    assert sorted((r.i, r.channel) for r in routing.route(df, ["a", "b", "c"]).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "a"), (3, "c")]


def test_payload(spark):
    engine = Engine([Rule("alpha", category="CAT", severity="critical", pattern=r"ALPHA-\d+")])
    said = [json.loads(r[0]) for r in scan.scan_events(_events(spark), engine).orderBy("lsn").select(routing.payload(F.lit("2024-01-02 03:04:05").cast("timestamp"))).collect()]
    assert said[0]["severity"] == "CRITICAL" and said[0]["primary_key"] == {"c2": "clean", "id": "1"} and said[0]["timestamp"].startswith("2024-01-02T03:04:05")
    assert "primary_key" not in said[1] and "value_hash" not in said[0]


def test_percentiles(spark):
    got = metrics.percentiles(spark.range(1, 101).withColumnRenamed("id", "x"), "x", [50, 95, 99]).collect()
    assert sorted((r.p, r.value) for r in got) == [(50, 51), (95, 96), (99, 100)]


def test_percentiles_of_ties_nulls_and_groups(spark):
    rows = [("a", float(x % 7)) for x in range(500)] + [(None, 3.0)] * 40 + [("b", None)] + [("c", -1.5)] + [("d", float(x * x)) for x in range(5000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {(r.k, r.p): r.value for r in metrics.percentiles(df, "v", [0, 1, 50, 99, 100], "k").collect()}
    true = {}
    for k in ("a", None, "c", "d"):
        own = sorted(v for g, v in rows if g == k and v is not None)
        true |= {(k, p): own[min(len(own) * p // 100, len(own) - 1)] for p in (0, 1, 50, 99, 100)}
    assert got == true
    assert metrics.percentiles(df.where("false"), "v", [50], "k").collect() == []
