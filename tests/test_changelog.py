"""Logs of captured changes: transactions, relations, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from redactory.sources import changelog, events


def line(**record):
    return (json.dumps(record, separators=(",", ":")) + "\n").encode()


def relation(id, *columns):
    return line(k="relation", id=id, schema="public", table=f"t{id}", columns=[list(c) for c in columns])


ID, A, B = ("id", "int8", True), ("a", "text", False), ("b", "text", False)
HEADER = line(k="header", relations=[], commit=None)


def collected(df):
    return sorted((r.commit_lsn, r.start_lsn, r.action, r.table_name, tuple((c.name, c.value) for c in r.columns), tuple((k.name, k.value) for k in r.primary_keys)) for r in df.collect())


def test_relations_and_partial_updates(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    first = [HEADER, line(k="begin", commit=10), relation(1, ID, A), line(k="insert", rel=1, lsn=7, values=["1", "x"]), relation(1, ID, B, A), line(k="update", rel=1, lsn=8, values=["1", "z"], missing=[1]), line(k="commit", commit=10)]
    (log / "00000000000000000010-000000.jsonl").write_bytes(b"".join(first))
    # The next segment begins inside a transaction and knows its relations from its first line.
    known = [json.loads(relation(1, ID, B, A)), json.loads(relation(2, A))]
    second = [line(k="header", relations=known, commit=20), line(k="delete", rel=1, lsn=15, values=["1", None, None]), line(k="insert", rel=2, lsn=16, values=[None]), line(k="commit", commit=20), line(k="begin", commit=30), line(k="insert", rel=2, lsn=21, values=["open"])]
    (log / "00000000000000000020-000001.jsonl").write_bytes(b"".join(second))
    got = changelog.read(spark, str(log), "h/d")
    assert collected(got) == [
        (10, 7, "INSERT", "t1", (("id", None), ("a", "x")), (("id", "1"),)), (10, 8, "UPDATE", "t1", (("id", None), ("a", "z")), (("id", "1"),)),
        (20, 15, "DELETE", "t1", (), (("id", "1"),)), (20, 16, "INSERT", "t2", (("a", None),), ()),
    ]
    assert {r.database for r in got.collect()} == {"h/d"} and collected(events.changes(got)) == [x for x in collected(got) if x[2] != "DELETE"]


def test_restart_in_the_middle_of_a_transaction(spark, tmp_path):
    """Nothing appears before its commit, and nothing is lost or repeated, wherever the log was cut."""
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    whole, want = [], []
    for commit in range(10, 80, 10):
        whole.append(line(k="begin", commit=commit))
        for i in range(3):
            whole.append(line(k="insert", rel=1, lsn=commit - 5 + i, values=[str(commit + i), f"v{commit}é"]))
            want.append((commit, commit - 5 + i))
        whole.append(line(k="commit", commit=commit))
    one, two = log / "00000000000000000010-000000.jsonl", log / "00000000000000000040-000001.jsonl"
    relations = [json.loads(relation(1, ID, A))]
    first, second = line(k="header", relations=relations, commit=None) + b"".join(whole[:17]), line(k="header", relations=relations, commit=40) + b"".join(whole[17:])

    def go():
        q = changelog.stream(spark, str(log)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.commit_lsn, r.start_lsn) for r in spark.read.parquet(str(out)).collect())

    seen = []
    for size in (len(first) - len(b"".join(whole[6:17])), len(first) - 10, len(first)):  # the second cut is inside a line, the third inside transaction 40
        one.write_bytes(first[:size])
        seen.append(go())
    assert [len(x) for x in seen] == [3, 9, 9] and seen[-1] == want[:9]
    for size in (60, len(second) // 2, len(second)):
        two.write_bytes(second[:size])
        got = go()
        assert got == want[: len(got)] and len(got) % 3 == 0
    assert got == want and collected(changelog.read(spark, str(log))) == collected(spark.read.schema(events.EVENT).parquet(str(out)))


def test_bounded_micro_batches(spark, tmp_path):
    log, sizes, files = tmp_path / "log", [], []
    log.mkdir()
    for n in range(6):
        body = [HEADER if n != 3 else line(k="header", relations=[json.loads(relation(1, A))], commit=30)]
        body += [] if n == 3 else [line(k="begin", commit=10 * (n + 1)), relation(1, A)]
        body += [line(k="insert", rel=1, lsn=n, values=["x"])] + ([] if n == 2 else [line(k="commit", commit=30 if n == 3 else 10 * (n + 1))])
        files.append((log / f"{30 if n == 3 else 10 * (n + 1):020d}-{n:06d}.jsonl", b"".join(body)))
    files[0][0].write_bytes(files[0][1])
    q = changelog.stream(spark, str(log), max_segments=1).writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="2 seconds").start()
    q.processAllAvailable()
    for path, body in files[1:]:
        path.write_bytes(body)
    for _ in range(6):
        q.processAllAvailable()
    q.stop()
    assert [s for s in sizes if s] == [1, 1, 2, 1, 1]  # the transaction of two segments is taken whole


def test_written_logs_are_read_back(spark, tmp_path):
    """One transaction with a third of all changes is in several segments."""
    n = 3000
    rows = spark.range(1, n + 1).select(F.lit("h/d").alias("database"), (F.col("id") % 2).alias("table_id"), F.lit("s").alias("schema_name"), F.concat(F.lit("t"), F.col("id") % 2).alias("table_name"), F.when(F.col("id") % 5 == 0, "UPDATE").otherwise("INSERT").alias("action"),
        F.array(F.struct(F.lit("a").alias("name"), F.lit("text").alias("type_name"), F.concat(F.lit('é"\n'), "id").alias("value")), F.struct(F.lit("n").alias("name"), F.lit("int4").alias("type_name"), F.lit(None).cast("string").alias("value"))).alias("columns"),
        F.array(F.struct(F.lit("n").alias("name"), F.col("id").cast("string").alias("value"))).alias("primary_keys"), F.col("id").alias("start_lsn"), F.when(F.col("id").between(1000, 2000), 2000).otherwise(F.col("id") + 1).alias("commit_lsn"))
    rows = spark.createDataFrame(rows.rdd, events.EVENT)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would else be one range
    try:
        changelog.write(rows, str(tmp_path / "log"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert collected(changelog.read(spark, str(tmp_path / "log"), "h/d")) == collected(rows)
    assert len(list((tmp_path / "log").glob("*.jsonl"))) == 4
    assert changelog.read(spark, str(tmp_path / "none")).count() == 0


def test_changes_without_commit_action_or_key(spark, tmp_path):
    """They are one transaction before all others, those with commits below 0 too; a stream reads the same."""
    kinds = "lsn long, commit long, action string, key string, a string"
    rows = [(None, None, None, None, f"x{i}") for i in range(200)] + [(None, None, "INSERT", "7", None), (-1, 50, None, "-1", "y"), (-70, -50, "UPDATE", "-70", "z"), (-120, -100, "DELETE", "-120", "z"), (0, 0, "INSERT", "0", "é"), (3, 50, "INSERT", "3", None)]
    df = spark.createDataFrame(rows, kinds).repartition(3).select("key", "a", "action", "lsn", "commit")
    made = events.from_table(df.select("key", "a", "action", "lsn", "commit"), "h/d", "s", "t", ["key"], action=F.col("action"), lsn=F.col("lsn"))
    made = made.withColumn("columns", F.filter("columns", lambda c: c["name"].isin("key", "a")))
    commits = df.select(F.col("lsn").alias("start_lsn"), "commit").where("lsn IS NOT NULL")
    made = made.join(commits, "start_lsn", "left").withColumn("commit_lsn", F.col("commit")).select(*made.columns)
    log = str(tmp_path / "log")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        changelog.write(made, log)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = lambda d: sorted((str(r.start_lsn), str(r.commit_lsn), str(r.action), str([k.value for k in r.primary_keys]), str([c.value for c in r.columns if c.name == "a"])) for r in d.collect())
    sent = lambda action, a: str([a] if action in ("INSERT", "UPDATE") else [])
    want = sorted((str(lsn), str(commit), str(action), str([] if key is None else [key]), sent(action, a)) for lsn, commit, action, key, a in rows)
    assert seen(changelog.read(spark, log, "h/d")) == want
    q = changelog.stream(spark, log, "h/d", max_segments=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and seen(spark.read.schema(events.EVENT).parquet(str(tmp_path / "out"))) == want


def test_orders_without_keys_and_below_zero(spark, tmp_path):
    """As the SQL of the query has them."""
    from redactory.plans import catalogue

    spark.createDataFrame([(None, "O", "1-URGENT"), (None, "F", None), (-1, "O", "a"), (-50, "P", "b"), (-51, None, "c"), (-101, "O", "d"), (0, "O", "e"), (8, None, None)], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in catalogue.queries()["src_change_log"](spark, str(tmp_path)).collect()}
    nothing = (None,) * 6
    assert got == {nothing, (-1, 50, None, "-1", None, None), (-50, 0, "TRUNCATE", "-50", None, None), (-51, 0, "DELETE", "-51", None, None), (-101, -50, None, "-101", None, None), (0, 50, "INSERT", "0", "O", "e"), (8, 50, "INSERT", "8", None, None)}
    assert catalogue.queries()["src_change_log"](spark, str(tmp_path)).where("lsn IS NULL").count() == 2


@pytest.mark.parametrize("folder", ["{}/plain", "viewfs://changes/shared/a/view"])
def test_shared_folders_of_a_cluster(spark, tmp_path, monkeypatch, folder):
    """A path without a scheme under a master that is not local, and one in a view of another store."""
    from redactory.plans import catalogue
    from redactory.streaming import folders

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(folders, "scratch", lambda spark, name: folder.format(tmp_path))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.changes.link./shared", f"file://{tmp_path}")
    spark.createDataFrame([(k, "O", "a") for k in range(1, 200)], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(r.lsn for r in catalogue.queries()["src_change_log"](spark, str(tmp_path)).collect()) == list(range(1, 200))
    assert list(tmp_path.rglob("*.jsonl"))


def test_segments_that_the_driver_does_not_see(spark, tmp_path, monkeypatch):
    made = events.from_table(spark.range(10), "h/d", "s", "t", ["id"], lsn=F.col("id"))
    monkeypatch.setattr(changelog.Segments, "names", lambda self: [])
    with pytest.raises(ValueError, match="do not share"):
        changelog.write(made, str(tmp_path / "own"))
