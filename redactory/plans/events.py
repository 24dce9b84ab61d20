"""Sources and events."""

from pyspark.sql import functions as F

from ..functions import sql
from ..sources import changelog, events
from .registry import query, table


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def src_scan_parquet(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _captured(spark, sf):
    """Orders as captured changes, of all kinds."""
    orders = table(spark, sf, "orders")
    kinds = F.element_at(F.array(*map(F.lit, ("INSERT", "UPDATE", "DELETE", "TRUNCATE", "BEGIN", "COMMIT"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return events.from_table(orders, "localhost/orders", "public", "orders", ["o_orderkey"], action=kinds, lsn=F.col("o_orderkey"))


_CAPTURED = """SELECT o_orderkey AS lsn, ['INSERT','UPDATE','DELETE','TRUNCATE','BEGIN','COMMIT'][o_orderkey % 6 + 1] AS action FROM orders"""


@query(f"SELECT lsn, action FROM ({_CAPTURED}) WHERE action IN ('INSERT', 'UPDATE')")
def src_ignore_non_dml(spark, sf):
    return events.changes(_captured(spark, sf)).select(F.col("commit_lsn").alias("lsn"), "action")


@query(f"SELECT action, count(*) AS n FROM ({_CAPTURED}) WHERE action IN ('INSERT', 'UPDATE') GROUP BY action")
def event_action_filter(spark, sf):
    return events.changes(_captured(spark, sf)).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT 'localhost/part' AS database, 'public' AS schema_name, 'part' AS table_name, 'INSERT' AS action, CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_brand AS brand, p_partkey AS lsn FROM part")
def event_from_insert(spark, sf):
    e = events.from_table(table(spark, sf, "part"), "localhost/part", "public", "part", ["p_partkey"], lsn=F.col("p_partkey"))
    value = lambda name: F.filter("columns", lambda c: c["name"] == name)[0]["value"]
    return e.select("database", "schema_name", "table_name", "action", F.col("primary_keys")[0]["value"].alias("key"), value("p_name").alias("name"), value("p_brand").alias("brand"), F.col("commit_lsn").alias("lsn"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'c_custkey,c_name,c_nationkey,c_mktsegment' ELSE 'c_custkey,c_nationkey,c_acctbal,c_mktsegment' END AS names FROM customer")
def event_from_partial_update(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    missing = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(3))).otherwise(F.array(F.lit(1)))
    return c.select("c_custkey", F.array_join(F.transform(events.partial(events.cells(c), missing), lambda x: x["name"]), ",").alias("names"))


@query("""SELECT p_partkey, n AS place, ['p_partkey','p_name','p_brand','p_type','p_size','p_retailprice'][n + 1] AS name, [NULL, p_name, p_brand, p_type, NULL, NULL][n + 1] AS value
FROM part, (SELECT unnest(range(0, 6)) AS n)""")
def event_unpivot(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return p.select("p_partkey", F.posexplode(events.cells(p)).alias("place", "c")).select("p_partkey", F.col("place").cast("bigint").alias("place"), "c.name", "c.value")


@query("""SELECT c_custkey, c_name AS name_text, CAST(c_custkey AS VARCHAR) AS key_text, CAST(c_nationkey AS VARCHAR) AS nation_text, CAST(c_custkey % 2 = 0 AS VARCHAR) AS flag_text,
CAST(CAST(c_custkey AS BIGINT) AS VARCHAR) AS whole_text, CAST(DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS VARCHAR) AS day_text FROM customer""")
def cell_to_text(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", (F.col("c_custkey") % 2 == 0).alias("flag"), F.col("c_custkey").cast("double").alias("whole"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).alias("day"))
    t = lambda n: events.text(F.col(n), c.schema[n].dataType)
    return c.select("c_custkey", t("c_name").alias("name_text"), t("c_custkey").alias("key_text"), t("c_nationkey").alias("nation_text"), t("flag").alias("flag_text"), t("whole").alias("whole_text"), t("day").alias("day_text"))


@query("""SELECT p_partkey, '{' || p_brand || ',' || CASE WHEN p_size % 3 = 0 THEN 'NULL' ELSE CAST(p_size AS VARCHAR) END || '}' AS list_text FROM part""")
def array_to_text(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.array("p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string"))).alias("list"))
    return p.select("p_partkey", events.text(F.col("list"), p.schema["list"].dataType).alias("list_text"))


@query("SELECT 'localhost/customer' AS database, CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT 'localhost/supplier', CAST(s_suppkey AS VARCHAR) FROM supplier")
def multi_db_union(spark, sf):
    made = [events.from_table(table(spark, sf, t), f"localhost/{t}", "public", t, [k]) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    return events.union(*made).select("database", F.col("primary_keys")[0]["value"].alias("key"))


@query("SELECT n_nationkey, 'localhost' || '/' || n_name AS id FROM nation")
def database_id(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", events.database_id(F.lit("localhost"), F.col("n_name")).alias("id"))


@query("""SELECT n_name, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, length(n_name) + 1), lambda i: CAST(ascii(n_name[i]) AS HUGEINT))),
lambda h, b: (xor(h, b) * 435 + (xor(h, b) % 16777216) * 1099511627776) % 18446744073709551616) AS VARCHAR) AS id FROM nation""")
def fnv1a_pipeline_id(spark, sf):
    return table(spark, sf, "nation").select("n_name", events.pipeline_ids(F.col("n_name")).alias("id"))


@query("SELECT n_name AS value FROM nation")
def src_text_lines(spark, sf):
    from ..streaming.folders import scratch

    path = scratch(spark, "text-lines")
    table(spark, sf, "nation").select("n_name").write.mode("overwrite").text(path)
    return events.lines(spark, path)


@query()
def gen_corpus(spark, sf):
    return events.synthetic(spark, table(spark, sf, "orders").count())


_LOGGED = """SELECT o_orderkey AS lsn, (o_orderkey // 50 + 1) * 50 AS commit, ['INSERT','UPDATE','DELETE','TRUNCATE'][o_orderkey % 4 + 1] AS action, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus, o_orderpriority FROM orders"""


@query(f"SELECT lsn, commit, action, key, CASE WHEN action IN ('INSERT', 'UPDATE') THEN o_orderstatus END AS status, CASE WHEN action = 'INSERT' THEN o_orderpriority END AS priority FROM ({_LOGGED})")
def src_change_log(spark, sf):
    """Orders as a log of captured changes, in transactions of up to 50; updates leave out a column."""
    from ..streaming.folders import scratch

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    place = (F.col("o_orderkey") % 4 + 1).cast("int")  # below 0: from the end; 0: none
    kinds = F.get(F.array(*map(F.lit, ("INSERT", "UPDATE", "DELETE", "TRUNCATE"))), F.when(place > 0, place - 1).when(place < 0, place + 4))
    made = events.from_table(o, "", "public", "orders", ["o_orderkey"], action=kinds, lsn=F.col("o_orderkey"), table_id=7)
    sent = F.when(F.col("action") == "UPDATE", events.partial(F.col("columns"), F.array(F.lit(2)))).otherwise(F.col("columns"))
    path = scratch(spark, "change-log")
    changelog.write(made.withColumn("columns", sent).withColumn("commit_lsn", (F.expr("commit_lsn div 50") + 1) * 50), path)
    value = lambda name: F.get(F.filter("columns", lambda c: c["name"] == name), 0)["value"]
    found = changelog.read(spark, path, "localhost/orders")
    return found.select(F.col("start_lsn").alias("lsn"), F.col("commit_lsn").alias("commit"), "action", F.get("primary_keys", 0)["value"].alias("key"), value("o_orderstatus").alias("status"), value("o_orderpriority").alias("priority"))


@query("""SELECT p_partkey, n AS place, ['p_partkey','p_name','p_brand','p_size'][n + 1] AS name, ['int8','text','text','int4'][n + 1] AS type_name, n IN (1, 2) AS scanned, CASE n WHEN 1 THEN p_name IS NOT NULL WHEN 2 THEN p_size % 3 <> 0 ELSE false END AS has_value,
CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '{"kind":"none","columns":[]}' ELSE '{"kind":"keys","columns":["p_partkey"]}' END AS identity FROM part, (SELECT unnest(range(0, 4)) AS n)""")
def sql_table_function(spark, sf):
    """Columns of captured parts by a lateral join with a table function; a scalar one, null for null, says what keys are."""
    sql.register(spark)
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("bigint"), "p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("p_brand"), F.col("p_size").cast("int"))
    made = events.from_table(p, "", "public", "part", ["p_partkey"], lsn=F.col("p_partkey"))
    keys = F.when(F.col("commit_lsn") % 4 == 1, F.array().cast(events.KEYS)).when(F.col("commit_lsn") % 4 != 0, F.col("primary_keys"))
    return spark.sql("SELECT commit_lsn AS p_partkey, CAST(place AS BIGINT) AS place, name, type_name, scanned, has_value, describe_identity(given) AS identity FROM {made} JOIN LATERAL describe_columns(columns)", made=made.withColumn("given", keys))
