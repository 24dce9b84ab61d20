"""The relational shapes of the catalogue queries: joins, CTEs, unnesting, ordered lists, JSON."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.order import placed
from .registry import query, table


def _views(spark, sf, *names):
    for n in names:
        table(spark, sf, n).createOrReplaceTempView(n)


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_inner_join(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def q_left_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND NOT l_returnflag = 'R' AND l_linestatus <> ''")
def q_filter_conj(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 10 AND NOT l_returnflag = 'R' AND l_linestatus <> ''").select("l_orderkey", "l_linenumber")


@query("SELECT n_name, row_number() OVER (ORDER BY n_name DESC) AS place FROM nation")
def q_order_by(spark, sf):
    """A total order of a small table; the place makes it part of the rows."""
    return table(spark, sf, "nation").select("n_name", F.row_number().over(Window.orderBy(F.desc("n_name"))).cast("bigint").alias("place")).orderBy("place")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def q_case_when(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("other").alias("state"))


@query("SELECT p_partkey, nullif(p_size, 1) AS size FROM part")
def q_nullif(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("size"))


_CHAIN = """WITH paid AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY o_custkey),
of_nation AS (SELECT c_nationkey, cents FROM paid JOIN customer ON o_custkey = c_custkey),
summed AS (SELECT c_nationkey, sum(cents) AS cents FROM of_nation GROUP BY c_nationkey)
SELECT n_name, CAST(cents AS BIGINT) AS cents FROM summed JOIN nation ON c_nationkey = n_nationkey"""


@query(_CHAIN)
def q_cte_chain(spark, sf):
    _views(spark, sf, "orders", "customer", "nation")
    return spark.sql(_CHAIN)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_topk(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT p_partkey, i AS place, words[i] AS word FROM (SELECT p_partkey, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part))")
def q_unnest_ordinality(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word")).select("p_partkey", (F.col("i") + 1).cast("bigint").alias("place"), "word")


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def q_union_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("name")).union(table(spark, sf, "supplier").select("s_name"))


_FALLBACK = """WITH own AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'NONE'), parent AS (SELECT s_suppkey AS k FROM supplier)
SELECT k FROM own UNION ALL SELECT k FROM parent WHERE NOT EXISTS (SELECT 1 FROM own)"""


@query(_FALLBACK)
def q_not_exists_fallback(spark, sf):
    _views(spark, sf, "customer", "supplier")
    return spark.sql(_FALLBACK)


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def q_ordered_array_agg(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(ordered, lambda s: s["n_name"]), ",").alias("names"))


@query("SELECT s_suppkey, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) ON s_suppkey = l_suppkey")
def q_coalesce_default(spark, sf):
    n = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


_SCALAR = "SELECT n_name, (SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1) AS first_region FROM nation"


@query(_SCALAR)
def q_scalar_subquery(spark, sf):
    _views(spark, sf, "nation", "region")
    return spark.sql(_SCALAR)


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":' || CAST(n_regionkey AS VARCHAR) || '}' AS doc FROM nation""")
def q_build_json(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("doc"))


@query("SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, row_number() OVER (ORDER BY sum(CAST(round(o_totalprice * 100) AS BIGINT)) DESC, o_custkey) AS place FROM orders GROUP BY o_custkey ORDER BY place LIMIT 100")
def sort_desc(spark, sf):
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    top = sums.orderBy(F.desc("cents"), "o_custkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cents"), "o_custkey")).cast("bigint"))


@query("SELECT o_custkey, cents, row_number() OVER (ORDER BY cents DESC, o_custkey) AS place FROM (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_custkey)")
def sort_desc_all(spark, sf):
    """``sort_desc`` without its limit: every customer."""
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    return placed(sums, F.desc("cents"), F.col("o_custkey"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY n_regionkey")
def sorted_string_agg(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("names"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def find_duplicates(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")
