"""Filters and predicates over names."""

from pyspark.sql import functions as F

from ..functions import globs, text
from ..operators.rules import Allowlist, Scope
from ..operators.scan import Filter
from ..sources import events
from .registry import query, table

_NAMES = "(SELECT lower(r_name) AS schema_name, lower(n_name) AS table_name, 'c' || CAST(n_nationkey % 5 AS VARCHAR) AS column_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _names(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(  # five regions
        F.lower("r_name").alias("schema_name"), F.lower("n_name").alias("table_name"), F.concat(F.lit("c"), (F.col("n_nationkey") % 5).cast("string")).alias("column_name"), "n_nationkey"
    )


@query("SELECT unnest(['c_name', 'c_mktsegment']) AS name, count(*) AS n FROM customer GROUP BY name")
def filter_scannable_types(spark, sf):
    c = table(spark, sf, "customer")
    kept = c.select(*events.scanned_columns(c.schema))
    return kept.select(F.explode(F.array(*map(F.lit, kept.columns))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query(f"SELECT * FROM {_NAMES} WHERE schema_name = 'asia' OR schema_name LIKE 'a%a'")
def filter_include_schema(spark, sf):
    return _names(spark, sf).where(Filter(include_schemas=["asia", "a*a"]).skipped(F.col("schema_name"), F.col("table_name")).isNull())


@query(f"SELECT * FROM {_NAMES} WHERE NOT (table_name = 'france' OR table_name LIKE 'i%' OR table_name LIKE '_hina')")
def filter_exclude_table(spark, sf):
    return _names(spark, sf).where(Filter(exclude_tables=["france", "i*", "?hina"]).skipped(F.col("schema_name"), F.col("table_name")).isNull())


@query("SELECT p_partkey, 'p_partkey,p_name,p_size,p_retailprice' AS names FROM part")
def filter_exclude_column(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    e = Filter(exclude_columns=["p_brand", "p_t*"]).apply(events.from_table(p, "d", "public", "part", ["p_partkey"], lsn=F.col("p_partkey")))
    return e.select(F.col("commit_lsn").alias("p_partkey"), F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT schema_name LIKE 'a%' THEN 'schema' WHEN table_name LIKE '%a' THEN 'table' END AS reason FROM {_NAMES}) WHERE reason IS NOT NULL GROUP BY reason")
def agg_events_skipped(spark, sf):
    why = Filter(include_schemas=["a*"], exclude_tables=["*a"]).skipped(F.col("schema_name"), F.col("table_name"))
    return _names(spark, sf).select(why.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT table_name, table_name LIKE 'i%' AS starts, table_name LIKE '_hina' AS one, table_name = 'france' AS exact, regexp_full_match(table_name, '(?:[a-e].*|.*stan)') AS classes FROM {_NAMES}")
def pred_glob_match(spark, sf):
    n = F.col("table_name")
    said = {"starts": ["i*"], "one": ["?hina"], "exact": ["france"], "classes": ["{[a-e]*,*stan}"]}
    return _names(spark, sf).select("table_name", *[globs.Names(p).column(n).alias(k) for k, p in said.items()])


@query(f"SELECT * FROM {_NAMES} WHERE (schema_name = 'asia' OR schema_name LIKE 'e%') AND NOT table_name LIKE 'f%' AND column_name IN ('c0', 'c1', 'c2') AND column_name <> 'c1'")
def filter_rule_scope(spark, sf):
    scope = Scope(include_schemas=["asia", "e*"], exclude_tables=["f*"], include_columns=["c0", "c1", "c2"], exclude_columns=["c[1]*"])
    return _names(spark, sf).where(scope.column(F.col("schema_name"), F.col("table_name"), F.col("column_name")))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_allowlist_values(spark, sf):
    return table(spark, sf, "customer").where(~Allowlist(values=["BUILDING", "MACHINERY"]).column(F.col("c_mktsegment"))).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_matches(c_name, '[13579]$') AND NOT regexp_matches(c_name, '00+2')")
def filter_allowlist_patterns(spark, sf):
    return table(spark, sf, "customer").where(~Allowlist(patterns=["[13579]$", "00+2"]).column(F.col("c_name"))).select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE nullif(p_size % 4, 0) IS NOT NULL")
def filter_null_cells(spark, sf):
    return table(spark, sf, "part").where(F.nullif(F.col("p_size") % 4, F.lit(0)).isNotNull()).select("p_partkey")


@query("SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z0-9_]+') AS plain, regexp_full_match(replace(p_brand, '#', '_'), '[A-Za-z0-9_]+') AS fixed FROM part")
def pred_valid_identifier(spark, sf):
    b = F.col("p_brand")
    return table(spark, sf, "part").select("p_partkey", text.identifier(b).alias("plain"), text.identifier(F.replace(b, F.lit("#"), F.lit("_"))).alias("fixed"))


@query("""SELECT n_nationkey, trim(u) <> '' AND (starts_with(u, 'http://') OR starts_with(u, 'https://')) AS fine
FROM (SELECT n_nationkey, ['http://', 'https://', 'ftp://', ' http://', ''][n_nationkey % 5 + 1] || lower(n_name) AS u FROM nation)""")
def pred_url_scheme(spark, sf):
    u = F.concat(F.element_at(F.array(*map(F.lit, ("http://", "https://", "ftp://", " http://", ""))), F.col("n_nationkey") % 5 + 1), F.lower("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", text.url(u).alias("fine"))
