"""Scans: rules over tables or events, giving findings.

Everything up to the findings is row-local: one pass, no shuffle. Columns that no rule can
look at, by type, filter or scope, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import Names
from ..functions.text import mask
from ..sources import events
from .rules import Engine, cells_failed, of_cells

FINDING = (
    "database string, rule_id string, description string, category string, severity string, schema_name string, table_name string, column_name string, "
    f"masked_sample string, value_hash string, primary_keys {events.KEYS}, lsn bigint, channels array<string>"
)


@dataclass
class Filter:
    """Which schemas are scanned (none named: all), and which tables and columns are not."""

    include_schemas: list[str] = field(default_factory=list)
    exclude_tables: list[str] = field(default_factory=list)
    exclude_columns: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.schemas, self.tables, self.columns = Names(self.include_schemas), Names(self.exclude_tables), Names(self.exclude_columns)

    def skipped(self, schema: Column, table: Column) -> Column:
        """Why an event is skipped (``schema`` before ``table``), else null."""
        by_schema = ~self.schemas.column(schema) if self.schemas else F.lit(False)
        return F.when(by_schema, "schema").when(self.tables.column(table), "table")

    def counts(self, df: DataFrame) -> DataFrame:
        """``(reason, n)`` of the changes that are skipped."""
        reason = self.skipped(F.col("schema_name"), F.col("table_name")).alias("reason")
        return events.changes(df).select(reason).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))

    def has(self, schema: str, table: str) -> bool:
        return (not self.schemas or self.schemas.has(schema)) and not self.tables.has(table)

    def apply(self, df: DataFrame) -> DataFrame:
        """Events of scanned tables, without excluded columns; keys stay."""
        kept = df.where(self.skipped(F.col("schema_name"), F.col("table_name")).isNull())
        return kept.withColumn("columns", F.filter("columns", lambda c: ~self.columns.column(c["name"]))) if self.columns else kept


def value_hash(value: Column, salt: str = "") -> Column:
    """Of a match, for comparing findings without keeping the value."""
    return F.sha2(F.concat(F.lit(salt), value).cast("binary"), 256)


def redacted_keys(keys: Column, found: Column) -> Column:
    """Keys without those of columns that have a finding."""
    return F.filter(keys, lambda k: ~F.array_contains(found, k["name"]))


def _findings(df: DataFrame, salt: str) -> DataFrame:
    """From rows with ``matches`` (an array of structs ``column_name, m, place``) and the event's fields."""
    # An outer generator, then a filter on what it made: a filter on the array itself would run all rules twice.
    rows = df.select("database", "schema_name", "table_name", "primary_keys", F.col("commit_lsn").alias("lsn"), "matches", F.posexplode_outer("matches").alias("place", "f")).where("place IS NOT NULL")
    rows = rows.withColumn("primary_keys", redacted_keys(F.col("primary_keys"), F.array_distinct(F.col("matches.column_name"))))
    return rows.select(
        "database", "f.m.rule_id", "f.m.description", "f.m.category", "f.m.severity", "schema_name", "table_name", "f.column_name", mask(F.col("f.m.matched")).alias("masked_sample"),
        value_hash(F.col("f.m.matched"), salt).alias("value_hash"), "primary_keys", "lsn", "f.m.channels", "place",
    )


def scan_table(df: DataFrame, engine: Engine, database: str, schema: str, table: str, key: list[str], lsn: Column | None = None, where: Filter | None = None, salt: str = "") -> DataFrame:
    """Findings of a table's rows (:data:`FINDING` and ``place``, the number within the event).

    Rules and columns are matched while the plan is built: the scan reads the key and
    the columns that some rule looks at.
    """
    where = where or Filter()
    look = []
    if where.has(schema, table):
        for name in events.scanned_columns(df.schema):
            rules = engine.within(schema, table, name)
            if rules and not where.columns.has(name):
                look.append((name, rules))
    parts = []
    for name, rules in look:
        cell = events.text(F.col(f"`{name}`"), df.schema[name].dataType)
        parts.append(_named(engine.matches(cell, rules), F.lit(name)))
    none = F.array().cast("array<struct<column_name: string, m: struct<rule_id: string, description: string, category: string, severity: string, matched: string, channels: array<string>>>>")
    rows = df.select(
        F.lit(database).alias("database"), F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), events.keys(df, key).alias("primary_keys"),
        (F.lit(0) if lsn is None else lsn).cast("bigint").alias("commit_lsn"), F.concat(none, *parts).alias("matches"),
    )
    return _findings(rows, salt)


def _named(matches: Column, name: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(name.alias("column_name"), m.alias("m")))


def of_cell(c: Column) -> Column:
    """The text of a cell of an event that rules look at, else null."""
    return F.when(c["value"].isNotNull() & ~c["type_name"].isin(*events.NOT_SCANNED), c["value"])


def scan_events(df: DataFrame, engine: Engine, where: Filter | None = None, salt: str = "", observed: str = "") -> DataFrame:
    """Findings of events whose columns are data, for all rules.

    An event stays one row until its findings are known, so that events that look alike
    are not mixed up and nothing is shuffled. Functions of rules get an event's cells as one array.

    With a name in ``observed``, the scan counts as it goes, as metrics of that name: ``events``, ``skipped_schema`` and ``skipped_table``
    under it, and under ``observed-failed`` the cells for which each function failed, by the rule's place among the functions.
    """
    where = where or Filter()
    if observed:
        reason = F.when(F.col("action").isin(*events.ACTIONS), where.skipped(F.col("schema_name"), F.col("table_name")))
        df = df.observe(observed, F.count(F.lit(1)).alias("events"), *[F.count_if(reason == r).alias(f"skipped_{r}") for r in ("schema", "table")])
    kept = where.apply(events.changes(df))
    cells = F.transform("columns", of_cell)
    scripts = [r for r in engine.rules if r.kind == "script"]
    for i, r in enumerate(scripts):
        kept = kept.withColumn(f"s{i}", of_cells(r.script, cells))
    if observed and scripts:
        kept = kept.observe(f"{observed}-failed", *[F.coalesce(F.sum(F.size(F.filter(f"s{i}", lambda x: x.isNull()))), F.lit(0)).alias(f"n{i}") for i in range(len(scripts))])
    together = F.arrays_zip(F.col("columns").alias("c"), *[F.col(f"s{i}") for i in range(len(scripts))])
    nothing = F.array().cast("array<string>")

    def matches(z: Column) -> Column:
        rules = [(r, F.coalesce(z[f"s{scripts.index(r)}"], nothing) if r.kind == "script" else None) for r in engine.rules]
        return _scoped(engine, engine.tagged(of_cell(z["c"]), rules), z["c"]["name"])

    return _findings(kept.withColumn("matches", F.flatten(F.transform(together, matches))), salt)


def scan_cells(df: DataFrame, engine: Engine, where: Filter | None = None, salt: str = "") -> DataFrame:
    """The older name of :func:`scan_events`."""
    return scan_events(df, engine, where, salt)


def failures(df: DataFrame, engine: Engine, where: Filter | None = None) -> DataFrame:
    """``(rule_id, n)``: cells for which functions of rules fail or go over their bounds; rules without failures are left out."""
    kept = (where or Filter()).apply(events.changes(df))
    cells = F.transform("columns", of_cell)
    scripts = [r for r in engine.rules if r.kind == "script"]
    if not scripts:
        return df.sparkSession.createDataFrame([], "rule_id string, n bigint")
    counts = kept.select(*[F.sum(cells_failed(r.script, cells)).alias(f"n{i}") for i, r in enumerate(scripts)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col(f"n{i}").alias("n")) for i, r in enumerate(scripts)])).alias("r")).select("r.*").where("n > 0")


def _scoped(engine: Engine, matches: Column, name: Column) -> Column:
    for r in engine.rules:
        if r.scope:
            matches = _in_scope(matches, r, name)
    return _named(matches, name)


def _in_scope(matches: Column, rule, name: Column) -> Column:
    inside = rule.scope.column(F.col("schema_name"), F.col("table_name"), name)
    return F.filter(matches, lambda m: (m["rule_id"] != rule.id) | inside)


def scan_values(df: DataFrame, engine: Engine, value_col: str = "value") -> DataFrame:
    """Matches of single values, without scopes: ``df`` with ``place`` and the fields of a match, the sample masked."""
    rows = df.select("*", F.posexplode_outer(engine.matches(F.col(value_col))).alias("place", "m")).where("place IS NOT NULL")
    return rows.select(*df.columns, "place", "m.rule_id", "m.severity", "m.category", mask(F.col("m.matched")).alias("masked_sample"))
