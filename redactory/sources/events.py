"""Change events: from tables or captured rows to one row an event.

An event has ``database, table_id, schema_name, table_name, action, columns,
primary_keys, start_lsn, commit_lsn``; ``columns`` is an array of ``name, type_name,
value`` in the table's order, a value being text or null where a type is not
scanned; ``primary_keys`` is an array of ``name, value`` without null values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names whose cells are never scanned; all others are, arrays included.
NOT_SCANNED = frozenset("bool int2 int4 int8 float4 float8 numeric oid bytea uuid date time timetz timestamp timestamptz interval".split())
#: The kinds of change that become events.
ACTIONS = ("INSERT", "UPDATE")
COLUMNS = "array<struct<name: string, type_name: string, value: string>>"
KEYS = "array<struct<name: string, value: string>>"
EVENT = f"database string, table_id bigint, schema_name string, table_name string, action string, columns {COLUMNS}, primary_keys {KEYS}, start_lsn bigint, commit_lsn bigint"

_NAMES = {
    T.StringType: "text", T.VarcharType: "varchar", T.CharType: "bpchar", T.BooleanType: "bool", T.ByteType: "int2", T.ShortType: "int2", T.IntegerType: "int4", T.LongType: "int8", T.FloatType: "float4", T.DoubleType: "float8",
    T.DecimalType: "numeric", T.DateType: "date", T.TimestampType: "timestamptz", T.TimestampNTZType: "timestamp", T.BinaryType: "bytea", T.DayTimeIntervalType: "interval", T.YearMonthIntervalType: "interval", T.StructType: "jsonb",
    T.MapType: "jsonb", T.VariantType: "jsonb",
}


def type_name(kind: T.DataType) -> str:
    return f"_{type_name(kind.elementType)}" if isinstance(kind, T.ArrayType) else _NAMES.get(type(kind), "text")


def is_scanned(name: str) -> bool:
    return name not in NOT_SCANNED


def scanned_columns(schema: T.StructType) -> list[str]:
    """The columns that a scan reads: the others are pruned from the plan."""
    return [f.name for f in schema.fields if is_scanned(type_name(f.dataType))]


def number_text(value: Column) -> Column:
    """A fraction without a needless zero and without an exponent."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", value), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = value.cast("string")
    return F.when(short.contains("E"), plain).otherwise(F.regexp_replace(short, r"\.0$", ""))


def text(value: Column, kind: T.DataType) -> Column:
    """A cell as text; binary cells have none."""
    if isinstance(kind, T.ArrayType):
        item = (lambda x: F.lit("<bytes>")) if isinstance(kind.elementType, T.BinaryType) else (lambda x: text(x, kind.elementType))
        inner = F.transform(value, lambda x: F.when(x.isNull(), "NULL").otherwise(item(x)))
        return F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))
    if isinstance(kind, T.BinaryType):
        return F.lit(None).cast("string")
    if isinstance(kind, T.StructType | T.MapType | T.VariantType):
        return F.to_json(value)
    if isinstance(kind, T.FloatType | T.DoubleType):
        return number_text(value)
    return value.cast("string")


def cells(df: DataFrame, names: Iterable[str] | None = None) -> Column:
    """All columns as :data:`COLUMNS`; cells of types that are not scanned are null."""
    out = []
    for f in df.schema.fields:
        if names is None or f.name in names:
            name = type_name(f.dataType)
            value = text(F.col(f"`{f.name}`"), f.dataType) if is_scanned(name) else F.lit(None).cast("string")
            out.append(F.struct(F.lit(f.name).alias("name"), F.lit(name).alias("type_name"), value.alias("value")))
    return F.array(*out).cast(COLUMNS)


def keys(df: DataFrame, names: Iterable[str]) -> Column:
    """Key columns of any type as text, without nulls."""
    given = [F.struct(F.lit(n).alias("name"), text(F.col(f"`{n}`"), df.schema[n].dataType).alias("value")) for n in names]
    return F.filter(F.array(*given).cast(KEYS), lambda k: k["value"].isNotNull())


def from_table(df: DataFrame, database: str, schema: str, table: str, key: list[str], action: Column | None = None, lsn: Column | None = None, table_id: int = 0) -> DataFrame:
    """Every row of a table as an event."""
    at = (F.lit(0) if lsn is None else lsn).cast("bigint")
    return df.select(
        F.lit(database).alias("database"), F.lit(table_id).cast("bigint").alias("table_id"), F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"),
        (F.lit("INSERT") if action is None else action).alias("action"), cells(df).alias("columns"), keys(df, key).alias("primary_keys"), at.alias("start_lsn"), at.alias("commit_lsn"),
    )


def partial(columns: Column, missing: Column) -> Column:
    """The columns of an update without those whose places (from 0) were not sent."""
    return F.filter(columns, lambda c, i: ~F.array_contains(missing, i))


def changes(df: DataFrame) -> DataFrame:
    """Inserts and updates only; a source that can filter gets the condition."""
    return df.where(F.col("action").isin(*ACTIONS))


def union(*streams: DataFrame) -> DataFrame:
    """The events of many databases."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def database_id(host: Column, name: Column) -> Column:
    return F.concat_ws("/", host, name)


def pipeline_id(text: str) -> int:
    """FNV-1a of 64 bits, of the UTF-8 bytes."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def pipeline_ids(names: Column) -> Column:
    """The same as a column of decimal text, as 64 bits without sign have no column type."""

    @F.arrow_udf("string")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else str(pipeline_id(x)) for x in b.to_pylist()], pa.string())

    return ids(names)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files, as values to scan."""
    return spark.read.text(path)


def synthetic(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``(id, value)``: 70 % noise, 10 % cards, 5 % each of social security numbers, phones, cloud keys and repository tokens, all made up."""
    part = lambda i, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(m)).cast("int")
    number = lambda i, low, high, width: F.lpad((part(i, high - low + 1) + low).cast("string"), width, "0")
    letters = F.sha2(F.concat_ws("/", "id", F.lit(seed)), 512)
    noise = F.regexp_replace(F.substring(letters, 1, part(2, 60) + 20), "([0-5])(?=[a-f])", " ")
    body = F.concat(F.lit("4"), number(3, 0, 9_999_999, 7), number(4, 0, 9_999_999, 7))
    card = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda x: F.call_function("luhn_check", x)), 1)
    ssn = F.concat_ws("-", number(3, 1, 665, 3), number(4, 1, 99, 2), number(5, 1, 9999, 4))
    phone = F.concat_ws(" ", F.lit("+44 20"), number(3, 7000, 8999, 4), number(4, 0, 9999, 4))
    cloud = F.concat(F.lit("AKIA"), F.translate(F.substring(letters, 1, 16), "abcdef0189", "ABCDEFGHJK"))
    token = F.concat(F.lit("ghp_"), F.substring(letters, 17, 36))
    kind = F.col("kind")
    value = F.when(kind < 70, noise).when(kind < 80, card).when(kind < 85, ssn).when(kind < 90, phone).when(kind < 95, cloud).otherwise(token)
    return spark.range(n).withColumn("kind", part(1, 100)).select("id", value.alias("value"))
