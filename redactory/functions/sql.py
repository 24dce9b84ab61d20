"""SQL functions: a table function for lateral joins, and a strict scalar one. Their bodies are SQL, which the optimiser sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.events import COLUMNS, KEYS, NOT_SCANNED

DESCRIBE = f"""CREATE OR REPLACE TEMPORARY FUNCTION describe_columns(described {COLUMNS})
RETURNS TABLE (place INT, name STRING, type_name STRING, scanned BOOLEAN, has_value BOOLEAN)
RETURN SELECT pos, col.name, col.type_name, col.type_name NOT IN ({", ".join(f"'{n}'" for n in sorted(NOT_SCANNED))}), col.value IS NOT NULL FROM posexplode(described)"""
IDENTITY = f"""CREATE OR REPLACE TEMPORARY FUNCTION describe_identity(keys {KEYS})
RETURNS STRING
RETURN CASE WHEN keys IS NOT NULL THEN to_json(named_struct('kind', CASE WHEN size(keys) = 0 THEN 'none' ELSE 'keys' END, 'columns', transform(keys, k -> k.name))) END"""


def register(spark: SparkSession) -> None:
    """``describe_columns(columns)``, the columns of an event as rows (none for null), and ``describe_identity(keys)``, what its key is made of (null for null)."""
    spark.sql(DESCRIBE)
    spark.sql(IDENTITY)
