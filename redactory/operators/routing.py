"""Routing findings to channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keys_as_map, severity_display


def route(findings: DataFrame, channels: list[str]) -> DataFrame:
    """A row for each finding and channel: all channels where none is named, none where the list is empty. The list of channels is part of the plan."""
    given = F.array(*map(F.lit, channels)).cast("array<string>")
    to = F.when(F.col("channels").isNull(), given).otherwise(F.filter(given, lambda c: F.array_contains(F.col("channels"), c)))
    return findings.select("*", F.explode(to).alias("channel"))


def unknown_channels(rules: DataFrame, channels: list[str]) -> DataFrame:
    """``(rule_id, channel)`` that a rule names and no channel has."""
    named = rules.select("rule_id", F.explode("channels").alias("channel"))
    known = rules.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    return named.join(F.broadcast(known), "channel", "left_anti").select("rule_id", "channel")


def payload(time: Column | None = None) -> Column:
    """A finding as JSON for a sink: severity in capitals, keys as a sorted map, absent when empty."""
    fields = [F.col(c) for c in ("database", "rule_id", "description", "category")] + [severity_display(F.col("severity")).alias("severity")]
    fields += [F.col(c) for c in ("schema_name", "table_name", "column_name", "masked_sample")] + [keys_as_map(F.col("primary_keys")).alias("primary_key"), F.col("lsn")]
    if time is not None:
        fields.append(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"))
    return F.to_json(F.struct(*fields))
