"""Masking, severities, durations and primary keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the gravest down; the place is the rank.
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: The log level of each severity.
LOG_LEVELS = {"critical": "error", "high": "error", "medium": "warn", "low": "warn", "info": "info"}


def mask(value: Column) -> Column:
    """All stars up to seven characters, else the first and last two characters stay."""
    n = F.char_length(value)
    return F.when(n < 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))


def severity_rank(severity: Column) -> Column:
    """0 for the gravest."""
    out = F.when(F.lower(severity) == SEVERITIES[0], 0)
    for rank, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(F.lower(severity) == name, rank)
    return out


def severity_display(severity: Column) -> Column:
    return F.upper(severity)


def log_level(severity: Column) -> Column:
    out = None
    for name, level in LOG_LEVELS.items():
        out = F.when(F.lower(severity) == name, level) if out is None else out.when(F.lower(severity) == name, level)
    return out


def duration(micros: Column) -> Column:
    """A number of microseconds with a unit: ``50.0ns``, ``12.3us``, ``1.50ms``, ``1.50s``.

    Rounded by the exact value of the double, and a half to the even digit; ``format_string`` rounds up what its shortest decimal text has as a half.
    """
    said = lambda value, form, unit: F.concat(F.call_function("format_number", value, F.lit(form)), F.lit(unit))
    return (
        F.when(micros >= 1_000_000, said(micros / 1_000_000, "0.00", "s"))
        .when(micros >= 1000, said(micros / 1000, "0.00", "ms"))
        .when(micros >= 1, said(micros, "0.0", "us"))
        .otherwise(said(micros * 1000, "0.0", "ns"))
    )


def padded(value: Column, width: int) -> Column:
    """Padded with spaces to a width; longer values stay whole."""
    return F.when(F.char_length(value) < width, F.rpad(value, width, " ")).otherwise(value)


def keys_as_text(keys: Column) -> Column:
    """``k1=v1,k2=v2`` of an array of structs ``name, value``."""
    return F.array_join(F.transform(keys, lambda k: F.concat(k["name"], F.lit("="), k["value"])), ",")


def keys_as_map(keys: Column) -> Column:
    """A map sorted by name, the last value of a repeated name; null when empty."""
    last = F.filter(keys, lambda k, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda later: later["name"] == k["name"]))
    return F.when(F.size(keys) > 0, F.map_from_entries(F.array_sort(last)))


def url(value: Column) -> Column:
    """An address with a scheme that can be posted to, without blanks at its ends."""
    return (F.trim(value) != "") & (value.startswith("http://") | value.startswith("https://"))


def identifier(value: Column) -> Column:
    """ASCII letters, digits and underscores, at least one."""
    return value.rlike(r"\A[A-Za-z0-9_]+\z")
