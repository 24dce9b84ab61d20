"""Checks of whole values: card numbers, social security numbers, emails, account numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOCAL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]"
EMAIL = rf"\A(?!\.)(?![^@]*\.\.[^@]*@){_LOCAL}{{1,64}}(?<!\.)@(?=[^@]{{1,253}}\z)(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,63}}\z"
_SSN = r"\A(\+\d\d|\d{3})([- .])(\+\d|\d\d)\2(\+\d{3}|\d{4})\z"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits, other characters ignored, with a right check digit."""
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def ssn(value: Column) -> Column:
    """Area, group and serial in range, one separator twice; a number may begin with a plus sign."""
    area, group, serial = (F.regexp_extract(value, _SSN, i).cast("int") for i in (1, 3, 4))
    there = value.rlike(_SSN)
    part = lambda c: F.when(there, c)
    return F.coalesce(part((area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)), F.lit(False))


def email(value: Column) -> Column:
    return value.rlike(EMAIL)


def iban(value: Column) -> Column:
    """At least 15 letters and digits (others ignored) whose number, turned by four places, leaves 1 modulo 97; no lower case."""
    kept = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    turned = F.concat(F.substring(kept, 5, 1 << 30), F.left(kept, F.lit(4)))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))
    return F.coalesce(F.when((F.length(kept) >= 15) & ~kept.rlike("[a-z]"), rest == 1), F.lit(False))
