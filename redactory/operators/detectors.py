"""Detectors: columns of text to arrays of the substrings found, native but for phone numbers.

Each expression stands behind a cheap pattern that a text must match at all, as
higher-order functions are interpreted and patterns are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import phone, validators

#: Length of the account numbers of each country.
IBAN_LENGTHS = {
    "AD": 28, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 22, "BE": 16, "BG": 22, "BH": 22, "BI": 29, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 18, "DK": 18, "DO": 28, "EE": 20, "EG": 27,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 24, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 22, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 21, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "MZ": 29, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 33, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 28, "SN": 28, "SV": 25, "TN": 24, "TR": 26, "UA": 34, "VA": 24, "VC": 29, "VN": 30, "XK": 24,
}

_NONE = "array<string>"
# A run that cannot be a card is matched by the second branch, so that the search goes on behind it.
_CARD = r"(?<![A-Za-z0-9_])(?:(\d(?:[ -]?\d){12,18}+)(?![A-Za-z0-9_])|\d(?:[ -]?\d){0,18}+)"
_SSN = r"(?<![A-Za-z0-9_])(?!000|666|9)\d{3}([-. ])(?!00)\d{2}\1(?!0000)\d{4}(?![A-Za-z0-9_])"
_LOCAL_END = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+\z"
_DOMAIN = r"\A([A-Za-z0-9.-]{1,253}+)(?![A-Za-z0-9_])"


def _iban_pattern() -> str:
    by_length: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    shapes = "|".join(rf"(?:{'|'.join(names)})[0-9]{{2}}(?:[ -]?[A-Za-z0-9]){{{length - 4}}}" for length, names in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?=((?:{shapes})(?![A-Za-z0-9])))"


_IBAN = _iban_pattern()


def _guarded(text: Column, guard: str, found: Column) -> Column:
    return F.coalesce(F.when(text.rlike(guard), found), F.array().cast(_NONE))


def credit_card(text: Column) -> Column:
    """13 to 19 digits with single spaces or hyphens between them and a right check digit."""
    runs = F.regexp_extract_all(text, F.lit(_CARD), F.lit(1))
    return _guarded(text, r"\d(?:[ -]?\d){12}", F.filter(runs, lambda x: (x != "") & F.call_function("luhn_check", F.regexp_replace(x, "[ -]", ""))))


def ssn(text: Column) -> Column:
    """Social security numbers with one separator twice."""
    return _guarded(text, r"\d{3}[-. ]\d{2}[-. ]\d{4}", F.regexp_extract_all(text, F.lit(_SSN), F.lit(0)))


def email(text: Column) -> Column:
    """Addresses around every ``@``; they can overlap, and a long local part keeps its last 64 characters."""
    parts = F.split(text, "@", -1)
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("before"), F.slice(parts, 2, F.size(parts)).alias("after"))

    def address(pair: Column) -> Column:
        local = F.regexp_extract(F.right(pair["before"], F.lit(64)), _LOCAL_END, 0)
        domain = F.regexp_replace(F.regexp_extract(pair["after"], _DOMAIN, 1), r"[.-]+\z", "")
        return F.concat(local, F.lit("@"), domain)

    return _guarded(text, "@", F.filter(F.transform(pairs, address), lambda x: x.rlike(validators.EMAIL)))


def iban(text: Column) -> Column:
    """Account numbers of known countries and lengths whose check digits are right; they can overlap."""
    return _guarded(text, r"[A-Z]{2}[0-9]{2}", F.filter(F.regexp_extract_all(text, F.lit(_IBAN), F.lit(1)), validators.iban))


#: The detectors that rules can name.
DETECTORS: dict[str, Callable[[Column], Column]] = {"credit_card": credit_card, "ssn": ssn, "phone": phone.detect, "email": email, "iban": iban}
#: The checks that rules can ask for.
VALIDATORS: dict[str, Callable[[Column], Column]] = {"luhn": validators.luhn, "ssn": validators.ssn, "phone": phone.valid, "email": validators.email, "iban": validators.iban}
