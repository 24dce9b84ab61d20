"""Phone numbers: candidates in texts, and whether a numbering plan has them.

All of it is one regular expression a task, made once from the numbering plans, so that
texts stay in the JVM. The plans are a compact table from public numbering knowledge
(country code, lengths of the national number, first digits); they are coarser than a
full metadata library, which is the known difference.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country code, lengths of national numbers, pattern of their first digit.
PLANS = {
    "7": ("10", "[3-9]"), "20": ("8-10", "[1-9]"), "27": ("9", "[1-8]"), "30": ("10", "[2-9]"), "31": ("9", "[1-9]"), "32": ("8-9", "[1-9]"), "33": ("9", "[1-9]"), "34": ("9", "[5-9]"), "36": ("8-9", "[1-9]"),
    "39": ("6-11", "[03]"), "40": ("9", "[2-9]"), "41": ("9", "[2-9]"), "43": ("4-13", "[1-9]"), "44": ("9-10", "[1-9]"), "45": ("8", "[2-9]"), "46": ("7-9", "[1-9]"), "47": ("8", "[2-9]"), "48": ("9", "[1-9]"), "49": ("6-11", "[1-9]"),
    "51": ("8-9", "[1-9]"), "52": ("10", "[1-9]"), "53": ("8", "[2-9]"), "54": ("10-11", "[1-9]"), "55": ("10-11", "[1-9]"), "56": ("9", "[2-9]"), "57": ("10", "[36]"), "58": ("10", "[24589]"), "60": ("8-10", "[1-9]"), "61": ("9", "[2-478]"),
    "62": ("8-12", "[2-9]"), "63": ("8-10", "[2-9]"), "64": ("8-10", "[2-9]"), "65": ("8", "[3689]"), "66": ("8-9", "[2-9]"), "81": ("9-10", "[1-9]"), "82": ("8-10", "[1-9]"), "84": ("9-10", "[2-9]"), "86": ("10-11", "[1-9]"),
    "90": ("10", "[2-5]"), "91": ("10", "[1-9]"), "92": ("9-10", "[2-9]"), "93": ("9", "[2-7]"), "94": ("9", "[1-9]"), "95": ("7-10", "[1-9]"), "98": ("10", "[1-9]"),
    "212": ("9", "[5-8]"), "213": ("8-9", "[1-9]"), "216": ("8", "[2-9]"), "218": ("9", "[2-9]"), "221": ("9", "[37]"), "225": ("10", "[02]"), "233": ("9", "[235]"), "234": ("8,10", "[1-9]"), "237": ("9", "[26]"), "251": ("9", "[1-9]"), "254": ("9", "[17]"),
    "255": ("9", "[2-9]"), "256": ("9", "[2-9]"), "260": ("9", "[279]"), "263": ("9", "[1-9]"), "351": ("9", "[239]"), "352": ("6-9", "[2-9]"), "353": ("7-9", "[1-9]"), "354": ("7", "[4-8]"), "358": ("5-10", "[1-9]"), "359": ("7-9", "[2-9]"),
    "370": ("8", "[3-9]"), "371": ("8", "[26]"), "372": ("7-8", "[3-8]"), "375": ("9", "[1-4]"), "380": ("9", "[3-9]"), "381": ("8-9", "[1-9]"), "385": ("8-9", "[1-9]"), "386": ("8", "[1-7]"), "420": ("9", "[2-9]"), "421": ("9", "[2-9]"),
    "593": ("8-9", "[2-9]"), "595": ("9", "[2-9]"), "852": ("8", "[2-9]"), "853": ("8", "[268]"), "880": ("8-10", "[1-9]"), "886": ("8-9", "[2-9]"), "960": ("7", "[3-9]"), "961": ("7-8", "[1-9]"), "962": ("8-9", "[2-9]"), "964": ("8,10", "[1-7]"),
    "965": ("8", "[2-9]"), "966": ("9", "[15]"), "968": ("8", "[279]"), "970": ("8-9", "[2-9]"), "971": ("8-9", "[2-9]"), "972": ("8-9", "[2-9]"), "973": ("8", "[13679]"), "974": ("8", "[3-7]"), "977": ("8,10", "[1-9]"), "994": ("9", "[1-9]"), "995": ("9", "[3-8]"), "998": ("9", "[3-9]"),
}
#: Assigned codes of three digits, by their first two; those without a plan of their own get :data:`USUAL`.
ASSIGNED = {"21": "12368", "22": "0-9", "23": "0-9", "24": "0-9", "25": "0-8", "26": "0-9", "29": "01789", "35": "0-9", "37": "0-8", "38": "0-3579", "42": "013", "50": "0-9", "59": "0-9", "67": "02-9", "68": "0-35-9", "69": "0-2", "85": "02356", "88": "06", "96": "0-8", "97": "0-7", "99": "2-68"}
USUAL = ("5-9", "[1-9]")
#: First three digits that no place of the North American plan has.
NO_AREA = ("200", "211", "300", "311", "400", "411", "511", "555", "611", "700", "711", "811", "911", "999")

#: What may stand between digits: of an international number, and of a North American one.
_INTL, _NANP = r"[ \-.()]*+", r"[)\-. ]*+"
_ALONE, _END = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
#: A text without this has no number.
_GUARD = rf"[0-9](?:{_INTL}[0-9]){{6}}"


def _apart(digits: str, between: str) -> str:
    return between.join(digits)


def _lengths(said: str) -> list[int]:
    ranges = (part.partition("-") for part in said.split(","))
    return [n for low, _, high in ranges for n in range(int(low), int(high or low) + 1)]


def _national(code: str, plan: tuple[str, str], between: str) -> str:
    """A country code (its last place may be a class) and national numbers of its plan. All digits that follow belong to the number, up to the fifteenth."""
    places = len(code) if "[" not in code else code.index("[") + 1
    head = _apart(code[: places - 1], between) + (between if places > 1 else "") + code[places - 1 :]
    more = f"(?:{between}[0-9])"
    ends = [f"{more}{{{n - 1}}}" + ("" if n + places == 15 else f"(?!{between}[0-9])") for n in _lengths(plan[0])]
    return f"{head}{between}{plan[1]}(?:{'|'.join(ends)})"


@cache
def _plans(between: str) -> str:
    """Every number after ``+`` or ``00``."""
    area = f"(?!{'|'.join(_apart(a, between) for a in NO_AREA)})"
    american = f"1{between}{area}[2-9](?:{between}[0-9]){{2}}{between}[2-9](?:{between}[0-9]){{6}}(?!{between}[0-9])"
    own = [_national(code, plan, between) for code, plan in PLANS.items()]
    taken = f"(?!{'|'.join(_apart(code, between) for code in PLANS if len(code) == 3)})"
    rest = [_national(f"{two}[{third}]", USUAL, between) for two, third in ASSIGNED.items()]
    return f"(?:{american}|{'|'.join(own)}|{taken}(?:{'|'.join(rest)}))"


_SEVEN = f"(?=[0-9](?:{_INTL}[0-9]){{6}})"
#: Ten digits, not all together, the first and the fourth from 2 to 9; before them what may not stand there.
_NOT_TOGETHER, _TEN = r"(?!\(?[0-9]{10})\(?", f"[2-9](?:{_NANP}[0-9]){{2}}{_NANP}[2-9](?:{_NANP}[0-9]){{6}}"


@cache
def _number() -> str:
    intl = rf"(?:\+|00){_SEVEN}{_plans(_INTL)}"
    area = f"(?!{'|'.join(_apart(a, _NANP) for a in NO_AREA)})"
    return f"{_ALONE}(?:{intl}|{_NOT_TOGETHER}{area}{_TEN}){_END}"


def _all(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(F.when(text.rlike(_GUARD), found), F.array().cast("array<string>"))


def detect(text: Column) -> Column:
    """Valid numbers in a text; the search goes on behind a number found."""
    return _all(text, _number())


def valid(value: Column) -> Column:
    """``+`` or ``00`` and a country code, else a number of the North American plan; what stands between digits does not matter."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    named = F.when(value.startswith("+"), digits).when(value.startswith("00"), F.substr(digits, F.lit(3)))
    number = F.coalesce(named, F.when((F.length(digits) == 11) & digits.startswith("1"), digits).otherwise(F.concat(F.lit("1"), digits)))
    return number.rlike(f"^{_plans('')}$")


def intl_candidates(text: Column) -> Column:
    """What looks like an international number: 7 to 15 digits after ``+`` or ``00``, of more the first 15."""
    return _all(text, rf"{_ALONE}(?:\+|00)[0-9](?:{_INTL}[0-9]){{6,14}}+{_END}")


def nanp_candidates(text: Column) -> Column:
    """What looks like a North American number: ten digits, not all together."""
    return _all(text, f"{_ALONE}{_NOT_TOGETHER}{_TEN}{_END}")
