"""Phone candidates in all texts, and numbers against a walk over the numbering plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from redactory.functions import phone
from redactory.plans import detect

SF = "/root/testdata/sf0.001"
SHAPES = {
    "phone_candidates_intl_cells": (re.compile(r"(?:\+|00)\d(?:[ \-.()]*\d)*"), lambda t: 7 <= sum(map(str.isdigit, t.removeprefix("00"))) <= 15),
    "phone_candidates_nanp_cells": (re.compile(r"\(?[2-9](?:[)\-. ]*\d){2}[)\-. ]*[2-9](?:[)\-. ]*\d){6}"), lambda t: any(c in "()-. " for c in t)),
}


@pytest.mark.parametrize("name", SHAPES)
def test_phone_candidates_of_all_texts(spark, name):
    shape, fits = SHAPES[name]
    got, expected = {}, {}
    for r in getattr(detect, name)(spark, SF).collect():
        got.setdefault((r.src, r.id), []).append((r.place, r.match))
    for r in detect.cells(spark, SF).collect():
        found, at = [], 0
        while m := shape.search(r.text or "", at):
            near = r.text[max(0, m.start() - 1) : m.start()] + r.text[m.end() : m.end() + 1]
            ok = fits(m[0]) and not re.search("[A-Za-z0-9]", near)
            found += [m[0]] * ok
            at = m.end() if ok else m.start() + 1
        if found:
            expected[r.src, r.id] = list(enumerate(found))
    assert {k: sorted(v) for k, v in got.items()} == expected
    assert {k[0] for k in got} - {"orders"}


def plan_of(digits):
    """Lengths, pattern of the first digit and national number, by the longest country code that the digits start with."""
    for size in (3, 2, 1):
        code = digits[:size]
        if code in phone.PLANS:
            return *phone.PLANS[code], digits[size:]
        if size == 3 and re.fullmatch(f"[{phone.ASSIGNED.get(code[:2], 'x')}]", code[2:]):
            return *phone.USUAL, digits[size:]
    return None


def walked(digits):
    """Whether digits after a plus sign are a number, one plan at a time and without the compiled pattern."""
    if digits.startswith("1"):
        return len(digits) == 11 and digits[1] in "23456789" and digits[1:4] not in phone.NO_AREA and digits[4] in "23456789"
    plan = plan_of(digits)
    if not plan or len(digits) > 15:
        return False
    lengths = {n for part in plan[0].split(",") for n in range(int(part.split("-")[0]), int(part.split("-")[-1]) + 1)}
    return len(plan[2]) in lengths and bool(re.match(plan[1], plan[2]))


def numbers():
    """For every code of up to three digits: national numbers of all lengths with all first digits."""
    rng = random.Random(5)
    for code in map(str, range(1, 1000)):
        for first in "0123456789":
            for size in range(4, 15 - len(code) + 1):
                if rng.random() < 0.25 or code in phone.PLANS:
                    yield code + first + "".join(rng.choice("0123456789") for _ in range(size - 1))


def test_numbers_of_every_country(spark):
    given = sorted(set(numbers()))
    df = spark.createDataFrame([(d,) for d in given], "d string")
    plus, zeros = F.concat(F.lit("+"), "d"), F.concat(F.lit("00"), "d")
    apart = F.concat(F.lit("at +"), F.substring("d", 1, 3), F.lit(" ("), F.substring("d", 4, 2), F.lit(") "), F.substring("d", 6, 20), F.lit("."))
    rows = df.select("d", phone.valid(plus).alias("plus"), phone.valid(zeros).alias("zeros"), phone.detect(plus).alias("found"), phone.detect(apart).alias("apart")).collect()
    right = {d: walked(d) for d in given}
    assert sum(right.values()) > 1000 and sum(not x for x in right.values()) > 10_000
    assert all(any(right[d] for d in given if d.startswith(code)) for code in phone.PLANS)
    assert [r.d for r in rows if r.plus != right[r.d]] == []
    assert [r.d for r in rows if r.zeros != right[r.d]] == []
    assert [r.d for r in rows if ("+" + r.d in r.found) != (right[r.d] and len(r.d) >= 7)] == []
    assert [r.d for r in rows if any(re.sub("[^0-9]", "", x) == r.d for x in r.apart) != (right[r.d] and len(r.d) >= 7)] == []


def test_detected_phones_of_all_texts(spark):
    """Each match of the query is a number by the walk, and each candidate that is one is found or overlaps with one that is."""
    got = {}
    for r in detect.detect_phone(spark, SF).collect():
        got.setdefault((r.src, r.id), []).append(r.match)
    assert got
    digits = lambda x: re.sub("[^0-9]", "", x)
    for key, found in got.items():
        for x in found:
            d = digits(x.removeprefix("00"))
            assert walked(d if x[0] == "+" or x.startswith("00") else "1" + d), (key, x)
    for r in detect.phone_candidates_intl_cells(spark, SF).collect():
        if walked(digits(r.match.removeprefix("00"))):
            assert r.match in got.get((r.src, r.id), []), r
