"""Users' patterns against what their own dialect finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from redactory.functions.regex import PatternError, literals, to_java

CASES = [
    (r"(?im)^ab$", "ab\ncd", "ab"), (r"(?i)^AB$", "ab\ncd", None), (r"(?m:^a$)|b$", "x\na\ny", "a"), (r"(?m:a)$", "a\nb", None), (r"(?m)(?-m:a$)", "a\nb", None),
    ("a++a", "aaa", None), ("a+*b", "aab", "aab"), ("a{2}{3}", "aaaaaaa", "aaaaaa"), ("a**?b", "aab", "aab"), ("(ab)?+c", "ababc", "ababc"),
    ("[a-z--m]+", "klmn", "kl"), (r"[\w--[a-c]--x]+", "abxyz", "yz"), ("[^a-z--m]", "am", "m"), ("[a-z&&[^aeiou]]+", "aeibcd", "bcd"), ("[]a]+", "x]a]", "]a]"), ("[[:digit:]x]+", "a1x2", "1x2"),
    (r"(?P<n_1>x)y", "xy", "xy"), (r"\p{Greek}+", "aαβ", "αβ"), ("a-[0-9-]+", "a-1-2", "a-1-2"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, to_java(p)) for i, (p, t, _) in enumerate(CASES)], "i int, t string, p string")
    got = {r.i: r.m if r.has else None for r in df.select("i", F.expr("t rlike p").alias("has"), F.expr("regexp_extract(t, p, 0)").alias("m")).collect()}
    want = {i: m for i, (_, _, m) in enumerate(CASES)}
    want[5] = "aaa"  # (a+)+ and then an a
    assert got == want


@pytest.mark.parametrize("bad", ["(?>ab)c", "(?#x)", "(?|a)", "(?=a)", "(?<!a)b", r"(a)\1", r"\k<a>", "(?U)a", "[a~~b]", "(a", "a)", "[a", "a\\", "[[:alpha", "*a"])
def test_refused(bad):
    with pytest.raises(PatternError):
        to_java(bad)


def test_random_patterns(spark):
    """Against Python's engine, which reads groups in place of repeated quantifiers the same way."""
    rng = random.Random(4)

    def item(depth, python):
        kind = rng.randrange(6 if depth else 4)
        if kind < 2:
            return (x := rng.choice("abc")), x
        if kind == 2:
            return (x := rng.choice(["[ab]", "[^a]", ".", r"\w", "[b-c]"])), x
        if kind == 3:
            return ("[a-c--b]", "[ac]")
        left, right = alternatives(depth - 1)
        return f"({left})", f"({right})"

    def repeated(depth):
        ours, theirs = item(depth, False)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            q = rng.choice(["*", "+", "{2}", "{1,2}"])
            ours, theirs = ours + q, f"(?:{theirs}){q}"
        return ours, theirs

    def alternatives(depth):
        parts = [[repeated(depth) for _ in range(rng.randint(1, 3))] for _ in range(rng.choice([1, 1, 2]))]
        return tuple("|".join("".join(x[k] for x in p) for p in parts) for k in (0, 1))

    rows, want = [], []
    for n in range(250):
        ours, theirs = alternatives(2)
        end = rng.choice(["", "$"])
        for text in ("".join(rng.choice("abc\n") for _ in range(rng.randint(0, 7))) for _ in range(4)):
            m = re.search(f"(?:{theirs}){end.replace('$', chr(92) + 'Z')}", text)
            rows.append((len(rows), text, to_java(f"(?:{ours}){end}")))
            want.append(m.group() if m else None)
            assert not m or not (held := literals(ours)) or any(x in m.group() for x in held)
    df = spark.createDataFrame(rows, "i int, t string, p string")
    got = {r.i: r.m if r.has else None for r in df.select("i", F.expr("t rlike p").alias("has"), F.expr("regexp_extract(t, p, 0)").alias("m")).collect()}
    wrong = [(rows[i], got[i], want[i]) for i in range(len(rows)) if got[i] != want[i]]
    assert not wrong, wrong[:3]


def test_needed_texts():
    assert literals("ab+*c") == [] and literals("abc+d") == ["abc"] and literals("xyz{2}{0,1}") == ["xy"]
