"""Vectors of values and texts, and detectors against plain walkers over random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from redactory.functions import globs, phone, regex, text, validators
from redactory.operators import detectors
from redactory.operators.rules import Allowlist, Engine, Rule, RuleError, Scope, guarded, load, load_script


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


VALID = {
    validators.luhn: (["4111111111111111", "5500000000000004", "378282246310005", "6011111111111117", "4111-1111-1111-1111", "0000000000000000"], ["4111111111111112", "411111", "41111111111111111111", "abcdefghijklm", ""]),
    validators.ssn: (["123-45-6789", "001-01-0001", "123 45 6789", "123.45.6789", "+12-+5-+678"], ["123-45 6789", "000-12-3456", "666-12-3456", "900-12-3456", "999-12-3456", "123-00-3456", "123-45-0000", ""]),
    validators.email: (
        ["user@example.com", "first.last@domain.co.uk", "user+tag@sub.example.com", "a@b.cc", "user_name@example.com", "user@123.com", "a" * 64 + "@b.cc"],
        ["user@localhost", "user@.com", "user@domain.", ".user@example.com", "user.@example.com", "user..name@example.com", "@example.com", "user@", "user@-host.com", "user@host-.com", "user@example.1", "user@example.c", "user@example.co2", "user@example.xn--p1ai", "a" * 65 + "@b.cc"],
    ),
    validators.iban: (["DE89370400440532013000", "GB29NWBK60161331926819", "FR7630006000011234567890189", "ES9121000418450200051332", "NL91ABNA0417164300", "NO9386011117947", "DE89 3704 0044 0532 0130 00"], ["DE00370400440532013000", "DELIVERY2024", "DE", "", "de89370400440532013000"]),
    phone.valid: (["+44 20 7946 0958", "+1 212 234 5678", "(212) 234-5678", "0033 1 23 45 67 89"], ["12345", "+999 1234567", "+7612345", "(555) 234-5678", ""]),
}


@pytest.mark.parametrize("check", VALID, ids=lambda c: f"{c.__module__}.{c.__name__}")
def test_validators(spark, check):
    good, bad = VALID[check]
    assert column(spark, [*good, *bad], check) == [True] * len(good) + [False] * len(bad)


FOUND = {
    detectors.credit_card: {
        "pay 41111 with 4111111111111111 please": ["4111111111111111"], "card: 4111-1111-1111-1111": ["4111-1111-1111-1111"], "card: 4111 1111 1111 1111": ["4111 1111 1111 1111"], "card: 4111111111111112": [], "abc4111111111111111xyz": [],
        "cards: 4111111111111111 and 5500000000000004": ["4111111111111111", "5500000000000004"], "カード4111111111111111番号": ["4111111111111111"], "4111€11111111111": [], "": [],
    },
    detectors.ssn: {"ssn is 123-45-6789": ["123-45-6789"], "€123-45-6789": ["123-45-6789"], "番号123-45-6789です": ["123-45-6789"], "abc123-45-6789xyz": [], "123€45-6789": []},
    detectors.email: {
        "a@b.co@d.com": ["a@b.co", "b.co@d.com"], "user@example.com.": ["user@example.com"], "user@example.com-": ["user@example.com"], "user@example.com_suffix": [], "user@example.com3": [], "@@": [], "連絡 user@example.com please": ["user@example.com"],
        "a" * 65 + "@b.co": ["a" * 64 + "@b.co"],
    },
    detectors.iban: {"send DE89370400440532013000 and NL91ABNA0417164300": ["DE89370400440532013000", "NL91ABNA0417164300"], "xDE89370400440532013000": [], "DE89370400440532013000x": [], "DECEMBER": [], "XX89370400440532013000": [], "DE89 3704 0044 0532 0130 00": ["DE89 3704 0044 0532 0130 00"]},
    phone.detect: {"call +44 20 7946 0958 or (212) 234-5678": ["+44 20 7946 0958", "(212) 234-5678"], "192.168.1.1": [], "order #5551234567": [], "_212-234-5678_": ["212-234-5678"], "abc+44 20 7946 0958xyz": []},
}


@pytest.mark.parametrize("detector", FOUND, ids=lambda d: d.__name__)
def test_detectors(spark, detector):
    assert column(spark, list(FOUND[detector]), detector) == list(FOUND[detector].values())
    assert column(spark, [None], detector) == [[]]


def walk_cards(s):
    """Byte by byte, as the rule is stated."""
    out, i = [], 0
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    while i < len(s):
        if not s[i].isdigit() or not s[i].isascii() or i and word(s[i - 1]):
            i += 1
            continue
        j, digits = i, ""
        while j < len(s) and len(digits) < 19:
            if "0" <= s[j] <= "9":
                digits += s[j]
                j += 1
            elif s[j] in " -" and "0" <= s[j + 1 : j + 2] <= "9" and s[j + 1 : j + 2]:
                j += 1
            else:
                break
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
        if 13 <= len(digits) <= 19 and total % 10 == 0 and not (j < len(s) and word(s[j])):
            out.append(s[i:j])
        i = j
    return out


def test_cards_like_a_walker(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789 -ax_é4111") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["".join(rng.choice("04 -") for _ in range(40)) for _ in range(400)]
    assert column(spark, texts, detectors.credit_card) == [walk_cards(t) for t in texts]


def test_found_values_keep_their_promises(spark):
    rng = random.Random(6)
    bits = ["4111111111111111", "user@mail.example.com", "@", "123-45-6789", "DE89370400440532013000", "+44 20 7946 0958", "(212) 234-5678", " ", "x", ".", "-", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    for d, fine in ((detectors.ssn, lambda m: len(m) == 11), (detectors.email, lambda m: m.count("@") == 1 and 1 <= len(m.split("@")[0]) <= 64), (detectors.iban, lambda m: 15 <= len(re.sub("[^A-Za-z0-9]", "", m)) <= 34), (phone.detect, lambda m: 7 <= len(re.sub(r"\D", "", m)) <= 17)):
        for t, found in zip(texts, column(spark, texts, d), strict=True):
            assert all(m in t and fine(m) for m in found)


def test_mask(spark):
    given = {"": "", "a": "*", "abcdefg": "*******", "abcdefgh": "ab****gh", "1234567890": "12******90", "secretvalue": "se*******ue", "4111111111111111": "41************11"}
    assert column(spark, list(given), text.mask) == list(given.values())


def test_durations(spark):
    df = spark.createDataFrame([(0.05,), (12.34,), (1500.0,), (1.5e6,)], "us double")
    assert [r[0] for r in df.select(text.duration(F.col("us"))).collect()] == ["50.0ns", "12.3us", "1.50ms", "1.50s"]


def test_durations_are_rounded_by_their_exact_value(spark):
    rng = random.Random(3)
    values = [k * k / 8 for k in (1, 3, 3000, 3800, 5000, 6200)] + [1.005e6, 2.675e6, 1.25, 0.00125, 999_999.9, 0.0, 1e15] + [rng.randrange(1, 10**9) / rng.choice([1, 2, 8, 20, 200, 1000, 10**7]) for _ in range(2000)]
    said = [f"{v / 1e6:.2f}s" if v >= 1e6 else f"{v / 1000:.2f}ms" if v >= 1000 else f"{v:.1f}us" if v >= 1 else f"{v * 1000:.1f}ns" for v in values]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "us double").select(text.duration(F.col("us"))).collect()] == said


def test_globs():
    cases = [("audit_*", "audit_log", True), ("audit_*", "user_audit", False), ("audit_*", "audit", False), ("db?", "db1", True), ("db?", "db10", False), ("db?", "db", False), ("users", "users", True), ("users", "users_extra", False), ("{a,b}*", "bc", True), ("[!a]*", "abc", False), ("a*", "a/b", True), ("A*", "ab", False)]
    for pattern, name, there in cases:
        assert globs.Names([pattern]).has(name) is there, (pattern, name)
    with pytest.raises(ValueError):
        globs.Names(["{unclosed*"])


def test_patterns_in_javas_dialect(spark):
    assert column(spark, ["x\n", "x"], lambda c: c.rlike(regex.to_java("x$"))) == [False, True]
    assert column(spark, ["٣"], lambda c: c.rlike(regex.to_java(r"^\d$"))) == [True]
    assert column(spark, ["éAKIA", "AKIA"], lambda c: c.rlike(regex.to_java(r"\bAKIA"))) == [False, True]
    assert column(spark, ["ab"], lambda c: F.regexp_extract(c, regex.to_java("(?P<first>a)b"), 1)) == ["a"]
    for bad in (r"(?=a)", r"(?<!a)b", r"(a)\1", "[a", "a\\", "(a"):
        with pytest.raises(regex.PatternError):
            regex.to_java(bad)


def test_engine_order_gate_and_allowlist(spark):
    def shout(v):
        return [w for w in v.split() if w.isupper()]

    engine = Engine([Rule("s", kind="script", script=shout), Rule("c", kind="builtin", builtin="credit_card"), Rule("f", pattern=r"\bfoo\b")])
    found = column(spark, ["foo 4111111111111111 KEYWORD", None], lambda c: F.transform(engine.matches(c), lambda m: m["rule_id"]))
    assert found == [["f", "c", "s"], []]
    gate = Engine([Rule("g", pattern=r"\d{16}", validate="luhn")])
    assert column(spark, ["4111111111111112 4111111111111111", "4111111111111111"], lambda c: F.size(gate.matches(c))) == [0, 1]
    allow = Engine([Rule("a", pattern=r"\w+@\w+", allowlist=Allowlist(values=["a@b"], patterns=["^x"]))])
    assert column(spark, ["a@b c@d", "x@y", "c@d"], lambda c: F.size(allow.matches(c))) == [0, 0, 1]
    allow = Engine([Rule("a", kind="builtin", builtin="email", allowlist=Allowlist(patterns=[r"@b\."]))])
    assert column(spark, ["a@b.co x a@c.co"], lambda c: allow.matches(c)["matched"]) == [["a@c.co"]]


def test_rules_that_are_refused(tmp_path):
    for bad in ({"id": ""}, {"id": "a"}, {"id": "a", "kind": "builtin"}, {"id": "a", "kind": "builtin", "builtin": "x"}, {"id": "a", "pattern": "("}, {"id": "a", "pattern": "a", "severity": "x"}, {"id": "a", "pattern": "a", "validate": "x"}):
        with pytest.raises(ValueError):
            Rule(**bad)
    with pytest.raises(RuleError):
        Scope(include_tables=["t"], exclude_tables=["t"])
    with pytest.raises(RuleError):
        Engine([Rule("a", pattern="a"), Rule("a", pattern="b")])
    (tmp_path / "r.toml").write_text('[[rules]]\nid = "a"\npattern = "a"\nno_such = 1\n')
    with pytest.raises(RuleError):
        load(tmp_path / "r.toml")


def test_scripts():
    for bad in ("x = 1", "def detect(a, b): return []", "def detect(v): return 1", "def detect(v):\n  while True: pass", "import os\ndef detect(v): return []", "def detect(v): return v.__class__", "def detect("):
        with pytest.raises(RuleError):
            load_script(bad)
    fn = load_script("def detect(v):\n  return [w for w in v.split() if w == 'x']")
    assert guarded(fn, "x y x") == ["x", "x"]
    assert guarded(fn, "x" * 10_001) is None
    assert guarded(lambda v: 1 / 0, "a") is None
    assert guarded(load_script("def detect(value):\n    return ['a'] * 1001 if value else []\n"), "a") is None
    assert guarded(lambda v: ["a"] * 1001, "a") == ["a"] * 1001  # functions of Python code have no bound on items


@pytest.mark.parametrize(
    ("value", "found"),
    [
        ("(2122345678", []), ("2122345678", []), ("(212)2345678", ["(212)2345678"]), ("+880 1712 345678", ["+880 1712 345678"]), ("+256 772 123456", ["+256 772 123456"]), ("+216 71 123 456", ["+216 71 123 456"]),
        ("+43 1234567890123 4", ["+43 1234567890123"]), ("+43 12345678901234", []), ("+12122345678999", []), ("00 44 20 7946 0958", ["20 7946 0958"]), ("+44 (20) 7946-0958.", ["+44 (20) 7946-0958"]), ("x212-234-5678", []), ("212-234-5678x", []),
        ("(555) 234-5678", []), ("+999 1234567", []), ("+1 2 1 2 2 3 4 5 6 7 8", ["+1 2 1 2 2 3 4 5 6 7 8"]), ("312-456-7890 212-234-5678", ["312-456-7890", "212-234-5678"]), (None, []), ("", []), ("+" * 50 + "9" * 5000, []),
    ],
)
def test_phone_vectors(spark, value, found):
    assert spark.createDataFrame([(value,)], "v string").select(phone.detect(F.col("v"))).first()[0] == found


@pytest.mark.parametrize(
    ("pattern", "held"),
    [("a|bc", []), ("(?i)abc", []), ("ab?c", []), ("abc+d", ["abc"]), ("x(?:ab|cd)?y", []), ("foo|ba[rz]qux", ["foo", "qux"]), (r"\bfoo\.bar\b", ["foo.bar"]), ("(abc)*de", ["de"]), ("[a-z]{16}", []), (r"\d{13,16}", []), ("(?:gh|gl)_[0-9]{36}", ["gh", "gl"]), (r"\x41bcd", []), (r"ab\p{L}cde", []), ("a(b|c{2}|de)f", []), ("[]ab]cd", ["cd"])],
)
def test_what_every_match_holds(pattern, held):
    assert regex.literals(pattern) == held


def test_every_match_of_shipped_patterns_holds_a_literal():
    for rule in load("redactory/rules.toml"):
        if rule.kind == "regex" and (held := regex.literals(rule.pattern)):
            rng = random.Random(rule.id)
            texts = [text for _ in range(200) if re.search(rule.pattern, text := made_by(rule.pattern, rng))]
            assert len(texts) > 20 and all(any(x in text for x in held) for text in texts), rule.id


def made_by(pattern, rng):
    """A text that the pattern matches."""
    from re import _parser as sre

    def one(code, arg):
        code = str(code)
        if code == "LITERAL":
            return chr(arg)
        if code == "IN":
            kind, value = rng.choice([x for x in arg if str(x[0]) in ("LITERAL", "RANGE", "CATEGORY")])
            return chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value)) if str(kind) == "RANGE" else "7"
        if code == "MAX_REPEAT":
            return "".join(many(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
        if code == "SUBPATTERN":
            return many(arg[3])
        if code == "BRANCH":
            return many(rng.choice(arg[1]))
        return "7" if code == "CATEGORY" else ""

    def many(parts):
        return "".join(one(*p) for p in parts)

    return many(sre.parse(pattern)) + " "
