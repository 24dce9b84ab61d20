"""Validators, detectors and scalar functions."""

from pyspark.sql import functions as F

from ..functions import phone, text, validators
from ..operators import detectors
from .registry import query, table


def luhn_sql(d: str) -> str:
    n = f"CAST({d}[i] AS INTEGER)"
    return f"(coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN {n} WHEN {n} > 4 THEN 2 * {n} - 9 ELSE 2 * {n} END)), 1) % 10 = 0)"


def digits_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def mask_sql(x: str) -> str:
    return f"CASE WHEN length({x}) < 8 THEN repeat('*', length({x})) ELSE {x}[1:2] || repeat('*', length({x}) - 4) || right({x}, 2) END"


_CELLS = """(SELECT 'documents' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
UNION ALL SELECT 'orders', o_orderkey, 'ref ' || lpad(CAST(o_orderkey AS VARCHAR), 16, '4') || ', id ' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
 || ' iban DE' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '37040044' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || ' to user.' || CAST(o_custkey AS VARCHAR) || '@mail.example.com@x.org call +44 20 7946 ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || ' or (212) 234-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') FROM orders)"""


def cells(spark, sf):
    """Texts of all kinds, and cells made from orders in which every detector has something to find."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    pad = lambda c, m, n: F.lpad((F.col(c) % m).cast("string"), n, "0")
    made = F.concat(
        F.lit("ref "), F.lpad(key, 16, "4"), F.lit(", id "), pad("o_orderkey", 1000, 3), F.lit("-"), pad("o_custkey", 100, 2), F.lit("-"), pad("o_orderkey", 10000, 4), F.lit(" iban DE"), pad("o_orderkey", 100, 2), F.lit("37040044"), F.lpad(cust, 10, "0"),
        F.lit(" to user."), cust, F.lit("@mail.example.com@x.org call +44 20 7946 "), pad("o_orderkey", 10000, 4), F.lit(" or (212) 234-"), pad("o_custkey", 10000, 4),
    )
    parts = [
        table(spark, sf, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text"), table(spark, sf, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text")),
        table(spark, sf, "conversations").select(F.lit("conversations").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"), made.alias("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _found(df, detector):
    return df.select("src", "id", F.posexplode(detector(F.col("text"))).alias("place", "match")).withColumn("place", F.col("place").cast("bigint"))


def _found_sql(matches: str) -> str:
    return f"SELECT src, id, CAST(i - 1 AS BIGINT) AS place, m[i] AS match FROM (SELECT src, id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT src, id, {matches} AS m FROM {_CELLS}))"


_P = "'(^|[^A-Za-z0-9_])([0-9](?:[ -]?[0-9]){0,18})([A-Za-z0-9_]?)'"
CARD_SQL = f"list_transform(list_filter(list_zip(regexp_extract_all(text, {_P}, 2), regexp_extract_all(text, {_P}, 3)), lambda x: x[2] = '' AND length({digits_sql('x[1]')}) BETWEEN 13 AND 19 AND {luhn_sql(digits_sql('x[1]'))}), lambda x: x[1])"
_S = r"'(^|[^A-Za-z0-9_])(\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{3}\.\d{2}\.\d{4})([A-Za-z0-9_]?)'"
SSN_SQL = f"list_transform(list_filter(list_zip(regexp_extract_all(text, {_S}, 2), regexp_extract_all(text, {_S}, 3)), lambda x: x[2] = '' AND x[1][1:3] NOT IN ('000', '666') AND x[1][1] <> '9' AND x[1][5:6] <> '00' AND x[1][8:11] <> '0000'), lambda x: x[1])"
_VALID_EMAIL = r"""regexp_full_match({x}, '[A-Za-z0-9.!#$%&''*+/=?^_`{{|}}~-]{{1,64}}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,63}}') AND {x} NOT LIKE '.%' AND {x} NOT LIKE '%.@%' AND NOT contains(split_part({x}, '@', 1), '..') AND length(split_part({x}, '@', 2)) <= 253"""


def valid_email_sql(x: str) -> str:
    return _VALID_EMAIL.format(x=x)


_DOMAIN = "left(regexp_extract(g[i], '^[A-Za-z0-9.-]+'), 253)"
_ADDRESS = rf"regexp_extract(right(g[i - 1], 64), '[A-Za-z0-9.!#$%&''*+/=?^_`{{|}}~-]+$') || '@' || CASE WHEN regexp_matches(substr(g[i], length({_DOMAIN}) + 1, 1), '[A-Za-z0-9_]') THEN '' ELSE regexp_replace({_DOMAIN}, '[.-]+$', '') END"
EMAIL_SQL = f"list_filter(list_transform(range(2, len(string_split(text, '@')) + 1), lambda i: {_ADDRESS.replace('g[', 'string_split(text, chr(64))[')}), lambda x: {valid_email_sql('x')})"


def iban_rest_sql(x: str) -> str:
    """The remainder modulo 97 of an account number's letters and digits, turned; one reduce over code numbers."""
    kept = f"regexp_replace({x}, '[^A-Za-z0-9]', '', 'g')"
    turned = f"({kept}[5:] || {kept}[1:4])"
    codes = f"list_transform(string_split({turned}, ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    return f"list_reduce(list_prepend(0, {codes}), lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END)"


_SHAPES = "|".join(f"{c}[0-9]{{2}}(?:[ -]?[A-Za-z0-9]){{{n - 4}}}" for c, n in sorted(detectors.IBAN_LENGTHS.items()))
_AT = f"regexp_extract(substr(text, i, 70), '^({_SHAPES})', 1)"
IBAN_SQL = f"""CASE WHEN NOT regexp_matches(text, '[A-Z]{{2}}[0-9]{{2}}') THEN [] ELSE list_filter(list_transform(list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substr(text, i, 4), '^[A-Z]{{2}}[0-9]{{2}}') AND NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9]')),
lambda i: CASE WHEN regexp_matches(substr(text, i + length({_AT}), 1), '^[A-Za-z0-9]') THEN '' ELSE {_AT} END), lambda x: x <> '' AND NOT regexp_matches(x, '[a-z]') AND {iban_rest_sql('x')} = 1) END"""


@query(_found_sql(CARD_SQL))
def detect_credit_card(spark, sf):
    return _found(cells(spark, sf), detectors.credit_card)


@query(_found_sql(SSN_SQL))
def detect_ssn(spark, sf):
    return _found(cells(spark, sf), detectors.ssn)


@query(_found_sql(EMAIL_SQL))
def detect_email(spark, sf):
    return _found(cells(spark, sf), detectors.email)


@query(_found_sql(IBAN_SQL))
def detect_iban(spark, sf):
    return _found(cells(spark, sf), detectors.iban)


@query()
def detect_phone(spark, sf):
    return _found(cells(spark, sf), phone.detect)


def _calls(spark, sf, start):
    number = F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
    return table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"), F.concat(F.lit(f"call {start}"), number, F.lit("!")).alias("text"))


_CALLS = "SELECT 'orders' AS src, o_orderkey AS id, CAST(0 AS BIGINT) AS place, {} || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS match FROM orders"


@query(_CALLS.format("'+44 20 7946 '"))
def phone_candidates_intl(spark, sf):
    return _found(_calls(spark, sf, "+44 20 7946 "), phone.intl_candidates)


@query(_CALLS.format("'(212) 234-'"))
def phone_candidates_nanp(spark, sf):
    return _found(_calls(spark, sf, "(212) 234-"), phone.nanp_candidates)


@query()
def phone_candidates_intl_cells(spark, sf):
    return _found(cells(spark, sf), phone.intl_candidates)


@query()
def phone_candidates_nanp_cells(spark, sf):
    return _found(cells(spark, sf), phone.nanp_candidates)


def _keyed(spark, sf, value):
    return table(spark, sf, "orders").select("o_orderkey", value.alias("value"))


@query(f"SELECT o_orderkey, length({digits_sql('value')}) BETWEEN 13 AND 19 AND {luhn_sql(digits_sql('value'))} AS valid FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), CAST(12 + o_orderkey % 9 AS INTEGER), '4') AS value FROM orders)")
def valid_luhn(spark, sf):
    v = _keyed(spark, sf, F.lpad(F.col("o_orderkey").cast("string"), (12 + F.col("o_orderkey") % 9).cast("int"), F.lit("4")))
    return v.select("o_orderkey", validators.luhn(F.col("value")).alias("valid"))


@query(r"""SELECT o_orderkey, coalesce(regexp_full_match(v, '\d{3}([- .])\d{2}[- .]\d{4}') AND v[4] = v[7] AND v[1:3] NOT IN ('000', '666') AND v[1] <> '9' AND v[5:6] <> '00' AND v[8:11] <> '0000', false) AS valid
FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ['-', ' ', '.'][o_orderkey % 3 + 1] || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || ['-', ' ', '.', '-'][o_custkey % 4 + 1] || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS v FROM orders)""")
def valid_ssn(spark, sf):
    sep = lambda c, *s: F.element_at(F.array(*map(F.lit, s)), (F.col(c) % len(s) + 1).cast("int"))
    pad = lambda c, m, n: F.lpad((F.col(c) % m).cast("string"), n, "0")
    v = F.concat(pad("o_orderkey", 1000, 3), sep("o_orderkey", "-", " ", "."), pad("o_custkey", 100, 2), sep("o_custkey", "-", " ", ".", "-"), pad("o_orderkey", 10000, 4))
    return table(spark, sf, "orders").select("o_orderkey", validators.ssn(v).alias("valid"))


_EMAILS = ["user@example.com", "first.last@domain.co.uk", ".user@example.com", "user..name@example.com", "user@localhost", "user@-host.com", "a@b.cc", "user@example.c"]


@query(f"SELECT o_orderkey, {valid_email_sql('v')} AS valid FROM (SELECT o_orderkey, {_EMAILS!r}[o_orderkey % 8 + 1] || ['', 'x'][o_custkey % 2 + 1] AS v FROM orders)")
def valid_email(spark, sf):
    v = F.concat(F.element_at(F.array(*map(F.lit, _EMAILS)), (F.col("o_orderkey") % 8 + 1).cast("int")), F.element_at(F.array(F.lit(""), F.lit("x")), (F.col("o_custkey") % 2 + 1).cast("int")))
    return table(spark, sf, "orders").select("o_orderkey", validators.email(v).alias("valid"))


@query(f"SELECT o_orderkey, length(v) >= 15 AND {iban_rest_sql('v')} = 1 AS valid FROM (SELECT o_orderkey, 'GB' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || 'NWBK' || lpad(CAST(o_custkey AS VARCHAR), 14, '6') AS v FROM orders)")
def valid_iban(spark, sf):
    v = F.concat(F.lit("GB"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("NWBK"), F.lpad(F.col("o_custkey").cast("string"), 14, "6"))
    return table(spark, sf, "orders").select("o_orderkey", validators.iban(v).alias("valid"))


@query(f"SELECT o_orderkey, area >= '200' AND area NOT IN {phone.NO_AREA} AS valid FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS area FROM orders)")
def valid_phone(spark, sf):
    v = F.concat(F.lit("+1 "), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(" 234 5678"))
    return table(spark, sf, "orders").select("o_orderkey", phone.valid(v).alias("valid"))


@query(f"SELECT p_partkey, {mask_sql('p_name')} AS masked, {mask_sql('p_brand[1:5]')} AS short FROM part")
def mask_value(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.mask(F.col("p_name")).alias("masked"), text.mask(F.left("p_brand", F.lit(5))).alias("short"))


_SEVERITY = "['critical','high','medium','low','info'][n_nationkey % 5 + 1]"


def _severity():
    return F.element_at(F.array(*map(F.lit, text.SEVERITIES)), F.col("n_nationkey") % 5 + 1)


@query(f"SELECT n_nationkey, upper({_SEVERITY}) AS display FROM nation")
def severity_display(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.severity_display(_severity()).alias("display"))


@query("SELECT n_nationkey, n_nationkey % 5 AS rank FROM nation")
def severity_rank(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.severity_rank(_severity()).alias("rank"))


@query(f"SELECT n_nationkey, CASE WHEN {_SEVERITY} IN ('critical', 'high') THEN 'error' WHEN {_SEVERITY} = 'info' THEN 'info' ELSE 'warn' END AS level FROM nation")
def severity_log_level(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.log_level(_severity()).alias("level"))


def _keys(*pairs):
    return F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs])


@query("SELECT l_orderkey, l_linenumber, 'o=' || CAST(l_orderkey AS VARCHAR) || ',l=' || CAST(l_linenumber AS VARCHAR) AS keys FROM lineitem")
def pk_format_kv(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.keys_as_text(_keys(("o", F.col("l_orderkey")), ("l", F.col("l_linenumber")))).alias("keys"))


@query("""SELECT o_orderkey, '{"a":"' || CAST(o_custkey AS VARCHAR) || '","b":"' || CAST(o_orderkey AS VARCHAR) || '"}' AS keys FROM orders""")
def pk_json(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.to_json(text.keys_as_map(_keys(("b", F.col("o_orderkey")), ("a", F.lit("x")), ("a", F.col("o_custkey"))))).alias("keys"))


@query("""SELECT k, CASE WHEN us >= 1000000 THEN format('{:.2f}s', us / 1000000) WHEN us >= 1000 THEN format('{:.2f}ms', us / 1000) WHEN us >= 1 THEN format('{:.1f}us', us) ELSE format('{:.1f}ns', us * 1000) END AS said
FROM (SELECT p_partkey AS k, CAST(p_partkey AS DOUBLE) * CAST(p_partkey AS DOUBLE) / 8 AS us FROM part)""")
def fmt_duration(spark, sf):
    us = F.col("p_partkey").cast("double") * F.col("p_partkey").cast("double") / 8
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.duration(us).alias("said"))


@query("SELECT rpad(p_brand, 25, ' ') || ' ' || p_name AS line FROM part")
def rules_list(spark, sf):
    return table(spark, sf, "part").select(F.concat(text.padded(F.col("p_brand"), 25), F.lit(" "), F.col("p_name")).alias("line"))
