"""Rules: what to look for, compiled into column expressions.

A rule is a pattern (its first match in a cell, then a check and the allowlist; a
failing first match gives nothing), a detector (all matches) or a function of a
text (all strings it returns). Findings of a cell come in that order of kinds,
within a kind in the order of the rules.
"""

from __future__ import annotations

import ast
import inspect
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.globs import Names
from ..functions.regex import literals, to_java
from ..functions.text import SEVERITIES
from .detectors import DETECTORS, VALIDATORS

KINDS = ("regex", "builtin", "script")
#: What a function given as source may get and give. Functions of Python code are trusted with texts of any length. What goes over a bound gives nothing and is counted.
MAX_TEXT, MAX_ITEMS, MAX_STEPS = 10_000, 1000, 100_000


class RuleError(ValueError):
    pass


@dataclass
class Scope:
    """Where a rule holds; empty include lists mean everywhere."""

    include_schemas: list[str] = field(default_factory=list)
    include_tables: list[str] = field(default_factory=list)
    exclude_tables: list[str] = field(default_factory=list)
    include_columns: list[str] = field(default_factory=list)
    exclude_columns: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for what in ("tables", "columns"):
            both = set(getattr(self, f"include_{what}")) & set(getattr(self, f"exclude_{what}"))
            if both:
                raise RuleError(f"included and excluded {what}: {', '.join(sorted(both))}")
        self._in = [Names(x) for x in (self.include_schemas, self.include_tables, self.include_columns)]
        self._out = [Names(x) for x in (self.exclude_tables, self.exclude_columns)]

    def matches(self, schema: str, table: str, column: str) -> bool:
        return all(not n or n.has(x) for n, x in zip(self._in, (schema, table, column), strict=True)) and not any(n.has(x) for n, x in zip(self._out, (table, column), strict=True))

    def column(self, schema: Column, table: Column, column: Column) -> Column:
        """The same for names that are data."""
        out = F.lit(True)
        for names, x in zip(self._in, (schema, table, column), strict=True):
            out = out & names.column(x) if names else out
        for names, x in zip(self._out, (table, column), strict=True):
            out = out & ~names.column(x) if names else out
        return out


@dataclass
class Allowlist:
    """Matches that are no findings: whole values, or patterns found anywhere in them."""

    description: str = ""
    values: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)

    def column(self, match: Column) -> Column:
        out = match.isin(*self.values) if self.values else F.lit(False)
        for p in self.patterns:
            out = out | match.rlike(to_java(p))
        return out


@dataclass
class Rule:
    id: str
    description: str = ""
    category: str = ""
    severity: str = "medium"
    kind: str = "regex"
    pattern: str | None = None
    validate: str | None = None
    builtin: str | None = None
    script: Callable[[str], list[str]] | str | None = None
    allowlist: Allowlist | None = None
    scope: Scope | None = None
    channels: list[str] | None = None

    def __post_init__(self) -> None:
        if not self.id:
            raise RuleError("a rule needs an id")
        if self.severity not in SEVERITIES:
            raise RuleError(f"{self.id}: no severity {self.severity!r}")
        if self.kind not in KINDS:
            raise RuleError(f"{self.id}: no kind {self.kind!r}")
        if getattr(self, {"regex": "pattern"}.get(self.kind, self.kind)) is None:
            raise RuleError(f"{self.id}: a {self.kind} rule needs its {self.kind if self.kind != 'regex' else 'pattern'}")
        if self.validate is not None and self.validate not in VALIDATORS:
            raise RuleError(f"{self.id}: no check {self.validate!r}")
        if self.kind == "builtin" and self.builtin not in DETECTORS:
            raise RuleError(f"{self.id}: no detector {self.builtin!r}")
        if self.kind == "script":
            self.script = load_script(self.script)
        if self.kind == "regex":
            to_java(self.pattern)

    def allowed(self, found: Column) -> Column:
        return F.filter(found, lambda m: ~self.allowlist.column(m)) if self.allowlist else found

    def matches(self, text: Column) -> Column:
        """``array<string>`` of what the rule finds in a cell, checked and without allowed values."""
        if self.kind == "regex":
            java = to_java(self.pattern)
            looks = text.rlike(java)
            if some := literals(self.pattern):
                held = text.contains(some[0])
                for x in some[1:]:
                    held = held | text.contains(x)
                looks = held & looks
            first = F.when(looks, F.regexp_extract(text, java, 0))
            keep = first.isNotNull()
            if self.validate:
                keep = keep & VALIDATORS[self.validate](first)
            if self.allowlist:
                keep = keep & ~self.allowlist.column(first)
            return F.when(keep, F.array(first)).otherwise(F.array().cast("array<string>"))
        found = DETECTORS[self.builtin](text) if self.kind == "builtin" else _run(self.script)(text)
        return self.allowed(found)


class _Bounded(ast.NodeTransformer):
    """Refuses what a script has no use for: imports, names with two underscores, other statements at the top."""

    def generic_visit(self, node: ast.AST) -> ast.AST:
        name = getattr(node, "attr", getattr(node, "id", ""))
        if isinstance(node, ast.Import | ast.ImportFrom | ast.Global | ast.Nonlocal) or "__" in str(name):
            raise RuleError(f"a script may not use {type(node).__name__} {name}")
        return super().generic_visit(node)


def _limited(fn: Callable[[str], list[str]]) -> Callable[[str], list[str]]:
    """``fn`` with a bound on lines run."""
    import sys

    def run(value: str) -> list[str]:
        left = MAX_STEPS

        def trace(frame, event, arg):
            nonlocal left
            left -= 1
            if left < 0:
                raise RuleError("too many steps")
            return trace

        before = sys.gettrace()
        sys.settrace(trace)
        try:
            return fn(value)
        finally:
            sys.settrace(before)

    return run


def load_script(source: Callable[[str], list[str]] | str) -> Callable[[str], list[str]]:
    """A function ``detect(value) -> list of str``, given as such or as source; tried with an empty text.

    Source runs with few builtins and a bound on its steps. That keeps mistakes from
    harm; it is no wall against ill will.
    """
    if isinstance(source, str):
        names: dict = {"__builtins__": {n: __builtins__[n] if isinstance(__builtins__, dict) else getattr(__builtins__, n) for n in "len range str int float bool list dict set tuple min max sum sorted enumerate zip any all abs reversed isinstance ord chr".split()}}
        import re

        names["re"] = re
        try:
            exec(compile(_Bounded().visit(ast.parse(source)), "script", "exec"), names)  # noqa: S102
        except SyntaxError as e:
            raise RuleError(str(e)) from e
        fn = names.get("detect")
        if not callable(fn):
            raise RuleError("a script needs a function detect")
        checked = _limited(fn)
        checked.bounded = True
    else:
        fn = checked = source
    if len(inspect.signature(fn).parameters) != 1:
        raise RuleError("detect takes one value")
    try:
        tried = checked("")
    except Exception as e:
        raise RuleError(f"detect fails for an empty text: {e}") from e
    if not isinstance(tried, list):
        raise RuleError("detect returns a list of strings")
    return checked


def guarded(script: Callable[[str], list[str]], value: str | None) -> list[str] | None:
    """What a script returns; None where it fails or goes over its bounds."""
    if value is None:
        return []
    try:
        bounded = getattr(script, "bounded", False)
        if bounded and len(value) > MAX_TEXT:
            return None
        out = script(value)
        fine = isinstance(out, list) and not (bounded and len(out) > MAX_ITEMS) and all(isinstance(x, str) and not (bounded and len(x) > MAX_TEXT) for x in out)
        return out if fine else None
    except Exception:
        return None


def _run(script: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    @F.arrow_udf("array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([guarded(script, t) or [] for t in b.to_pylist()], pa.list_(pa.string()))

    return found


def of_cells(script: Callable[[str], list[str]], cells: Column) -> Column:
    """What a function finds in each of an array of cells: ``array<array<string>>``, an event at a time; null where it fails or goes over its bounds."""

    @F.arrow_udf("array<array<string>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if row is None else [guarded(script, t) for t in row] for row in b.to_pylist()], pa.list_(pa.list_(pa.string())))

    return found(cells)


def cells_failed(script: Callable[[str], list[str]], cells: Column) -> Column:
    """For how many of an array of cells a function fails or goes over its bounds."""

    @F.arrow_udf("long")
    def failed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([sum(guarded(script, t) is None for t in row or []) for row in b.to_pylist()], pa.int64())

    return failed(cells)


def script_failed(rule: Rule, text: Column) -> Column:
    """Whether a rule's function fails for a text, to be counted by rule."""
    script = rule.script

    @F.arrow_udf("boolean")
    def failed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([guarded(script, t) is None for t in b.to_pylist()], pa.bool_())

    return failed(text)


MATCH = "struct<rule_id: string, description: string, category: string, severity: string, matched: string, channels: array<string>>"


class Engine:
    """Rules, compiled; ``matches`` is one expression for a cell."""

    def __init__(self, rules: list[Rule]):
        ids = [r.id for r in rules]
        if len(set(ids)) < len(ids):
            raise RuleError(f"rules with one id: {', '.join(sorted({i for i in ids if ids.count(i) > 1}))}")
        self.rules = [r for kind in KINDS for r in rules if r.kind == kind]

    def __len__(self) -> int:
        return len(self.rules)

    def within(self, schema: str, table: str, column: str) -> list[Rule]:
        """The rules that hold for a column: the others never become part of a plan."""
        return [r for r in self.rules if not r.scope or r.scope.matches(schema, table, column)]

    def matches(self, text: Column, rules: list[Rule] | None = None) -> Column:
        """``array<MATCH>`` in order of kinds, rules and places; empty for null."""
        return self.tagged(text, [(r, None) for r in (self.rules if rules is None else rules)])

    def tagged(self, text: Column, rules: list[tuple[Rule, Column | None]]) -> Column:
        """The same of rules some of which come with what they have found."""
        found = []
        for r, own in rules:
            channels = F.array(*map(F.lit, r.channels)).cast("array<string>") if r.channels is not None else F.lit(None).cast("array<string>")
            said = [F.lit(x).alias(n) for n, x in (("rule_id", r.id), ("description", r.description), ("category", r.category), ("severity", r.severity))]
            found.append(_tagged(r.matches(text) if own is None else r.allowed(own), said, channels))
        none = F.array().cast(f"array<{MATCH}>")
        return F.coalesce(F.when(text.isNotNull(), F.concat(none, *found)), none) if found else none


def _tagged(matches: Column, said: list[Column], channels: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(*said, m.alias("matched"), channels.alias("channels")))


def from_dict(raw: dict, folder: Path | None = None) -> Rule:
    known = dict(raw)
    known["kind"] = known.pop("type", "regex")
    if "allowlist" in known:
        known["allowlist"] = Allowlist(**known["allowlist"])
    if "scope" in known:
        known["scope"] = Scope(**known["scope"])
    if known["kind"] == "script" and isinstance(known.get("script"), str):
        path = (folder or Path()) / known["script"]
        if not path.is_file():
            raise RuleError(f"{known.get('id')}: no script {path}")
        known["script"] = path.read_text()
    try:
        return Rule(**known)
    except TypeError as e:
        raise RuleError(str(e)) from e


def load(path: str | Path) -> list[Rule]:
    """The ``[[rules]]`` of a TOML file."""
    path = Path(path)
    return [from_dict(r, path.parent) for r in tomllib.loads(path.read_text()).get("rules", [])]
