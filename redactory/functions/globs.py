"""Lists of names and globs, as Python predicates and as column conditions.

A pattern with ``*`` or ``?`` is a glob, in which ``[a-z]``, ``{a,b}`` and backslashes
count too; others are compared as they are. Matching is case-sensitive, and ``*``
matches any characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def to_regex(glob: str) -> str:
    """A regular expression for both Python and Java; raises ValueError for an open ``{``, ``[`` or backslash."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "\\":
            if i == len(glob):
                raise ValueError(f"a backslash ends the glob {glob!r}")
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            end = glob.find("]", i + (2 if glob[i : i + 1] in ("!", "^") else 1))
            if end < 0:
                raise ValueError(f"an open [ in the glob {glob!r}")
            inner, no = glob[i:end], glob[i : i + 1] in ("!", "^")
            out.append("[" + "^" * no + inner[no:].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&") + "]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
    if depth:
        raise ValueError(f"an open {{ in the glob {glob!r}")
    return "".join(out)


class Names:
    """Any of some names and globs."""

    def __init__(self, patterns: Iterable[str] = ()):
        self.patterns = list(patterns)
        self.exact = [p for p in self.patterns if not is_glob(p)]
        self.globs = [to_regex(p) for p in self.patterns if is_glob(p)]
        self._compiled = [re.compile(g) for g in self.globs]

    def __bool__(self) -> bool:
        return bool(self.patterns)

    def has(self, name: str) -> bool:
        return name in self.exact or any(g.fullmatch(name) for g in self._compiled)

    def column(self, name: Column) -> Column:
        out = name.isin(*self.exact) if self.exact else F.lit(False)
        return out | name.rlike(rf"\A(?:{'|'.join(self.globs)})\z") if self.globs else out
