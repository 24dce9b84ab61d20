"""Users' patterns in Java's dialect.

Patterns are written for an engine without look-around and back-references, with
Unicode classes; such patterns get flags and anchors so that Java finds the same,
and patterns that engine would refuse are refused here.
"""

from __future__ import annotations

import re
import warnings

#: Unicode classes and word boundaries; only \n ends a line for the dot.
FLAGS = "(?U)(?d)"


class PatternError(ValueError):
    pass


_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])")
_QUANTIFIER = re.compile(r"[*+?]|\{\d+(,\d*)?\}")


def _escaped(pattern: str, at: int) -> tuple[str, int]:
    """What a backslash begins, in Java's notation, and where it ends: names of scripts and properties begin with ``Is`` there."""
    two, end = pattern[at : at + 2], at + 2
    if two in (r"\p", r"\P", r"\x", r"\u") and pattern[end : end + 1] == "{":
        close = pattern.find("}", end)
        if close < 0:
            raise PatternError("an open { in the pattern")
        name = pattern[end + 1 : close]
        return (two + "{" + ("Is" if two[1] in "pP" and len(name) > 2 and name.isalpha() and not name.startswith("Is") else "") + name + "}").replace(r"\u{", r"\x{"), close + 1
    return two, end


def _class_to_java(pattern: str, at: int) -> tuple[str, int]:
    """A class that begins at ``at`` in Java's notation, and where it ends. ``--`` is difference; Java has it as an intersection with what is not in the rest."""
    out, i = "[", at + 1
    if pattern[i : i + 1] == "^":
        out, i = "[^", i + 1
    if pattern[i : i + 1] == "]":
        out, i = out + r"\]", i + 1
    without = False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            if len(two) == 1:
                break
            text, i = _escaped(pattern, i)
            out += text
        elif two[0] == "[":
            if pattern.startswith("[:", i):
                end = pattern.find(":]", i)
                name = pattern[i + 2 : end].removeprefix("^")
                if end < 0 or not name.isalpha():
                    raise PatternError("an open [ in the pattern")
                out, i = out + (r"\P" if pattern[i + 2] == "^" else r"\p") + "{" + {"word": "IsWord"}.get(name, name.capitalize()) + "}", end + 2
            else:
                inner, i = _class_to_java(pattern, i)
                out += inner
        elif two == "~~":
            raise PatternError("symmetric differences of classes are not supported")
        elif two in ("--", "&&"):
            out, i = out + ("]" if without else "") + ("&&[^" if two == "--" else "&&"), i + 2
            without = two == "--"
        elif two[0] == "]":
            # What is not in the rest is taken from the whole class, before it is negated.
            return (f"[^[{out[2:]}" + ("]" if without else "") + "]]" if out.startswith("[^") and "&&" in out else out + ("]" if without else "") + "]"), i + 1
        else:
            out, i = out + two[0], i + 1
    raise PatternError("an open [ in the pattern")


def to_java(pattern: str) -> str:
    """The same pattern for ``rlike`` and ``regexp_extract``; raises :class:`PatternError`.

    One pass that knows where the last item began, so that a repetition of a repetition (which Java would read as
    possessive) gets a group, and which flags hold, so that ``$`` is a line's end where ``m`` does.
    """
    out: list[str] = []
    groups: list[tuple[int, bool]] = []
    multiline, item, repeated, lazy, i = False, None, False, False, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        quantifier = _QUANTIFIER.match(pattern, i)
        if quantifier and item is None:
            raise PatternError(f"nothing to repeat before {quantifier.group()}")
        if quantifier:
            said = quantifier.group()
            if repeated and said == "?" and not lazy:
                out[-1] += said
                lazy = True
            else:
                out[item:] = ["(?:", *out[item:], ")", said] if repeated else [*out[item:], said]
                repeated, lazy = True, False
            i = quantifier.end()
            continue
        repeated = lazy = False
        if c == "\\":
            if i + 1 == len(pattern):
                raise PatternError("a backslash ends the pattern")
            if pattern[i + 1].isdigit() and pattern[i + 1] != "0" or pattern[i + 1] == "k":
                raise PatternError("back-references are not supported")
            item = len(out)
            text, i = _escaped(pattern, i)
            out.append(text)
        elif c == "[":
            made, i = _class_to_java(pattern, i)
            item = len(out)
            out.append(made)
        elif two == "(?":
            flags = _FLAGS.match(pattern, i)
            if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
                raise PatternError("look-around is not supported")
            if flags:
                on, off, end = flags.group(1), flags.group(2) or "", flags.group(3)
                if set(on + off) - set("imsx-"):
                    raise PatternError(f"flags {on}{off} are not supported")
                if end == ":":
                    groups.append((len(out), multiline))
                multiline = "m" in on or multiline and "m" not in off
                item = None
                out.append(flags.group())
                i = flags.end()
            elif named := re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(pattern, i):
                groups.append((len(out), multiline))
                item = None
                out.append(f"(?<{named.group(1).replace('_', '')}>")
                i = named.end()
            else:
                raise PatternError(f"no group begins with {pattern[i : i + 3]}")
        elif c == "(":
            groups.append((len(out), multiline))
            item = None
            out.append(c)
            i += 1
        elif c == ")":
            if not groups:
                raise PatternError("a ) without (")
            item, multiline = groups.pop()
            out.append(c)
            i += 1
        else:
            item = None if c in "^|" else len(out)
            out.append(r"\z" if c == "$" and not multiline else c)
            i += 1
    if groups:
        raise PatternError("an open ( in the pattern")
    java = "".join(out)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # of && in classes
            re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", java).replace(r"\z", r"\Z").replace(r"\p", "p").replace(r"\P", "P"))
    except re.error as e:
        if "global flags" not in str(e) and "set" not in str(e):  # Java takes flags anywhere
            raise PatternError(str(e)) from e
    return FLAGS + java


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at the ``|`` outside of groups and classes."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        else:
            depth += (c == "(") - (c == ")")
        i += 1
    return [*out, pattern[start:]]


def _class_end(pattern: str, at: int) -> int:
    i = at + 1 + (pattern[at + 1 : at + 2] == "^")
    i += pattern[i : i + 1] == "]"
    depth = 1
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        else:
            depth += (pattern[i] == "[") - (pattern[i] == "]")
            if not depth:
                return i
        i += 1
    return i


def _group_end(pattern: str, at: int) -> int:
    depth, i = 0, at
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            i = _class_end(pattern, i)
        else:
            depth += (pattern[i] == "(") - (pattern[i] == ")")
            if not depth:
                return i
        i += 1
    return i


def literals(pattern: str) -> list[str]:
    """Texts of at least two characters of which every match holds one; empty where none can be told.

    A cheap search for them comes before the pattern. Patterns with flags have none.
    """
    if re.search(r"\(\?[a-zA-Z-]*[ix]|\\[^bBdDwWsSAz\W_]", pattern):
        return []
    out: list[str] = []
    for part in _alternatives(pattern):
        found: list[list[str]] = [[]]
        run, i = "", 0
        while i <= len(part):
            c = part[i : i + 1]
            plain = c and (c.isalnum() or c in "_-/ ,:;=@#%&<>~'\"!")
            if c == "\\" and i + 1 < len(part) and not part[i + 1].isalnum():
                c, plain, i = part[i + 1], True, i + 1
            more = re.match(r"([*+?]|\{\d+(,\d*)?\})*", part[i + 1 :]).group()
            if plain and more in ("", "+", "+?"):
                run += c
                if more:
                    found.append([run])
                    run = ""
                i += 1
                continue
            found.append([run])
            run = ""
            if c == "\\":
                i += 1
            elif c == "[":
                i = _class_end(part, i)
            elif c == "{":
                i = part.find("}", i)
            elif c == "(":
                end = _group_end(part, i)
                inside = part[i + 1 : end].removeprefix("?:")
                if part[end + 1 : end + 2] not in ("?", "*", "{") and not inside.startswith("?") and (inner := literals(inside)):
                    found.append(inner)
                i = end
            i += 1
        best = max(found, key=lambda x: min(map(len, x), default=0))
        if min(map(len, best), default=0) < 2:
            return []
        out += best
    return sorted(set(out))
