"""Patterns in ECMAScript's dialect, for Java and Python.

There \\b, \\w and \\d are ASCII, \\s also covers the Unicode spaces, and $
without the m flag is the end of input only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce
from itertools import takewhile
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the dialect; fixed values.
SPACES = "\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


_WORD_NEXT = re.compile(r"(?:[A-Za-z0-9]|\\[dw])(?![?*]|\{[0,])")
_WORD_BEFORE = re.compile(r"(?:(?<!\\)[A-Za-z0-9]|\\[dw])\Z")


def _edge(before: str, behind: str) -> str:
    """\\b, by one side only where the other is a letter or digit for sure."""
    if _WORD_NEXT.match(behind):
        return "(?<![A-Za-z0-9_])"
    return "(?![A-Za-z0-9_])" if _WORD_BEFORE.search(before) else _EDGE


def translate(pattern: str, end: str, many_lines: bool = False) -> str:
    """Explicit classes and edges for \\s, \\b and $; end: how the target writes the end of input."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\s":
            out.append(SPACES if inside else f"[{SPACES}]")
            i += 2
        elif two == "\\S":
            out.append(f"[^{SPACES}]")
            i += 2
        elif two == "\\b" and not inside:
            out.append(_edge(pattern[:i], pattern[i + 2 :]))
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            c = pattern[i]
            inside = (inside or c == "[") and not (inside and c == "]")
            out.append(end if c == "$" and not inside and not many_lines else c)
            i += 1
    return "".join(out)


def js(pattern: str, flags: str = "") -> str:
    """For Java. Flags: i (ASCII letters, and others where the pattern has some), m."""
    folds = ("i" if pattern.isascii() else "iu") if "i" in flags else ""
    mode = folds + ("m" if "m" in flags else "")
    return (f"(?{mode})" if mode else "") + translate(pattern, "\\z", "m" in flags)


def py(pattern: str, flags: str = "") -> re.Pattern:
    """For Python; letters beyond ASCII fold where the pattern has some."""
    mode = re.ASCII if pattern.isascii() else re.UNICODE
    mode |= (re.IGNORECASE if "i" in flags else 0) | (re.MULTILINE if "m" in flags else 0)
    text = translate(pattern, "\\Z", "m" in flags)
    if not pattern.isascii():
        text = text.replace("\\d", "[0-9]").replace("\\w", "[A-Za-z0-9_]")
    return re.compile(text, mode)


def like(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(js(pattern, flags))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, as the variable of a transform() over an array of one."""
    # transform() would hand the place to a function's second parameter, a default one too
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def _lead(parts) -> str:
    """The fixed beginning of a parsed pattern, lower case."""
    letters = takewhile(lambda x: x[0] is parser.LITERAL and x[1] < 128, parts)
    return "".join(chr(c).lower() for _, c in letters)


def _needles(parts) -> tuple[str, ...]:
    """Of a parsed pattern: the longest strings, lower case, one of which is in every match; none if there is no such."""
    best, run = (), ""
    for op, arg in [*parts, (parser.AT, None)]:
        if op is parser.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        found = [(run,) if run else ()]
        if op is parser.BRANCH and all(x and x[0][0] is parser.LITERAL for x in arg[1]):
            # the parser puts common beginnings in front
            found.append(tuple(sorted({run + _lead(x) for x in arg[1]})))
        run = ""
        if op is parser.SUBPATTERN:
            found.append(_needles(arg[3]))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] > 0:
            found.append(_needles(arg[2]))
        elif op is parser.BRANCH:
            each = [_needles(x) for x in arg[1]]
            found.append(tuple(sorted({n for x in each for n in x})) if all(each) else ())
        best = max([best, *found], key=lambda x: min(map(len, x), default=0))
    return best


@cache
def needles(pattern: str) -> tuple[str, ...]:
    """Strings one of which is in lower case in every match of a pattern; none if there is no such."""
    return _needles(parser.parse(pattern))


def may_match(low: Column, *patterns: str) -> Column:
    """Whether a text, given in lower case, has what one of the patterns needs: a search for fixed strings, far cheaper than a pattern."""
    each = [needles(p) for p in patterns]
    if not all(each):
        return F.lit(True)
    return reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in sorted({n for x in each for n in x})])


def any_of(text: Column, low: Column, patterns: tuple[str, ...], flags: str = "i") -> Column:
    """Whether any pattern matches a text, of which low is the lower case; a pattern is tried only where what it needs is there."""
    return reduce(Column.__or__, [may_match(low, p) & text.rlike(js(p, flags)) for p in patterns])


def any_like(text: Column, patterns: tuple[str, ...], flags: str = "i") -> Column:
    """any_of() of a text that is computed once."""
    return bind(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda s: any_of(s["t"], s["low"], patterns, flags))


def first_group(text: Column, pattern: str, flags: str = "", group: int = 1) -> Column:
    """A group of the first match; null without a match, or where the group is empty."""
    return F.nullif(F.regexp_extract(text, js(pattern, flags), group), F.lit(""))


def replace(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(text, js(pattern, flags), by)
