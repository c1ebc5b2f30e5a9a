"""Glob patterns as regular expressions: ``*`` and ``?`` stop at slashes, ``**`` doesn't, ``[!a-z]`` and ``{a,b}`` work, a backslash escapes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Regular expression, the same for the JVM and for Python, that matches a whole path as ``pattern`` does."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if pattern[i : i + 1] == "*":
                i += 1
                out.append(r"[\s\S]*")
            else:
                out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                raise ValueError(f"nothing to escape at the end of {pattern}")
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 1)
            if end < 0:
                raise ValueError(f"no ] in {pattern}")
            inner = pattern[i:end]
            negated = inner.startswith("!")
            body = (inner[1:] if negated else inner).replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&")
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
            i = end + 1
        elif c == "{":
            if depth:
                raise ValueError(f"groups can't be nested in {pattern}")
            depth = 1
            out.append("(?:")
        elif c == "}" and depth:
            depth = 0
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
    if depth:
        raise ValueError(f"no }} in {pattern}")
    return "^(?:" + "".join(out) + ")$"


def any_glob(patterns: Iterable[str]) -> str:
    return "|".join(glob_regex(p) for p in patterns)


def matches(path: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern matches; false without patterns."""
    patterns = list(patterns)
    return path.rlike(any_glob(patterns)) if patterns else F.lit(False)
