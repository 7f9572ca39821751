"""Shell patterns as Java regular expressions.

``*`` and ``?`` do not match ``/``; classes are ``[a-z]`` and ``[^a-z]``; a backslash takes the
next character as it is; a pattern matches the whole value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.errors import UsageError
from corpusmill.functions.uris import basename


def glob_to_regex(pattern: str) -> str:
    """Raises UsageError for a malformed pattern."""
    out, i = ["(?s)^"], 0

    def literal(at: int) -> tuple[str, int]:
        if pattern[at] == "\\":
            at += 1
        if at >= len(pattern):
            raise UsageError(f"malformed pattern {pattern!r}")
        return pattern[at], at + 1

    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            i += 1
            negated = pattern[i : i + 1] == "^"
            i += negated
            parts = []
            while pattern[i : i + 1] != "]" or not parts:
                if i >= len(pattern) or pattern[i] in "]-":
                    raise UsageError(f"malformed pattern {pattern!r}")
                low, i = literal(i)
                high = low
                if pattern[i : i + 1] == "-":
                    if i + 1 >= len(pattern) or pattern[i + 1] in "]-":
                        raise UsageError(f"malformed pattern {pattern!r}")
                    high, i = literal(i + 1)
                if low <= high:
                    parts.append(f"{_quoted(low)}-{_quoted(high)}")
                else:
                    parts.append("&&[^\\x{0}-\\x{10FFFF}]")  # matches nothing
            i += 1
            out.append(("[^" if negated else "[") + "".join(parts) + "]")
        else:
            c, i = literal(i)
            out.append(_quoted(c))
    return "".join(out) + "$"


def _quoted(c: str) -> str:
    return c if c.isalnum() or c in " _/" else f"\\x{{{ord(c):X}}}"


def is_glob(pattern: str) -> bool:
    return bool(re.search(r"[*?\[]", pattern))


def glob(col: Column, pattern: str) -> Column:
    return col.rlike(glob_to_regex(pattern).replace("$", "\\z"))


def source_matches(uri: Column, pattern: str) -> Column:
    """Whether a source matches: its base name, or with a ``/`` in the pattern its path without scheme."""
    value = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://", "") if "/" in pattern else basename(uri)
    return F.coalesce(glob(value, pattern), F.lit(False))


def excluded(uri: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches the base name or the full URI; malformed ones raise before any job."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(glob(basename(uri), p) | glob(uri, p), F.lit(False))
    return out
