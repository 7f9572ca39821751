"""Metadata filters: ``key op value`` clauses, all of which must hold, as one Column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.errors import UsageError
from corpusmill.functions.dates import parse_time
from corpusmill.functions.globs import glob_to_regex

_CLAUSE = re.compile(r"^(.*?)(!=|<=|>=|<|>|=|~)(.*)$", re.S)
# What counts as a number: decimal or hexadecimal notation without type suffixes.
_NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(inf|infinity)$|^nan$"


@dataclass(frozen=True)
class Condition:
    key: str
    op: str
    value: str


def parse(clauses: list[str]) -> list[Condition]:
    """One condition per clause; the first operator of a clause, two characters before one, splits it."""
    out = []
    for clause in clauses:
        m = _CLAUSE.match(clause)
        key, op, value = (m[1].strip(), m[2], m[3].strip()) if m else ("", "", "")
        if not key or not value:
            raise UsageError(f"malformed filter {clause!r}: want key, operator (= != < <= > >= ~) and value")
        out.append(Condition(key, op, value))
    return out


def _number(text: str) -> float | None:
    try:
        return float(text) if re.match(_NUMBER, text) and abs(float(text)) != float("inf") or re.match(r"(?i)^[+-]?inf", text) else None
    except ValueError:
        return None


def _instant(text: str) -> datetime | None:
    if not re.match(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}((\.\d+)?(Z|[+-]\d{2}:\d{2}))?)?$", text):
        return None
    try:
        found = datetime.fromisoformat(text)
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def _order(value: Column, literal: str) -> Column:
    """-1, 0 or 1: compared as numbers if both are, else as instants, else byte by byte."""
    sign = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    out = sign(value, F.lit(literal))
    if (at := _instant(literal)) is not None:
        found = parse_time(value)
        out = F.when(found.isNotNull(), sign(found, F.lit(at.isoformat()).cast("timestamp"))).otherwise(out)
    if (number := _number(literal)) is not None:
        trimmed = F.trim(value)
        found = F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))
        # What overflows is no number, and not-a-number compares equal to every number.
        usable = found.isNotNull() & ((F.abs(found) != float("inf")) | trimmed.rlike(r"(?i)inf|nan"))
        same = F.isnan(found) | F.lit(number != number)
        out = F.when(usable, F.when(same, 0).otherwise(sign(found, F.lit(number)))).otherwise(out)
    return out


def _like(value: Column, pattern: str) -> Column:
    """The whole value or any element between commas, letter case ignored; a malformed pattern matches nothing."""
    try:
        regex = glob_to_regex(pattern.lower()).replace("$", "\\z")
    except UsageError:
        return F.lit(False)
    return F.lower(value).rlike(regex) | F.exists(F.split(F.lower(value), ","), lambda x: F.trim(x).rlike(regex))


def predicate(clauses: list[str], metadata: Column) -> Column:
    """Whether the metadata satisfies all clauses. A missing key fails every operator, ``!=`` too; null metadata has no keys."""
    out = F.lit(True)
    for c in parse(clauses):
        value = F.try_element_at(metadata, F.lit(c.key))
        if c.op == "~":
            holds = _like(value, c.value)
        else:
            order = _order(value, c.value)
            holds = {"=": order == 0, "!=": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[c.op]
        out = out & value.isNotNull() & F.coalesce(holds, F.lit(False))
    return out
