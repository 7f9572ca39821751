"""Words and terms of texts, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-case runs of letters and numbers, in order, repeats kept; null has none."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Runs of what is not Unicode white space."""
    found = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, each ``size - overlap`` on, up to the first that reaches the end."""
    step = size - overlap
    found = words(text)
    last = F.greatest(F.lit(0), F.ceil((F.size(found) - size) / F.lit(step)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(found, i * step + 1, F.lit(size)), " "))
    return F.when(F.size(found) > 0, cut).otherwise(F.array().cast("array<string>"))
