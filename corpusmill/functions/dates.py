"""Times in metadata and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metadata keys that tell when a document was modified or created, in order.
MODIFIED_KEYS = ("updated", "updated_at", "modified", "last_modified", "lastmod")
CREATED_KEYS = ("created", "created_at", "date", "published", "publishdate", "publish_date")
MTIME_KEY = "mtime"

# Forms of dates in metadata and in names.
_FULL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_LOCAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_PATH_DAY = r"(\d{4})[-_/](\d{2})[-_/](\d{2})"
_PATH_WEEK = r"(\d{4})-[Ww](\d{2})"


def _midnight(day: Column) -> Column:
    """The begin of a day in UTC, whatever the session's time zone."""
    return F.try_to_timestamp(F.concat(day.cast("string"), F.lit("T00:00:00+00:00")))


def parse_time(text: Column) -> Column:
    """RFC 3339, ``YYYY-MM-DDTHH:MM:SS`` or ``YYYY-MM-DD`` (both UTC) as a timestamp; anything else, and no such day, is null."""
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    full = F.when(text.rlike(_FULL), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"), "Z$", "+00:00")))
    return F.coalesce(full, F.when(text.rlike(_LOCAL), F.try_to_timestamp(F.concat(text, F.lit("+00:00")))), F.when(text.rlike(_DAY), _midnight(text)))


def path_time(uri: Column) -> Column:
    """The date in a name: the last ``YYYY-MM-DD`` (also with ``_`` or ``/``), else Monday of the last ``YYYY-Www``."""
    day = F.try_element_at(F.regexp_extract_all(uri, F.lit(_PATH_DAY), F.lit(0)), F.lit(-1))
    day = _midnight(F.regexp_replace(day, "[_/]", "-"))
    week = F.try_element_at(F.regexp_extract_all(uri, F.lit(_PATH_WEEK), F.lit(0)), F.lit(-1))
    year, number = F.substring(week, 1, 4).cast("int"), F.substring(week, 7, 2).cast("int")
    monday = _midnight(F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (number - 1) * 7))
    return F.coalesce(day, F.when(number.between(1, 53) & (year >= 1), monday))


def _by_key(metadata: Column, keys: tuple[str, ...]) -> list[Column]:
    """The parsed value per key, letter case ignored; of keys that differ in case only, the smallest counts."""
    same = lambda key: F.array_sort(F.filter(F.map_keys(metadata), lambda k: F.lower(k) == key))
    return [parse_time(F.try_element_at(metadata, F.try_element_at(same(key), F.lit(1)))) for key in keys]


def document_time(source: Column, metadata: Column, ingested_at: Column) -> Column:
    """When a document was last true: modified keys, mtime, date in its name, created keys, ingest time."""
    mtime = parse_time(F.try_element_at(metadata, F.lit(MTIME_KEY)))
    return F.coalesce(*_by_key(metadata, MODIFIED_KEYS), mtime, path_time(source), *_by_key(metadata, CREATED_KEYS), ingested_at)
