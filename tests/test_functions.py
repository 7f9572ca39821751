from __future__ import annotations

import base64
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.errors import UsageError
from corpusmill.functions.dates import document_time, parse_time
from corpusmill.functions.globs import excluded, glob, glob_to_regex, source_matches
from corpusmill.functions.predicates import parse, predicate
from corpusmill.functions.text import fixed_windows, terms, words
from corpusmill.functions.uris import canonical_name, digest, file_name, parent

NAME = "file:///srv/kb/a b.md"
HEX = hashlib.sha256(b"x").hexdigest()


@pytest.mark.parametrize(
    ("written", "name"),
    [
        (NAME, NAME),
        (" FILE:///srv/kb/a%20b.md\t", NAME),
        ("file://localhost/srv//kb/./x/../a b.md?raw=1", NAME),
        ("file:/srv/%6bb/a b.md#L3", NAME),
        ("/srv/kb/a b.md", NAME),
        ("file:///srv/kb/A b.md", "file:///srv/kb/A b.md"),
        (f"file:///x/u{chr(0x308)}.md", f"file:///x/{chr(0xFC)}.md"),
        ("file:///x/%C3%BC.md", f"file:///x/{chr(0xFC)}.md"),
        ("file:///x/a.md?raw=1", "file:///x/a.md"),
        ("stdin", "stdin"),
        ("", None),
        (" \n", None),
        (None, None),
        ("file:///", None),
    ],
)
def test_names(spark, written, name):
    assert canonical_name(written) == name
    assert spark.createDataFrame([(written,)], "s string").select(file_name(F.col("s"))).first()[0] == name


def test_digests(spark):
    coded = "sha256-" + base64.b64encode(bytes.fromhex(HEX)).decode()
    rows = [HEX, HEX.upper(), "sha256:" + HEX, "SHA256=" + HEX.upper(), f" {HEX}\n", coded, "sha256-" + HEX]
    assert {r[0] for r in spark.createDataFrame([(x,) for x in rows], "h string").select(digest(F.col("h"))).collect()} == {HEX}
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), (" other ",)], "h string").select(digest(F.col("h"))).collect()] == [None, None, "other"]


def test_parent(spark):
    got = spark.createDataFrame([("file:///a/b/c.md",), ("stdin",), (None,)], "s string").select(parent(F.col("s"))).collect()
    assert [r[0] for r in got] == ["file:///a/b", "stdin", None]


META = {"author": "alice", "size": "1500", "date": "2025-06-01", "tags": "security,compliance", "title": "Q3 Incident Report"}


@pytest.mark.parametrize(
    ("clause", "holds"),
    [
        ("author=alice", True), ("author!=bob", True), ("size=1500.0", True), ("size>1000", True), ("size<=1500", True), ("size<1500", False),
        ("date<=2025-06-01", True), ("date<2025-01-01", False), ("date>=2025-05-31T23:59:59Z", True), ("tags~compliance", True), ("tags~privacy", False),
        ("title~*report*", True), ("missing=x", False), ("missing!=x", False), ("missing~*", False), ("author>1", True), ("tags~[", False),
    ],
)
def test_predicates(spark, clause, holds):
    df = spark.createDataFrame([(META,)], "m map<string,string>")
    assert df.select(predicate([clause], F.col("m"))).first()[0] is holds
    assert spark.createDataFrame([(None,)], "m map<string,string>").select(predicate([clause], F.col("m"))).first()[0] is False


def test_numbers_that_are_none(spark):
    df = spark.createDataFrame([({"n": x},) for x in ("1d", "1e999", "nan", " 12 ", "0x1")], "m map<string,string>")
    assert [r[0] for r in df.select(predicate(["n>=5"], F.col("m"))).collect()] == [False, False, True, True, False]


@pytest.mark.parametrize("clause", ["", "  ", "author", "=alice", "author=", "author!", "  = "])
def test_malformed_clauses(clause):
    with pytest.raises(UsageError):
        parse([clause])


@pytest.mark.parametrize(
    ("pattern", "value", "holds"),
    [("*.md", "a.md", True), ("*.md", "x/a.md", False), ("?.md", "a.md", True), ("[a-c].md", "b.md", True), ("[^a-c].md", "b.md", False), (r"\*.md", "*.md", True), (r"\*.md", "a.md", False), ("a.md", "aXmd", False), ("[]a]", "]", None), ("[a", "a", None), ("a\\", "a", None)],
)
def test_globs(spark, pattern, value, holds):
    if holds is None:
        with pytest.raises(UsageError):
            glob_to_regex(pattern)
    else:
        assert spark.createDataFrame([(value,)], "s string").select(glob(F.col("s"), pattern)).first()[0] is holds


def test_source_patterns(spark):
    df = spark.createDataFrame([("file:///a/b.md",)], "s string")
    got = df.select(source_matches(F.col("s"), "b*"), source_matches(F.col("s"), "/a/*.md"), source_matches(F.col("s"), "a*"), excluded(F.col("s"), ["file:///a/*"]), excluded(F.col("s"), ["*.txt"])).first()
    assert list(got) == [True, True, False, True, False]


TIMES = [
    ("file:///logs/2024-01-01.md", {"updated": "2026-06-01", "created": "2020-01-01", "mtime": "2025-01-01"}, "2023-01-01", "2026-06-01 00:00:00"),
    ("file:///logs/2024-03-03.md", {"mtime": "2026-06-10T08:00:00Z", "created": "2020-01-01"}, None, "2026-06-10 08:00:00"),
    ("file:///Work-Log/daily/2026-06-09.md", {"created": "2020-01-01"}, None, "2026-06-09 00:00:00"),
    ("file:///Work-Log/weekly/2026-W20.md", {}, None, "2026-05-11 00:00:00"),
    ("", {"Date": "2025-03-04"}, None, "2025-03-04 00:00:00"),
    ("file:///notes/architecture.md", None, "2024-01-01", "2024-01-01 00:00:00"),
    ("file:///notes/architecture.md", {}, None, None),
    ("file:///logs/2026-06-09.md", {"updated": "last tuesday"}, None, "2026-06-09 00:00:00"),
    ("file:///a/2026-W20/2026-13-40.md", {}, None, "2026-05-11 00:00:00"),
]


def test_times(spark):
    rows = [(s, m, dt.datetime.fromisoformat(i) if i else None) for s, m, i, _ in TIMES]
    df = spark.createDataFrame(rows, "s string, m map<string,string>, i timestamp")
    got = [str(r[0]) if r[0] else None for r in df.select(document_time(F.col("s"), F.col("m"), F.col("i"))).collect()]
    assert got == [t for *_, t in TIMES]
    odd = spark.createDataFrame([("2025",), ("2025-1-2",), ("2025-02-30",), (" 2025-02-03 ",), ("2025-02-03T01:02:03.5+02:00",)], "t string")
    assert [str(r[0]) for r in odd.select(parse_time(F.col("t"))).collect()] == ["None", "None", "None", "2025-02-03 00:00:00", "2025-02-02 23:02:03.500000"]


def test_words(spark):
    df = spark.createDataFrame([(f"Alpha,beta{chr(0xA0)}9_x",), ("",), (None,)], "t string")
    assert [list(r[0]) for r in df.select(terms(F.col("t"))).collect()] == [["alpha", "beta", "9", "x"], [], []]
    assert [len(r[0]) for r in df.select(words(F.col("t"))).collect()] == [2, 0, 0]
    cut = spark.createDataFrame([("a b c d e f g",), ("a b",), (" ",)], "t string").select(fixed_windows(F.col("t"), 3, 1))
    assert [list(r[0]) for r in cut.collect()] == [["a b c", "c d e", "e f g"], ["a b"], []]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_dates_mean_utc_in_any_session(spark, zone):
    from corpusmill.functions.dates import parse_time, path_time

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([("2025-06-01", "/a/2025-06-01.md"), ("2025-06-01T00:00:00", "/w/2025-W22"), ("2025-06-01T02:00:00+02:00", "/x"), ("2025-02-30", "/2025-02-30")], "t string, p string")
        got = rows.select(F.unix_seconds(parse_time(F.col("t"))).alias("t"), F.unix_seconds(path_time(F.col("p"))).alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.t for r in got] == [1748736000] * 3 + [None] and [r.p for r in got] == [1748736000, 1748217600, None, None]
