"""Question sets and hits in JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.errors import UsageError

CASE = "question string, expected_sources array<string>, expected_chunks array<string>, expected_answer string"
HIT = "chunk_id string, seq int, text string, heading_path string, score double, source string, collection string, ingested_at timestamp"
VERSION = 1
MOST_BYTES = 8 << 20  # of a line


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_no, question, expectations) from JSON lines; a first line ``{"version": n}`` is a header.

    Blank lines are skipped. A newer version, an empty question, a line that is no case or has
    more than MOST_BYTES, and an empty set raise.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("case_no"), F.trim("value").alias("value")).where("value != ''")
    if not lines.where(F.octet_length("value") > MOST_BYTES).isEmpty():
        raise UsageError(f"a line of the question set has more than {MOST_BYTES} bytes")
    first = lines.orderBy("case_no").first()
    if first is None:
        raise UsageError("the question set is empty")
    head = json.loads(first.value)
    if "version" in head and "question" not in head:
        if head["version"] > VERSION:
            raise UsageError(f"the question set has version {head['version']}; at most {VERSION} is known")
        lines = lines.where(F.col("case_no") != first.case_no)
    cases = lines.select("case_no", F.from_json("value", CASE, {"mode": "PERMISSIVE"}).alias("c")).select("case_no", "c.*")
    bad = cases.where(F.coalesce(F.trim("question"), F.lit("")) == "").count()
    if bad or cases.isEmpty():
        raise UsageError(f"{bad} cases have no question" if bad else "the question set is empty")
    return cases


def expected_items(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk expectations, source expectations): expected chunks win over expected sources."""
    chunks = cases.where(F.size("expected_chunks") > 0).select(F.col("case_no").alias("query_id"), F.explode("expected_chunks").alias("chunk_id"))
    sources = cases.where((F.coalesce(F.size("expected_chunks"), F.lit(0)) <= 0) & (F.size("expected_sources") > 0))
    return chunks, sources.select(F.col("case_no").alias("query_id"), F.explode("expected_sources").alias("source"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """The ranked hits of one answer from a JSON array or JSON lines, several files by name; what an answer needs, in file order."""
    rows = spark.read.schema(HIT).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(True)).orderBy("_file", "_row"))).drop("_file", "_row")


def hits_json(hits: DataFrame) -> DataFrame:
    """(query_id, json): the hits of a question as one JSON array in rank order; null fields are left out."""
    each = F.struct("pos", F.struct(*(c for c in hits.columns if c not in ("query_id", "pos"))).alias("hit"))
    rows = F.transform(F.array_sort(F.collect_list(each)), lambda x: x["hit"])
    return hits.groupBy("query_id").agg(F.to_json(rows).alias("json"))
