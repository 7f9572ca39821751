"""Hits and answers as Markdown, a row a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.uris import basename


def _score(score: Column, rerank: Column) -> Column:
    one = F.concat(F.lit("`"), F.format_string("%.4f", score), F.lit("`"))
    both = F.concat(F.lit("sim="), one, F.lit(" rerank=`"), F.format_string("%.4f", rerank), F.lit("`"))
    return F.when(rerank.isNotNull(), both).otherwise(one)


def hits_markdown(hits: DataFrame) -> DataFrame:
    """(query_id, markdown): the hits of a question in rank order with place, file, score and text; rules between them.

    ``hits``: (query_id, pos, source, seq, score, rerank_score, text) and more. Where a hit has a
    rerank score both are shown. Null texts are empty, a null score is 0.
    """
    label = F.concat(basename(F.coalesce("source", F.lit(""))), F.lit("#"), F.coalesce(F.col("seq").cast("string"), F.lit("?")))
    line = F.concat(F.lit("**["), F.col("pos").cast("string"), F.lit("]**  "), label, F.lit("  ·  "), _score(F.coalesce("score", F.lit(0.0)), F.col("rerank_score")))
    each = F.struct("pos", F.concat(line, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("md"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["md"]), "\n---\n\n")
    return hits.groupBy("query_id").agg(F.regexp_replace(body, r"\n+\z", "").alias("markdown"))


def sources_markdown(answers: DataFrame) -> DataFrame:
    """(answer_id, markdown): answers (answer_id, text, labels array<string>) with their numbered sources below, if there are any."""
    items = F.transform("labels", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n")))
    full = F.concat("text", F.lit("\n\n## Sources\n\n"), F.array_join(items, ""))
    return answers.select("answer_id", F.when(F.size("labels") > 0, full).otherwise(F.col("text")).alias("markdown"))
