"""From a file of questions to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import evaluate
from corpusmill.plans.ports import Embedder, Scorer
from corpusmill.plans.resolve import RetrieveOptions, resolve
from corpusmill.sources.evalset import expected_items, read_cases
from corpusmill.store import Store
from corpusmill.tables import keep


def judged(hits: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """(query_id, metrics) of hits (query_id, pos, chunk_id, source) against the cases' expected chunks, else sources.

    A case that expects nothing is left out.
    """
    by_chunk, by_source = (e.withColumn("query_id", F.col("query_id").cast("string")) for e in expected_items(cases))
    return evaluate.per_question(hits, by_chunk, k, "chunk_id").unionByName(evaluate.per_question(hits, by_source, k, "source"))


def evaluate_file(store: Store, path: str, options: RetrieveOptions, embedder: Embedder, scorer: Scorer | None = None, least: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics per case, their means) of a question set, all questions retrieved together.

    With ``least`` a mean below its value raises, after the report is written to the shared
    folder.
    """
    cases = keep(read_cases(store.spark, path), "cases")
    asked = cases.select(F.col("case_no").alias("query_id"), F.col("question").alias("text"))
    hits = keep(resolve(store, asked, options, embedder, scorer).select("query_id", "pos", "chunk_id", "source"), "eval-hits")
    each = keep(judged(hits, cases, options.k).join(cases.select(F.col("case_no").cast("string").alias("query_id"), "question"), "query_id"), "eval-cases")
    report = evaluate.means(each)
    if least:
        evaluate.gate(report, least)
    return each, report
