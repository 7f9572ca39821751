"""Ranking and faithfulness metrics over whole question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.errors import GateError, UsageError

METRICS = ("recall", "precision", "mrr", "ndcg", "hit_rate")


def per_question(hits: DataFrame, expected: DataFrame, k: int, item: str) -> DataFrame:
    """Recall, precision, MRR, nDCG and hit rate at ``k`` of every question with an expectation.

    ``hits``: (query_id, ``item``, pos); an item counts at its first place and the rest move up.
    ``expected``: (query_id, ``item``), repeats once. Precision is by what was returned within k;
    MRR looks at the whole list. A question that returned nothing scores 0 throughout.
    """
    wanted = expected.where(F.col(item).isNotNull()).select("query_id", item).distinct()
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    first = hits.join(size, "query_id", "left_semi").groupBy("query_id", item).agg(F.min("pos").alias("_p"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("_p", item))
    found = first.withColumn("rank", order).join(wanted.withColumn("is_relevant", F.lit(1)), ["query_id", item], "left")
    rel, near = F.coalesce("is_relevant", F.lit(0)), F.col("rank") <= k
    sums = found.groupBy("query_id").agg(
        F.sum(F.when(near, rel)).alias("found"),
        F.count(F.when(near, 1)).alias("returned"),
        F.min(F.when(rel == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(near & (rel == 1), 1 / F.log2(F.col("rank") + 1.0))).alias("gain"),
    )
    full = size.join(sums, "query_id", "left").na.fill(0, ["found", "returned"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(max(k, 1)), F.col("relevant").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    return full.select(
        "query_id",
        (F.col("found") / F.col("relevant")).alias("recall"),
        F.when(F.col("returned") > 0, F.col("found") / F.col("returned")).otherwise(0.0).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg"),
        (F.col("found") > 0).cast("double").alias("hit_rate"),
    )


def means(metrics: DataFrame) -> DataFrame:
    """One row: the number of questions and the mean of each metric."""
    return metrics.agg(F.count(F.lit(1)).alias("questions"), *(F.avg(m).alias(m) for m in METRICS))


def support_rate(claims: DataFrame) -> DataFrame:
    """Per answer: claims, supported ones, their rate (1 without claims) and whether all are; ``claims``: (answer_id, verdict or null row)."""
    yes = F.count_if(F.col("verdict") == "supported")
    n = F.count("verdict")
    return claims.groupBy("answer_id").agg(n.alias("claims"), yes.alias("supported"), F.when(n > 0, yes / n).otherwise(1.0).alias("rate"), (yes == n).alias("all_supported"))


def gate(report: DataFrame, least: dict[str, float]) -> None:
    """Raises GateError naming, sorted, what is below its least value; UsageError for a metric the report lacks."""
    row = report.first().asDict()
    if unknown := sorted(m for m in least if row.get(m) is None):
        raise UsageError(f"not measured: {', '.join(unknown)}")
    if low := sorted(m for m, v in least.items() if row[m] < v):
        raise GateError("below the threshold: " + ", ".join(f"{m} {row[m]:.4f} < {least[m]}" for m in low))
