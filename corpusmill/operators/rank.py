"""Reordering and cutting ranked hits, per question."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.errors import UsageError
from corpusmill.operators.search import ranked


def cap_per_source(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits of each source in rank order; no cap at 0 or less. Ranks close up, nothing moves in.

    A null source is a source of its own.
    """
    if most <= 0:
        return hits
    place = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("pos"))
    kept = hits.withColumn("_place", place).where(F.col("_place") <= most).drop("_place").withColumnRenamed("pos", "_pos")
    return ranked(kept, ["query_id"], [F.asc("_pos")]).drop("_pos")


def token_budget(hits: DataFrame, tokens: Column, budget: int) -> DataFrame:
    """Hits while the running sum of tokens fits; the first is always kept, the first overflow ends the list."""
    run = F.sum(tokens).over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used_tokens", run).where((F.col("used_tokens") <= budget) | (F.col("pos") == 1))


def by_recency(hits: DataFrame, time: Column, now: str = "", half_life_days: float = 90.0, k: int = 0) -> DataFrame:
    """Hits by score * 2^(-age / half life), equal ones in their order; the score itself stays.

    Undated and future hits keep their weight. A half life of 0 or less changes no order. ``k``
    of 0 or less keeps all. Without ``now`` it is the time at which the query runs.
    """
    age = (F.unix_micros(F.to_timestamp(F.lit(now)) if now else F.current_timestamp()) - F.unix_micros(time.cast("timestamp"))) / (86_400 * 1e6)
    factor = F.when(age.isNotNull() & (age > 0), F.pow(F.lit(2.0), -age / half_life_days)).otherwise(1.0) if half_life_days > 0 else F.lit(1.0)
    order = [F.desc("_adjusted"), F.asc("_pos")] if half_life_days > 0 else [F.asc("_pos")]
    aged = hits.withColumn("_adjusted", F.col("score") * factor).withColumnRenamed("pos", "_pos")
    return ranked(aged, ["query_id"], order, k if k > 0 else None).drop("_adjusted", "_pos")


def _diverse(weight: float, k: int):  # noqa: ANN202
    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        score = np.nan_to_num(table.column("score").to_numpy(zero_copy_only=False).astype(float), nan=0.0)
        vectors = [np.asarray(v, float) if v is not None else np.zeros(0) for v in table.column("vector").to_pylist()]
        n = len(vectors)
        like, lengths = np.zeros((n, n)), np.array([len(v) for v in vectors])
        for d in np.unique(lengths):
            same = np.flatnonzero(lengths == d)
            m = np.array([vectors[i] for i in same]).reshape(len(same), d)
            norm = np.sqrt((m * m).sum(axis=1))
            size = norm[:, None] * norm[None, :]
            like[np.ix_(same, same)] = np.divide(m @ m.T, size, out=np.zeros_like(size), where=size > 0)
        np.fill_diagonal(like, 0.0)
        nearest, left, chosen = np.zeros(n), np.ones(n, bool), []
        while left.any() and (k <= 0 or len(chosen) < k):
            value = np.where(left, np.round(weight * score - (1 - weight) * nearest, 12), -np.inf)
            i = int(value.argmax())  # of equal ones, to twelve digits, the smaller id
            chosen.append(i)
            left[i] = False
            nearest = np.maximum(nearest, like[i])
        out = table.take(pa.array(chosen, pa.int64())).drop_columns(["vector", "pos"])
        return out.append_column("pos", pa.array(np.arange(1, len(chosen) + 1), pa.int32()))

    return pick


def mmr(hits: DataFrame, vectors: DataFrame, k: int, weight: float = 0.5, pool: int = 50) -> DataFrame:
    """Maximal marginal relevance: greedily score * weight less (1 - weight) times the likeness to what is chosen.

    Likeness starts at 0, so an opposite vector earns nothing; a hit without a vector is like
    nothing; ties go to the smaller id; a null score counts 0. The pool is the first
    ``max(k, pool)`` hits of a question, so a group is that small. ``k`` of 0 or less orders the
    whole pool.
    """
    near = hits.where(F.col("pos") <= max(k, pool)).join(vectors.select("chunk_id", "vector"), "chunk_id", "left")
    cols = [c for c in hits.columns if c != "pos"]
    schema = ", ".join(f"`{c}` {hits.schema[c].dataType.simpleString()}" for c in cols)
    return near.select(*cols, "vector", "pos").groupBy("query_id").applyInArrow(_diverse(weight, k), f"{schema}, pos int")


def rerank(hits: DataFrame, scorer: Callable[[str, list[str]], list[tuple[int, float]]], top_n: int = 0) -> DataFrame:
    """Hits by the scorer's scores, in ``rerank_score``; the retrieval score stays.

    ``hits`` has query (the question's text) and text; a task scores whole questions, whose
    pools are small. Positions that the scorer leaves out drop out, one it invents raises;
    equal scores keep the scorer's order; ``top_n`` of 0 or less keeps all.
    """
    cols = [c for c in hits.columns if c not in ("pos", "rerank_score")]
    schema = ", ".join(f"`{c}` {hits.schema[c].dataType.simpleString()}" for c in cols)

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        found = scorer(table.column("query")[0].as_py(), table.column("text").to_pylist())
        if any(not 0 <= i < table.num_rows for i, _ in found):
            raise UsageError("the reranker returned a position that it was not given")
        order = sorted(range(len(found)), key=lambda j: -found[j][1])[: top_n if top_n > 0 else None]
        out = table.select(cols).take(pa.array([found[j][0] for j in order], pa.int64()))
        out = out.append_column("rerank_score", pa.array([float(found[j][1]) for j in order], pa.float64()))
        return out.append_column("pos", pa.array(range(1, len(order) + 1), pa.int32()))

    return hits.groupBy("query_id").applyInArrow(score, f"{schema}, rerank_score double, pos int")


def score_distribution(hits: DataFrame) -> DataFrame:
    """Per question the number, least, greatest and mean score; rerank scores where the first hit has one."""
    first = F.max(F.when(F.col("pos") == 1, F.col("rerank_score").isNotNull().cast("int"))).over(Window.partitionBy("query_id"))
    used = hits.withColumn("_s", F.when(first == 1, F.coalesce("rerank_score", F.lit(0.0))).otherwise(F.col("score")))
    return used.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("_s").alias("least"), F.max("_s").alias("greatest"), F.avg("_s").alias("mean"))


def explain(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits with the score of the runner-up, null where there is none; ``hits`` hold ``k + 1`` a question."""
    runner = F.max(F.when(F.col("pos") == k + 1, F.col("score"))).over(Window.partitionBy("query_id"))
    return hits.withColumn("runner_up", runner).where(F.col("pos") <= k)
