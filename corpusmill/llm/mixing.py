"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. Per source the counts alone decide how
many documents of each length come in: a proportional part of each length first, its fractions
rounded by one seeded draw along the lengths, so that the mix is a sample and neither long nor
short documents are preferred; then bounded knapsack dynamic programming, over lengths in seeded
order, for what remains of the budget. Only then are documents drawn, in seeded order within
their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokens import VOCABULARY, token_counts
from corpusmill.tables import keep, read

SEED = 11
RESERVE = 8  # documents of mean length whose tokens the proportional part leaves to the knapsack
RUN = 10_000  # documents of one length that are ranked together


def source_key(col: Column) -> Column:
    """One spelling per source: lower case, words joined by single hyphens; blank is null."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(col), r"(?U)[\s_-]+", "-"), "^-|-$", "")
    return F.when(joined != "", joined)


def budgets(weights: dict[str, float], most: dict[str, int], total: int) -> dict[str, int]:
    """Tokens per source: in proportion to the weights, except where a source has no more to give.

    What such a source lacks is shared by the others by weight. All used up gives less than
    ``total``.
    """
    out = {s: 0 for s in weights}
    open_ = {s: w for s, w in weights.items() if w > 0 and most.get(s, 0) > 0}
    left = total
    while open_:
        rate = left / sum(open_.values())
        short = [s for s, w in open_.items() if most[s] <= rate * w]
        if not short:
            return out | {s: int(rate * w) for s, w in open_.items()}
        for s in short:
            out[s] = most[s]
            left -= most[s]
            del open_[s]
    return out


def subset_sum(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length reach the greatest total up to ``budget``; sums are the bits of an integer.

    Lengths are taken up in the given order and only until the budget can be met exactly.
    """
    mask = (1 << (budget + 1)) - 1
    items, reach, sums = [], [1], 1
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        many = 1
        count = min(count, budget // length) if length else 0
        while count > 0:
            take = min(many, count)
            sums = (sums | sums << take * length) & mask
            items.append((i, take))
            reach.append(sums)
            count -= take
            many *= 2
        if sums >> budget & 1:
            break
    at, chosen = sums.bit_length() - 1, [0] * len(lengths)
    for k in range(len(items) - 1, -1, -1):
        i, take = items[k]
        if not reach[k] >> at & 1:
            chosen[i] += take
            at -= take * lengths[i]
    return chosen


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each length to take, none more than there are, for a total up to ``budget`` and near it.

    One seeded offset rounds the running sum of the expected counts along the lengths: each
    count is its expectation rounded up or down, and so is that of every range of lengths, which
    keeps the mean length. The knapsack then fills what is left, at most the reserve and the
    longest document beside it, with one document after another in seeded order.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    rng = np.random.default_rng(seed)
    rate = max(0.0, budget - reserve * total / counts.sum()) / total
    steps = np.floor(np.cumsum(counts * rate) + rng.random()).astype(np.int64)
    taken = np.minimum(np.diff(steps, prepend=0), counts)
    left = int(budget) - int((lengths * taken).sum())
    while left < 0:  # rounding took more than the reserve: one document that is long enough goes
        held = np.flatnonzero(taken)
        enough = held[lengths[held] >= -left]
        gone = enough[0] if len(enough) else held[-1]
        taken[gone] -= 1
        left += int(lengths[gone])
    free = np.flatnonzero((lengths <= left) & (counts > taken))
    if left > 0 and len(free):
        free = free[np.argsort(rng.random(len(free)) ** (1.0 / (counts - taken)[free]))[::-1]]  # as documents drawn one by one would bring them up
        extra = np.array(subset_sum(lengths[free].tolist(), (counts - taken)[free].tolist(), left))
        taken[free] += extra
    return taken


def _fit(seed: int):  # noqa: ANN202
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens", ignore_index=True)
        own = xxhash.xxh32_intdigest(pdf["source"].iloc[0], seed & 0xFFFFFFFF)
        take = fit_counts(pdf.n_tokens.to_numpy(), pdf.n.to_numpy(), int(pdf["rest"].iloc[0]), own)
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf.n_tokens, "n": pdf.n, "whole": pdf["whole"], "take": take})

    return fit


def mix(lengths: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with how often each is used, shares per source).

    ``lengths``: (doc_id, source, n_tokens), doc_id unique; ``targets``: (source, target_weight,
    max_repeats). Sources are matched by :func:`source_key`. ``total`` defaults to the tokens
    that the named sources hold. A source is used whole as often as its budget holds it, and one
    part more; never beyond max_repeats (null: 1). Documents without a source or token, or of a
    source that is not named, are not used; a named source that is missing reaches share 0.
    Of lengths, the driver sees one sum per named source; of one source, a task sees one row
    per distinct length.
    """
    spark = lengths.sparkSession
    wanted = targets.where("target_weight > 0").groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_weight").alias("w"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("r")).where("source is not null").collect()
    weights, repeats = {t.source: t.w for t in wanted}, {t.source: t.r for t in wanted}
    schema = "source string, target_weight double, max_repeats int, budget long, whole int, rest long"
    keyed = lengths.select("doc_id", source_key(F.col("source")).alias("source"), "n_tokens").where((F.col("n_tokens") > 0) & F.col("source").isin(sorted(weights)))
    counts = keep(keyed.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    held = {r.source: r.t for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect()}
    plan = budgets(weights, {s: held[s] * repeats[s] for s in held}, sum(held.values()) if total is None else total)
    norm = sum(weights.values()) or 1.0
    rows = [(s, w / norm, repeats[s], plan[s], plan[s] // held[s] if s in held else 0, plan[s] % held[s] if s in held else 0) for s, w in sorted(weights.items())]
    planned = spark.createDataFrame(rows, schema)
    fitted = counts.join(planned, "source").select("source", "n_tokens", "n", "whole", "rest").groupBy("source").applyInPandas(_fit(seed), "source string, n_tokens long, n long, whole int, take long")
    fitted = keep(fitted, "length-takes")
    # Documents of one length in seeded order; many of them are ranked in runs of the hash's range.
    order = F.xxhash64(F.lit(seed), "doc_id")
    placed = keyed.join(fitted, ["source", "n_tokens"]).withColumn("_h", order).withColumn("_runs", F.ceil(F.col("n") / RUN))
    placed = placed.withColumn("_run", F.least(F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_runs")), F.col("_runs") - 1))
    group = ["source", "n_tokens"]
    sizes = placed.groupBy(*group, "_run").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_before", F.sum("_c").over(Window.partitionBy(*group).orderBy("_run")) - F.col("_c")).drop("_c")
    ranked = placed.join(before, [*group, "_run"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_run").orderBy("_h", "doc_id")))
    used = ranked.withColumn("times", (F.col("whole") + F.when(F.col("_rank") <= F.col("take"), 1).otherwise(0)).cast("int"))
    used = used.where("times > 0").select("doc_id", "source", "n_tokens", "times")
    reached = fitted.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("held_tokens"), F.sum("n").alias("held_docs"), F.sum(F.col("n_tokens") * (F.col("n") * F.col("whole") + F.col("take"))).alias("mixed_tokens"), F.max(F.col("whole") + F.when(F.col("take") > 0, 1).otherwise(0)).alias("most_uses"))
    full = planned.join(reached, "source", "left").na.fill(0, ["held_tokens", "held_docs", "mixed_tokens", "most_uses"])
    everything = full.withColumn("_all", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(True))))  # one row per target
    share = F.when(F.col("_all") > 0, F.col("mixed_tokens") / F.col("_all")).otherwise(0.0)
    shares = everything.select("source", "target_weight", "max_repeats", "held_docs", "held_tokens", F.col("budget").alias("budget_tokens"), "mixed_tokens", "most_uses", F.round(share, 6).alias("share"))
    return used, shares


def _mixed(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents")
    targets = read(spark, sf_dir, "mix_targets")
    lengths = keep(token_counts(docs, carry=("source",), path=path), "lengths")
    return mix(lengths, targets)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target what its source holds: documents with any token, and how often each may be used."""
    return _mixed(spark, sf_dir)[1].select("source", F.round("target_weight", 6).alias("target_weight"), "max_repeats", "held_docs")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]
