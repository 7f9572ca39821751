"""Capping records per dominant contributor.

Nested caps (a source inside a folder inside a workspace) form a laminar matroid: greedily
keeping the best records inside the innermost group, then the next, keeps the best set there is.
Each level is one ranking over what the level before kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.uris import file_name, parent
from corpusmill.tables import keep, read

SALTS = 32


@dataclass(frozen=True)
class Cap:
    """At most ``count`` records, and at most ``share`` of the group of ``within``, per ``by``."""

    by: tuple[str, ...]
    count: int | None = None
    share: float | None = None
    within: tuple[str, ...] = ()


def _same(columns: list[str], other: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{other}{i}")) for i, c in enumerate(columns)]


def _renamed(columns: list[str], other: str) -> list[Column]:
    return [F.col(c).alias(f"{other}{i}") for i, c in enumerate(columns)]


def _best_by_count(df: DataFrame, by: list[str], order: list[Column], limit: int, salts: int) -> DataFrame:
    """``df`` with ``__cap_over``: whether a record still alive is beyond the first ``limit`` of its group.

    A group is first ranked in parts: a record beyond the limit within its part is beyond it in
    the whole. Only the best of each part meet in the second ranking, salts * limit records of a
    group however large it is.
    """
    keys, alive = [F.col(c) for c in by], F.col("dropped_by").isNull()
    local = Window.partitionBy(*keys, "__cap_part", alive).orderBy(*order)
    out = df.withColumn("__cap_place", F.when(alive, F.row_number().over(local)))
    near = F.col("__cap_place") <= limit
    whole = Window.partitionBy(*keys, F.when(near, -1).otherwise(F.col("__cap_part"))).orderBy(*order)
    out = out.withColumn("__cap_place", F.when(near, F.row_number().over(whole)).otherwise(F.col("__cap_place")))
    return out.withColumn("__cap_over", alive & (F.col("__cap_place") > limit)).drop("__cap_place")


def _all_places(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with the place of every row in its group, in ``__cap_place``, whatever the group's size.

    Rows are put in ranges of (group, order), so a large group lies in many; a row's place is the
    number of its group's rows in earlier ranges and its place in its own.
    """
    keys = [F.col(c) for c in by]
    ranged = keep(df.repartitionByRange(*keys, *order).withColumn("__cap_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*keys, "__cap_range").agg(F.count(F.lit(1)).alias("__cap_in"))
    before = F.sum("__cap_in").over(Window.partitionBy(*keys).orderBy("__cap_range")) - F.col("__cap_in")
    sizes = sizes.withColumn("__cap_before", before).select(*_renamed(by, "__cap_g"), F.col("__cap_range").alias("__cap_r"), "__cap_before")
    own = F.row_number().over(Window.partitionBy(*keys, "__cap_range").orderBy(*order))
    placed = ranged.withColumn("__cap_place", own).join(sizes, [*_same(by, "__cap_g"), F.col("__cap_range") == F.col("__cap_r")])
    return placed.withColumn("__cap_place", F.col("__cap_place") + F.col("__cap_before")).drop("__cap_range", "__cap_r", "__cap_before", *(f"__cap_g{i}" for i in range(len(by))))


def nested_caps(df: DataFrame, caps: list[Cap], order: list[Column], spread: Column, salts: int = SALTS) -> DataFrame:
    """``df`` with ``dropped_by``: null for a kept record, else the number (from 0) of the cap that drops it.

    ``caps`` go from the innermost group outwards. ``order`` says which records stay (best
    first) and should decide all ties; ``spread`` is a stable value that spreads one group's
    records. With a count alone groups are ranked in ``salts`` parts first; with a share, which
    grows with the group, in ranges of the order. Either way no task sees a whole large group.
    With a share the cap is floor(share * records of ``within``, dropped ones included) and at
    least 1. Null group values are a group of their own; an empty table gives an empty result.
    """
    out = df.withColumn("dropped_by", F.lit(None).cast("int")).withColumn("__cap_part", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    for number, cap in enumerate(caps):
        by, within = list(cap.by), list(cap.within)
        if cap.share is None:
            out = _best_by_count(out, by, order, cap.count if cap.count is not None else 2**31 - 1, salts)
        else:
            out = keep(out, "capped")
            sizes = out.groupBy(*within).agg(F.count(F.lit(1)).alias("__cap_n")) if within else out.agg(F.count(F.lit(1)).alias("__cap_n"))
            # Met part by part, so that a large group's rows are not joined in one task.
            sizes = sizes.select(*_renamed(within, "__cap_w"), "__cap_n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__cap_p"))
            placed = _all_places(out.where("dropped_by is null"), by, order)
            placed = placed.join(sizes, [*_same(within, "__cap_w"), F.col("__cap_part") == F.col("__cap_p")]).drop("__cap_p", *(f"__cap_w{i}" for i in range(len(within))))
            share = F.greatest(F.floor(F.col("__cap_n") * cap.share).cast("int"), F.lit(1))
            over = F.col("__cap_place") > (share if cap.count is None else F.least(F.lit(cap.count), share))
            placed = placed.withColumn("__cap_over", over).drop("__cap_place", "__cap_n")
            out = placed.unionByName(out.where("dropped_by is not null").withColumn("__cap_over", F.lit(False)))
        out = out.withColumn("dropped_by", F.when(F.col("__cap_over"), number).otherwise(F.col("dropped_by"))).drop("__cap_over")
    return out.drop("__cap_part")


def best_first(score: str, tie: str) -> list[Column]:
    """Higher score first, null and NaN below every number, equal ones by smaller ``tie``."""
    number = F.when(F.isnan(score), None).otherwise(F.col(score))
    return [number.desc_nulls_last(), F.col(tie).asc_nulls_last()]


def sourced_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, one row per query and chunk (the latest logged), with the file each comes from.

    Without a source it is the file of the chunk's document; if that is unknown too, the
    document stands for its file.
    """
    hits = read(spark, sf_dir, "hits").select("query_id", "chunk_id", F.struct("logged_at", "score", "source", "document_id").alias("r"))
    hits = hits.groupBy("query_id", "chunk_id").agg(F.max("r").alias("r")).select("query_id", "chunk_id", "r.score", "r.logged_at", F.col("r.source").alias("raw"))
    named = hits.withColumn("name", file_name(F.col("raw"))).withColumn("doc", F.when(F.col("name").isNull(), F.substring_index("chunk_id", ":", 1)))
    docs = read(spark, sf_dir, "source_docs").select("id", "source_uri").unionByName(read(spark, sf_dir, "shared_docs").select("id", "source_uri"))
    files = docs.groupBy(F.col("id").alias("doc")).agg(file_name(F.min("source_uri")).alias("file"))
    lacking = named.where("name is null").select("doc").distinct()
    files = files.join(lacking, "doc", "left_semi")
    full = named.where("name is null").join(files, "doc", "left").withColumn("name", F.coalesce("file", F.concat(F.lit("document:"), "doc"), F.lit("unknown")))
    return named.where("name is not null").select("query_id", "chunk_id", "score", "name").unionByName(full.select("query_id", "chunk_id", "score", "name"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = nested_caps(sourced_hits(spark, sf_dir), [Cap(("query_id", "name"), 3)], best_first("score", "chunk_id"), F.col("chunk_id"))
    return capped.where("dropped_by is not null").select("query_id", "chunk_id")


def p1_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per list: at most 3 hits a file, 5 a folder, and 40 % of the list from one workspace."""
    hits = sourced_hits(spark, sf_dir).withColumn("folder", parent(F.col("name"))).withColumn("workspace", parent(F.col("folder")))
    caps = [Cap(("query_id", "name"), 3), Cap(("query_id", "folder"), 5), Cap(("query_id", "workspace"), share=0.4, within=("query_id",))]
    return nested_caps(hits, caps, best_first("score", "chunk_id"), F.col("chunk_id")).select("query_id", "chunk_id", F.col("name").alias("source_file"), "dropped_by")


def p1_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: hits in all lists, and how many the cap of 3 per list takes away."""
    capped = nested_caps(sourced_hits(spark, sf_dir), [Cap(("query_id", "name"), 3)], best_first("score", "chunk_id"), F.col("chunk_id"))
    return capped.groupBy(F.col("name").alias("source_file")).agg(F.count(F.lit(1)).alias("hits"), F.count("dropped_by").alias("dropped"))
