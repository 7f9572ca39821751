"""What changed between consecutive full snapshots of a keyed table.

The cleaned deliveries are written once, partitioned by run and bucketed by key. The state is an
index from key to the last known digest, bucketed alike. A delivery probes the index bucket by
bucket: neither side is shuffled, of the deliveries only the run's own partition is read, and of
the indexes only what was delivered again. A step writes one table that is both its list of
changes and the next index of the scopes it holds: swapping indexes is going on from the newer
table. Old rows are fetched for keys found changed only, from the run before
(:meth:`Snapshots.with_old_values`).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.uris import digest, file_name
from corpusmill.tables import keep, read, shared_path

ROWS_PER_BUCKET = 1_000_000


def latest(df: DataFrame, keys: list[str], when: str, rest: list[str]) -> DataFrame:
    """One row per key: the one with the latest ``when``; null ``when`` is oldest, ties go to the greatest rest.

    A partial aggregate runs before the shuffle, so a key repeated in a third of all rows costs
    one row per task.
    """
    order = F.struct(when, *rest)
    return df.groupBy(*keys).agg(F.max(order).alias("_last")).select(*keys, F.col(f"_last.{when}"), *(F.col(f"_last.{c}") for c in rest))


def _step(new: DataFrame, index: DataFrame | None, keys: list[str]) -> DataFrame:
    """One row per key of either side: what became of it, the digest now known and the one known before."""
    null = F.lit(None).cast("string")
    if index is None:
        return new.select(*keys, F.col("hash").alias("known"), null.alias("before"), F.lit("added").alias("kind"), F.lit(True).alias("present"))
    old = index.where("present").select(*keys, F.col("known").alias("_known"), F.lit(True).alias("_old"))
    both = new.withColumn("_new", F.lit(True)).join(old, keys, "full_outer")
    came, was = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    changed = came & was & (F.col("hash") != F.col("_known"))
    kind = F.when(came & ~was, "added").when(~came, "removed").when(changed, "changed")
    return both.select(*keys, F.coalesce("hash", "_known").alias("known"), F.col("_known").alias("before"), kind.alias("kind"), came.alias("present"))


class Snapshots:
    """Deliveries of full snapshots, their indexes and what changed.

    ``clean`` holds one row per (snapshot_no, scope, key) with ``hash`` and any other columns;
    ``runs`` lists, in order, each snapshot number and the scopes it delivered completely. A
    scope's first delivery yields nothing. A null hash is a present row of unknown content: no
    change, and the last known digest since the row was added stays for comparison. A key that
    is removed and comes back is added anew, its earlier digest forgotten. An empty ``runs``
    gives an empty result. Only the run list, as long as there are runs, passes through the
    driver. Used as a context: bucketed tables need names in the catalog, which go at its end
    (``changes`` are read by path and stay valid).
    """

    def __init__(self, clean: DataFrame, runs: list[tuple[int, list[str]]], scope: str = "collection", key: str = "source_uri", buckets: int | None = None):
        self.spark, self.runs, self.scope, self.keys = clean.sparkSession, runs, scope, [scope, key]
        self._names: list[str] = []
        if buckets is None:
            clean = keep(clean, "snapshots")
            buckets = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")), clean.count() // max(1, len(runs)) // ROWS_PER_BUCKET)
        self.buckets, self._schema = buckets, clean.schema
        self._clean = self._bucketed(clean.repartition(buckets, *self.keys), "snapshot_rows", "snapshot_no")[0]

    def __enter__(self) -> Snapshots:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _bucketed(self, df: DataFrame, label: str, *by: str) -> tuple[DataFrame, str]:
        name = f"{label}_{uuid.uuid4().hex}"
        path = shared_path(self.spark, name)
        writer = df.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).format("parquet")
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)
        self._names.append(name)
        return self.spark.table(name), path

    def run(self, number: int, scopes: list[str]) -> DataFrame:
        return self._clean.where((F.col("snapshot_no") == number) & F.col(self.scope).isin(scopes))

    def step(self, number: int, scopes: list[str], index: DataFrame | None) -> DataFrame:
        """What became of ``scopes`` in a run, against the index that holds them (None: their first run)."""
        if index is not None:
            index = index.where(F.col(self.scope).isin(scopes))
        return _step(self.run(number, scopes).select(*self.keys, "hash"), index, self.keys)

    def changes(self) -> DataFrame:
        """(snapshot_no, scope, key, change_kind, hash, old_hash) of each run against the last one of its scope."""
        held: dict[str, DataFrame] = {}  # per scope the index of its last run
        kind = {f.name: f.dataType.simpleString() for f in self._schema}
        columns = f"{self.keys[0]} {kind[self.keys[0]]}, {self.keys[1]} {kind[self.keys[1]]}"
        found = [self.spark.createDataFrame([], f"snapshot_no int, {columns}, change_kind string, hash string, old_hash string")]
        for number, delivered in self.runs:
            indexes = {id(held.get(s)): held.get(s) for s in delivered}
            parts = [self.step(number, [s for s in delivered if held.get(s) is index], index) for index in indexes.values()]
            if not parts:
                continue
            table, path = self._bucketed(reduce(DataFrame.unionByName, parts), "snapshot_index")
            if judged := [s for s in delivered if s in held]:
                rows = self.spark.read.schema(table.schema).parquet(path).where(F.col("kind").isNotNull() & F.col(self.scope).isin(judged))
                found.append(rows.select(F.lit(number).cast("int").alias("snapshot_no"), *self.keys, F.col("kind").alias("change_kind"), F.when(F.col("present"), F.col("known")).alias("hash"), F.col("before").alias("old_hash")))
            held |= dict.fromkeys(delivered, table)
        return reduce(DataFrame.unionByName, found)

    def with_old_values(self, changes: DataFrame, columns: list[str]) -> DataFrame:
        """Changed and removed rows with the values they had in the run before, fetched by bucket for those keys only."""
        last: dict[str, int] = {}
        empty = changes.select("*", *(F.lit(None).cast(self._schema[c].dataType).alias(f"old_{c}") for c in columns)).where("false")
        found = [empty]
        wanted = changes.where("change_kind != 'added'")
        for number, delivered in self.runs:
            for before in sorted({last[s] for s in delivered if s in last}):
                scopes = [s for s in delivered if last.get(s) == before]
                old = self.run(before, scopes).select(*self.keys, *(F.col(c).alias(f"old_{c}") for c in columns))
                these = wanted.where((F.col("snapshot_no") == number) & F.col(self.scope).isin(scopes))
                found.append(these.join(old, self.keys, "left"))
            last |= dict.fromkeys(delivered, number)
        return keep(reduce(DataFrame.unionByName, found), "old-values")


def clean_snapshots(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per run, collection and file, with the file's canonical name and digest.

    Rows that name no file and rows of runs that did not complete are left out; of several rows
    of one file in a run the latest loaded counts.
    """
    complete = read(spark, sf_dir, "snapshot_runs").where("status = 'complete'").select("snapshot_no", "collection").distinct()
    rows = read(spark, sf_dir, "doc_snapshots").join(complete, ["snapshot_no", "collection"], "left_semi")
    named = rows.select("snapshot_no", "collection", file_name(F.col("source_uri")).alias("source_uri"), digest(F.col("hash")).alias("hash"), "loaded_at", *extra)
    return latest(named.where("source_uri is not null"), ["snapshot_no", "collection", "source_uri"], "loaded_at", ["hash", *extra])


def complete_runs(spark: SparkSession, sf_dir: str) -> list[tuple[int, list[str]]]:
    rows = read(spark, sf_dir, "snapshot_runs").where("status = 'complete'").groupBy("snapshot_no").agg(F.collect_set("collection").alias("c")).orderBy("snapshot_no").collect()
    return [(r.snapshot_no, sorted(r.c)) for r in rows]


def previous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("collection").orderBy("snapshot_no")
    runs = read(spark, sf_dir, "snapshot_runs").where("status = 'complete'").select("snapshot_no", "collection").distinct()
    return runs.withColumn("previous_no", F.lag("snapshot_no").over(order))


def run_pairs(clean: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the run before and of the run itself, both under the number of the run, for every run that has one before it.

    ``clean``: as of :func:`clean_snapshots`; ``previous``: (snapshot_no, collection, previous_no)
    of every complete run. An unknown hash is taken as the last known one since the file was
    added, or else as the first one to come, so that it makes no change.
    """
    number = F.row_number().over(Window.partitionBy("collection").orderBy("snapshot_no"))
    numbered = clean.join(previous.withColumn("_n", number), ["snapshot_no", "collection"])
    file = Window.partitionBy("collection", "source_uri").orderBy("snapshot_no")
    since = Window.partitionBy("collection", "source_uri", "_stay").orderBy("snapshot_no")
    last = F.last("hash", True).over(since.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("hash", True).over(since.rowsBetween(0, Window.unboundedFollowing))
    known = numbered.withColumn("_stay", F.col("_n") - F.row_number().over(file)).withColumn("hash", F.coalesce(last, first)).drop("_n", "_stay")
    new = known.where("previous_no is not null").drop("previous_no")
    after = previous.where("previous_no is not null").select("collection", F.col("previous_no").alias("_of"), F.col("snapshot_no").alias("_after"))
    old = known.withColumnRenamed("snapshot_no", "_of").join(after, ["collection", "_of"]).withColumnRenamed("_after", "snapshot_no").select(*new.columns)
    return old, new


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Snapshots(clean_snapshots(spark, sf_dir), complete_runs(spark, sf_dir)) as s:
        return s.changes().select("snapshot_no", "collection", "source_uri", "change_kind")


def p3_old_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed and removed files with the digest and ingest time they had in the run before."""
    with Snapshots(clean_snapshots(spark, sf_dir, ("ingested_at",)), complete_runs(spark, sf_dir)) as s:
        return s.with_old_values(s.changes(), ["ingested_at"]).select("snapshot_no", "collection", "source_uri", "change_kind", "hash", "old_hash", "old_ingested_at")
