"""Comparing, counting and identifying collections of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpusmill.errors import NotFound, UsageError


def document_id(collection: Column, source_uri: Column) -> Column:
    return F.sha2(F.concat(collection, F.lit("\0"), source_uri), 256)


def chunk_id(doc: Column, seq: Column) -> Column:
    return F.concat(doc, F.lit(":"), seq.cast("string"))


def corpus_digest(documents: DataFrame) -> DataFrame:
    """Per collection the digest over (uri, hash) in uri order, and the last ingest time.

    The value is defined as one hash over the whole list in order. A collection's names and
    hashes (no texts) are sorted by Spark, which spills, and stream through a running hash: a
    task holds one batch, however large the collection. Rows without a name or hash count for
    the ingest time only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, last, begun = None, hashlib.sha256(), None, False

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([state.hexdigest()]), pa.array([last], pa.timestamp("us", "UTC"))], names=["collection", "digest", "last_ingest"])

        for batch in batches:
            for c, uri, digest, at in zip(*(batch.column(x).to_pylist() for x in ("collection", "source_uri", "hash", "ingested_at")), strict=True):
                if begun and c != name:
                    yield told()
                    state, last = hashlib.sha256(), None
                name, begun = c, True
                if uri is not None and digest is not None:
                    state.update(f"{uri}\0{digest}\0".encode())
                last = at if last is None or at is not None and at > last else last
        if begun:
            yield told()

    rows = documents.select("collection", "source_uri", "hash", F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    ordered = rows.repartition("collection").sortWithinPartitions("collection", "source_uri", "hash")
    return ordered.mapInArrow(run, "collection string, digest string, last_ingest timestamp").withColumn("last_ingest", F.col("last_ingest").cast(documents.schema["ingested_at"].dataType))


NAME = ("source_uri",)


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = NAME) -> DataFrame:
    """(keys, status): added, removed or changed between two sets of documents; equal ones are left out."""
    a = old.select(*keys, F.col("hash").alias("_old"), F.lit(1).alias("_a"))
    b = new.select(*keys, F.col("hash").alias("_new"), F.lit(1).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, list(keys), "full").select(*keys, status.alias("status")).where("status is not null")


def prunable(stored: DataFrame, present: DataFrame) -> DataFrame:
    """Stored documents whose name is no longer present."""
    return stored.join(present.select("source_uri").distinct(), "source_uri", "left_anti")


def outcomes(walked: DataFrame, stored: DataFrame, keys: tuple[str, ...] = NAME) -> DataFrame:
    """(keys, outcome) of a walk against the store: new, unchanged by fingerprint, unchanged by content, or changed.

    A fingerprint spares reading the file; where it moved, the content's hash decides.
    """
    s = stored.select(*keys, F.col("fingerprint").alias("_f"), F.col("hash").alias("_h"), F.lit(1).alias("_s"))
    same_file = (F.col("fingerprint") != "") & (F.col("fingerprint") == F.col("_f"))
    kind = F.when(F.col("_s").isNull(), "new").when(same_file, "unchanged").when(F.col("hash") == F.col("_h"), "refreshed").otherwise("changed")
    return walked.join(s, list(keys), "left").select(*keys, kind.alias("outcome"))


def status(collections: DataFrame, documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per collection: documents, chunks (as there are vectors) and the last ingest time; empty ones too."""
    docs = documents.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.max("ingested_at").alias("last_ingest"))
    parts = vectors.groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"))
    named = collections.select(F.col("name").alias("collection"))
    return named.join(docs, "collection", "left").join(parts, "collection", "left").na.fill(0, ["documents", "chunks"])


def selected(documents: DataFrame, wanted: str, regex: str | None) -> DataFrame:
    """Documents by the strongest reading of a selector that matches any: exact name, base name, pattern, part of the name."""
    from corpusmill.functions.uris import basename

    name = basename(F.col("source_uri"))
    tier = F.when(F.col("source_uri") == wanted, 1).when(name == wanted, 2)
    if regex:
        tier = tier.when(name.rlike(regex), 3)
    tier = tier.when(F.contains(F.lower("source_uri"), F.lower(F.lit(wanted))), 4)
    rated = documents.withColumn("_tier", tier).where("_tier is not null")
    best = rated.agg(F.min("_tier").alias("_best"))
    return rated.join(F.broadcast(best), F.col("_tier") == F.col("_best")).drop("_tier", "_best")  # one row


def select_one(documents: DataFrame, wanted: str, regex: str | None) -> Row:
    """The one document that a selector means; none raises NotFound, several a UsageError that names some of them."""
    found = selected(documents, wanted, regex).orderBy("source_uri").limit(6).collect()
    if not found:
        raise NotFound(f"no document matches {wanted!r}")
    if len(found) > 1:
        raise UsageError(f"{wanted!r} means several documents: " + ", ".join(r.source_uri for r in found[:5]) + (" and more" if len(found) > 5 else ""))
    return found[0]
