"""Files that arrive in a folder, ingested as they come.

Delivery is at least once; ingest is idempotent by content hash, so a batch that is delivered
again changes nothing. A file stream does not see deletions: prune with ``Store.sync``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusmill.plans.ports import Embedder
from corpusmill.sources.files import content_type_of, fingerprint
from corpusmill.store import Store

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files in the shape that ingest takes."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(folder)
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    mark = F.pandas_udf(lambda data: data.map(fingerprint), T.StringType())
    return raw.select(uri.alias("source_uri"), "path", content_type_of(F.col("path")).alias("content_type"), F.col("length").alias("size"), F.date_trunc("second", "modificationTime").alias("mtime"), "content", mark("content").alias("fingerprint"))


def ingest_stream(spark: SparkSession, folder: str, store: Store, name: str, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """Ingests what is there and stops; run again, it takes up where it stopped."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.ingest(name, batch.dropDuplicates(["source_uri"]), embedder)

    return arriving(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
