"""Reading the given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, one machine) is a temporary folder chosen,
    once, and set for the session.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage, lets several later plans share one computation, and survives the loss
    of any executor. The table stays as long as results may read it: see :func:`clear`.
    """
    path = stored(df, label)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> str:
    """Write ``df`` once to the shared folder; its path, for tasks that read it by :func:`rows_at`."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written; how many.

    For when the results made so far have been written or collected: what is lazy still may
    read them.
    """
    for path in _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    n = len(_written)
    _written.clear()
    return n


def rows_at(path: str) -> pa.Table:
    """A table in the shared folder, read inside a task; for small ones only, such as a trained model."""
    local = re.match(r"^(?:file:/*)?(?=/)|^file:/+", path)
    if local:
        return pq.read_table("/" + path[local.end() :].lstrip("/"))
    place, name = fs.FileSystem.from_uri(path)
    return pq.read_table(name, filesystem=place)
