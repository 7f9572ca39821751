"""Token counts with a public byte-level BPE vocabulary; its path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-split of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ship(spark: SparkSession, path: str) -> str:
    """Send the vocabulary at ``path`` to all executors; they need no copy of their own."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding by the file that was shipped, else by that at ``path``."""
    shipped = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker or SparkContext._active_spark_context else path
    with open(shipped if os.path.exists(shipped) else path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """(key, carried columns, n_tokens) of every row; a null text has 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    ship(df.sparkSession, path)
    kept = df.select(key, *carry, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    return kept.mapInArrow(count, f"{schema}, n_tokens bigint")
