"""Files under a root as a table: name, type, fingerprint, content. The root may lie on any file system that pyarrow reads."""

from __future__ import annotations

import hashlib
import mimetypes
import os
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.errors import InvariantError, NotFound, UsageError
from corpusmill.functions.globs import excluded
from corpusmill.tables import keep

MOST_BYTES = 256 << 20
HEAD = 8192
# Content types by extension.
TYPES = {
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".txt": "text/plain",
    ".text": "text/plain",
    ".csv": "text/csv",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
FILES = "source_uri string, path string, content_type string, size long, mtime timestamp"


def content_type(path: str) -> str:
    ext = os.path.splitext(path)[1].lower()
    return TYPES.get(ext) or mimetypes.types_map.get(ext, "application/octet-stream")


def content_type_of(path: Column) -> Column:
    """:func:`content_type` as a column: the extensions of this engine and those the system knows."""
    known = {e: t for e, t in {**mimetypes.types_map, **TYPES}.items()}
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))
    table = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def fingerprint(data: bytes) -> str:
    """The size and a digest of size, first and last bytes; up to twice HEAD all bytes count."""
    parts = data if len(data) <= 2 * HEAD else data[:HEAD] + data[-HEAD:]
    return f"{len(data)}:{hashlib.sha256(len(data).to_bytes(8, 'little') + parts).hexdigest()}"


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what comes before it in a URI."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://", path) and not path.startswith("file://"):
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[: -len(inner)] if inner and path.endswith(inner) else ""
    return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", path)), ""


def _hidden(path: str) -> bool:
    return posixpath.basename(path).startswith(".")


def _entries(system: fs.FileSystem, place: str) -> tuple[list[tuple], list[str]]:
    """(path, size, mtime) of the visible files of a folder, and its visible folders."""
    found = sorted((e for e in system.get_file_info(fs.FileSelector(place)) if not _hidden(e.path)), key=lambda e: e.path)
    files = [(e.path, e.size, e.mtime and e.mtime.replace(microsecond=0)) for e in found if e.type == fs.FileType.File]
    return files, [e.path for e in found if e.type == fs.FileType.Directory]


_LISTED = "path string, size long, mtime timestamp"


def walk(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """Regular, visible files under ``root`` (hidden folders left out, names with ``_`` kept), without their content.

    The driver lists the root itself only; every folder below is walked by a task, and what is
    found is written once. A file of more than MOST_BYTES raises. Contents are read by
    :func:`read_contents`.
    """
    system, place, before = _system(root)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise NotFound(f"no such file or folder: {root}")
    files, folders = ([(place, info.size, info.mtime and info.mtime.replace(microsecond=0))], []) if info.type == fs.FileType.File else _entries(system, place)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _system(root)[0]
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                waiting = [folder]
                while waiting:
                    found, more = _entries(own, waiting.pop())
                    waiting += more
                    columns = list(zip(*found, strict=True)) if found else [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.timestamp("us", "UTC"))], names=["path", "size", "mtime"])

    rows = spark.createDataFrame(files, _LISTED)
    if folders:
        rows = rows.unionByName(spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 1000), "folder").mapInArrow(below, _LISTED))
    full = F.concat(F.lit(before), "path")
    df = rows.select((full if before else F.concat(F.lit("file://"), "path")).alias("source_uri"), full.alias("path"), content_type_of(F.col("path")).alias("content_type"), "size", "mtime")
    df = keep(df, "files")
    if large := df.where(F.col("size") > MOST_BYTES).select("path", "size").first():
        raise InvariantError(f"{large.path} has {large.size} bytes; at most {MOST_BYTES} are read")
    return df.where(~excluded(F.col("source_uri"), list(exclude))) if exclude else df


def read_contents(files: DataFrame, per_task: int = 64) -> DataFrame:
    """``files`` with their bytes and fingerprint, read by the tasks, about ``per_task`` files each."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                system, inner, _ = _system(path)
                with system.open_input_stream(inner) as f:
                    data = f.read()
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary()), pa.array([fingerprint(data)])], names=[*one.schema.names, "content", "fingerprint"])

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("fingerprint", T.StringType())])
    tasks = max(1, min(4096, files.count() // per_task))
    return files.repartition(tasks, "path").mapInArrow(load, schema)


def in_memory(spark: SparkSession, content: bytes, name: str = "stdin", kind: str = "text/markdown") -> DataFrame:
    """One document that is no file; it has no fingerprint."""
    if not name:
        raise UsageError("a document needs a name")
    return spark.createDataFrame([(name, None, kind, len(content), None, bytearray(content), "")], f"{FILES}, content binary, fingerprint string")


ATTACHMENT_BYTES = 64 << 20


def attachment(path: str) -> tuple[str, str, bytes]:
    """(name, content type, bytes) of a file that goes to a model as it is and is never stored."""
    if os.path.getsize(path) > ATTACHMENT_BYTES:
        raise InvariantError(f"{path} is larger than {ATTACHMENT_BYTES} bytes")
    with open(path, "rb") as f:
        return os.path.basename(path), content_type(path), f.read()
