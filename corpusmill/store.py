"""Collections on parquet: documents, chunks and vectors in versions, one writer at a time.

Every change writes a new version beside the old one and then a new pointer, the newest of which
counts; readers keep the version they opened. A pointer is never replaced, so a crash leaves the
collection as it was, and of two writers that began from one pointer the second fails. A change
reads and rewrites the collection it touches only.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.errors import InvariantError, NotFound, UsageError
from corpusmill.operators.chunking import chunk_documents
from corpusmill.operators.corpus import chunk_id, document_id, outcomes, prunable
from corpusmill.plans.ports import Embedder, embedded
from corpusmill.sources.extract import extract
from corpusmill.sources.files import read_contents, walk
from corpusmill.tables import keep

NAME = re.compile(r"[a-z0-9][a-z0-9._-]{0,63}")
SCHEMAS = {
    "documents": "id string, collection string, source_uri string, hash string, ingested_at timestamp, fingerprint string, metadata map<string,string>",
    "chunks": "id string, document_id string, collection string, seq int, text string, heading_path string",
    "vectors": "chunk_id string, collection string, vector array<float>, norm double, metadata map<string,string>",
}


@dataclass(frozen=True)
class Chunker:
    size: int = 512
    overlap: int = 64
    strategy: str = "structure"
    version: int = 1
    tokenizer: str = "words"
    context_prefix: bool = True

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise UsageError("want a size above 0 and an overlap from 0 to below the size")


@dataclass
class Collection:
    name: str
    model: str
    dimensions: int
    chunker: Chunker | None
    created_at: str
    sources: list[str] = field(default_factory=list)
    version: str = ""
    revision: int = 0


_POINTER = re.compile(r"_collection-(\d+)\.json")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Small files of the store go through Hadoop's file system, so that the root may lie anywhere.
    def _fs(self, path: str) -> tuple[JavaObject, JavaObject]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        found = [_POINTER.fullmatch(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for m in found if m)

    def _load(self, name: str) -> Collection | None:
        revisions = self._pointers(name)
        if not revisions:
            return None
        fs, p = self._fs(f"{self.root}/{name}/_collection-{revisions[-1]}.json")
        stream = fs.open(p)
        try:
            raw = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Collection(**raw | {"chunker": Chunker(**raw["chunker"]) if raw["chunker"] else None})

    def _save(self, c: Collection) -> None:
        """The next pointer, written aside and renamed; the last but one goes."""
        revision = c.revision + 1
        fs, p = self._fs(f"{self.root}/{c.name}/_new-{uuid.uuid4().hex}")
        out = fs.create(p)
        out.write(bytearray(json.dumps(asdict(c) | {"revision": revision}).encode()))
        out.close()
        _, to = self._fs(f"{self.root}/{c.name}/_collection-{revision}.json")
        if self._pointers(c.name)[-1:] > [c.revision] or not fs.rename(p, to):
            fs.delete(p, False)
            raise InvariantError(f"another writer changed {c.name!r}")
        c.revision = revision
        fs.delete(self._fs(f"{self.root}/{c.name}/_collection-{revision - 2}.json")[1], False)

    def create(self, name: str, embedder: Embedder, chunker: Chunker | None = None) -> Collection:
        if not NAME.fullmatch(name):
            raise UsageError(f"{name!r} is no collection name")
        if self._load(name):
            raise InvariantError(f"collection {name!r} exists")
        now = self.spark.sql("SELECT cast(current_timestamp() AS string)").first()[0]
        c = Collection(name, embedder.model, embedder.dimensions, chunker or Chunker(), now)
        self._save(c)
        return c

    def get(self, name: str) -> Collection:
        c = self._load(name)
        if c is None:
            raise NotFound(f"no collection {name!r}")
        return c

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if self._load(s.getPath().getName())) if fs.exists(p) else []

    def table(self, name: str, kind: str) -> DataFrame:
        c = self.get(name)
        if not c.version:
            return self.spark.createDataFrame([], SCHEMAS[kind])
        return self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.root}/{name}/{c.version}/{kind}")

    def _commit(self, c: Collection, tables: dict[str, DataFrame]) -> None:
        version = uuid.uuid4().hex
        for kind, df in tables.items():
            df.select(*(f.split()[0] for f in SCHEMAS[kind].split(", "))).write.parquet(f"{self.root}/{c.name}/{version}/{kind}")
        c.version = version
        self._save(c)

    def _without(self, name: str, gone: DataFrame) -> dict[str, DataFrame]:
        """All tables without the documents of ``gone`` (id)."""
        ids = gone.select(F.col("id").alias("_id"))
        vectors = self.table(name, "vectors")
        return {
            "documents": self.table(name, "documents").join(ids, F.col("id") == F.col("_id"), "left_anti"),
            "chunks": self.table(name, "chunks").join(ids, F.col("document_id") == F.col("_id"), "left_anti"),
            "vectors": vectors.join(ids, F.substring_index("chunk_id", ":", 1) == F.col("_id"), "left_anti"),
        }

    def check(self, c: Collection, embedder: Embedder, chunker: Chunker | None = None) -> None:
        if (c.model, c.dimensions) != (embedder.model, embedder.dimensions):
            raise InvariantError(f"{c.name!r} is pinned to {c.model} with {c.dimensions} dimensions")
        if c.chunker is None:
            raise InvariantError(f"{c.name!r} has no chunker and is read-only")
        if chunker is not None and chunker != c.chunker:
            raise InvariantError(f"{c.name!r} is pinned to another chunker")

    def ingest(self, name: str, files: DataFrame, embedder: Embedder, metadata: dict[str, str] | None = None, now: str | None = None) -> dict[str, int]:
        """Bring files (with content and fingerprint) in; how many of each outcome.

        Unchanged files are not extracted, unchanged content is not embedded. Content that only
        moved its fingerprint gets the new fingerprint and metadata. A document that became
        empty is skipped and its old chunks stay. One commit for all.
        """
        c = self.get(name)
        self.check(c, embedder)
        stored = self.table(name, "documents")
        seen = Observation()
        fresh = files.observe(seen, F.count(F.lit(1)).alias("files")).join(stored.where("fingerprint != ''").select("source_uri", "fingerprint"), ["source_uri", "fingerprint"], "left_anti")
        texts = keep(extract(fresh, metadata).withColumn("hash", F.sha2("text", 256)), "extracted")
        judged = outcomes(texts.select("source_uri", F.lit("").alias("fingerprint"), "hash"), stored)
        texts = keep(texts.join(judged, "source_uri").withColumn("outcome", F.when(F.col("error").isNotNull(), "unsupported").when(F.trim("text") == "", "skipped").otherwise(F.col("outcome"))), "judged")
        counts = {r.outcome: r.n for r in texts.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts["unchanged"] = counts.get("unchanged", 0) + seen.get["files"] - sum(counts.values())
        wanted = texts.where("outcome in ('new', 'changed', 'refreshed')")
        if wanted.isEmpty():
            return {k: v for k, v in counts.items() if v}
        stamp = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        docs = wanted.select(document_id(F.lit(name), F.col("source_uri")).alias("id"), F.lit(name).alias("collection"), "source_uri", "hash", stamp.alias("ingested_at"), "fingerprint", "metadata", "text", "content_type", "outcome")
        docs = keep(docs, "documents")
        cut = chunk_documents(docs.where("outcome != 'refreshed'"), c.chunker.size, c.chunker.overlap, key="id", prefix=c.chunker.context_prefix)
        made = cut.withColumn("document_id", F.col("id")).withColumn("id", chunk_id(F.col("document_id"), F.col("seq"))).withColumn("collection", F.lit(name))
        made = keep(made.withColumn("vector", embedded(F.col("embed_text"), embedder)), "chunks")
        meta = docs.select(F.col("id").alias("document_id"), "metadata")
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        vectors = made.join(meta, "document_id").select(F.col("id").alias("chunk_id"), "collection", "vector", length.alias("norm"), "metadata")
        old = self._without(name, docs.where("outcome != 'refreshed'"))
        same = docs.where("outcome = 'refreshed'").select(F.col("id").alias("_id"), F.col("fingerprint").alias("_f"), F.col("metadata").alias("_m"))
        kept = old["documents"].join(same, F.col("id") == F.col("_id"), "left").withColumn("fingerprint", F.coalesce("_f", "fingerprint")).withColumn("metadata", F.when(F.col("_id").isNotNull(), F.col("_m")).otherwise(F.col("metadata")))
        kept_vectors = old["vectors"].join(same, F.substring_index("chunk_id", ":", 1) == F.col("_id"), "left").withColumn("metadata", F.when(F.col("_id").isNotNull(), F.col("_m")).otherwise(F.col("metadata")))
        cols = [f.split()[0] for f in SCHEMAS["documents"].split(", ")]
        self._commit(
            c,
            {
                "documents": kept.select(*cols).unionByName(docs.where("outcome != 'refreshed'").select(*cols)),
                "chunks": old["chunks"].unionByName(made.select(*old["chunks"].columns)),
                "vectors": kept_vectors.select(*vectors.columns).unionByName(vectors),
            },
        )
        return {k: v for k, v in counts.items() if v}

    def add(self, name: str, path: str, embedder: Embedder, exclude: list[str] = (), metadata: dict[str, str] | None = None) -> dict[str, int]:
        """Ingest a file or folder and remember it as a source."""
        c = self.get(name)
        self.check(c, embedder)
        done = self.ingest(name, read_contents(walk(self.spark, path, exclude)), embedder, metadata)
        c = self.get(name)
        if path not in c.sources:
            c.sources.append(path)
            self._save(c)
        return done

    def sync(self, name: str, embedder: Embedder, prune: bool = False, dry_run: bool = False) -> dict[str, int]:
        """Ingest the remembered sources again; with ``prune`` remove what is gone. A dry run only counts that."""
        c = self.get(name)
        if not c.sources:
            raise UsageError(f"{name!r} remembers no source")
        if dry_run and not prune:
            raise UsageError("a dry run is of pruning only")
        files = None
        for path in c.sources:
            one = walk(self.spark, path)
            files = one if files is None else files.unionByName(one)
        files = files.dropDuplicates(["source_uri"])
        done = {} if dry_run else self.ingest(name, read_contents(files), embedder)
        if prune:
            gone = keep(prunable(self.table(name, "documents"), files), "gone")
            done["pruned"] = gone.count()
            if done["pruned"] and not dry_run:
                self._commit(self.get(name), self._without(name, gone))
        return done

    def remove_documents(self, name: str, uris: list[str]) -> int:
        gone = keep(self.table(name, "documents").where(F.col("source_uri").isin(uris)), "gone")
        n = gone.count()
        if not n:
            raise NotFound("no such document")
        self._commit(self.get(name), self._without(name, gone))
        return n

    def remove_chunks(self, name: str, ids: list[str]) -> int:
        """Chunks and their vectors; the document row stays. Unknown ids raise before anything is removed."""
        chunks, vectors = self.table(name, "chunks"), self.table(name, "vectors")
        gone = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "_id string")
        if missing := gone.join(chunks, F.col("_id") == F.col("id"), "left_anti").orderBy("_id").limit(20).collect():
            raise NotFound("no such chunk: " + ", ".join(r[0] for r in missing))
        kept = chunks.join(gone, F.col("id") == F.col("_id"), "left_anti")
        self._commit(self.get(name), {"documents": self.table(name, "documents"), "chunks": kept, "vectors": vectors.join(gone, F.col("chunk_id") == F.col("_id"), "left_anti")})
        return len(set(ids))

    def drop(self, name: str) -> None:
        self.get(name)
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def export(self, name: str, path: str) -> None:
        """Documents, chunks and vectors with a manifest; every chunk must have its vector."""
        c = self.get(name)
        chunks, vectors = self.table(name, "chunks"), self.table(name, "vectors")
        if not chunks.join(vectors, chunks.id == vectors.chunk_id, "left_anti").isEmpty():
            raise InvariantError("a chunk has no vector")
        for kind in SCHEMAS:
            self.table(name, kind).write.parquet(f"{path}/{kind}")
        fs, p = self._fs(f"{path}/_manifest.json")
        out = fs.create(p)
        out.write(bytearray(json.dumps({"format_version": 1, "collection": asdict(c)}).encode()))
        out.close()

    def load(self, path: str, name: str | None = None, force: bool = False, embedder: Embedder | None = None) -> Collection:
        """Import an export, under another name if wished: ids are derived anew; an embedder embeds the stored texts again."""
        fs, p = self._fs(f"{path}/_manifest.json")
        if not fs.exists(p):
            raise NotFound(f"no export at {path}")
        stream = fs.open(p)
        raw = json.loads(bytes(stream.readAllBytes()))
        stream.close()
        if raw["format_version"] > 1:
            raise UsageError(f"the export has version {raw['format_version']}; at most 1 is known")
        old = raw["collection"]
        name = name or old["name"]
        if not NAME.fullmatch(name):
            raise UsageError(f"{name!r} is no collection name")
        if self._load(name) and not force:
            raise InvariantError(f"collection {name!r} exists")
        read = lambda kind: self.spark.read.schema(SCHEMAS[kind]).parquet(f"{path}/{kind}")
        docs = read("documents").withColumn("_old", F.col("id")).withColumn("id", document_id(F.lit(name), F.col("source_uri"))).withColumn("collection", F.lit(name))
        ids = docs.select("_old", F.col("id").alias("_new"))
        chunks = read("chunks").join(ids, F.col("document_id") == F.col("_old")).withColumn("document_id", F.col("_new")).withColumn("_chunk", F.col("id")).withColumn("id", chunk_id(F.col("_new"), F.col("seq"))).withColumn("collection", F.lit(name))
        vectors = read("vectors").join(chunks.select(F.col("_chunk").alias("chunk_id"), F.col("id").alias("_id"), "text"), "chunk_id").withColumn("chunk_id", F.col("_id")).withColumn("collection", F.lit(name))
        if embedder is not None:
            length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
            vectors = vectors.withColumn("vector", embedded(F.col("text"), embedder)).withColumn("norm", length)
        c = Collection(name, embedder.model if embedder else old["model"], embedder.dimensions if embedder else old["dimensions"], Chunker(**old["chunker"]) if old["chunker"] else None, old["created_at"], list(old.get("sources", [])))
        c.revision = (self._pointers(name) or [0])[-1]
        self._commit(c, {"documents": docs, "chunks": chunks, "vectors": vectors})
        return c
