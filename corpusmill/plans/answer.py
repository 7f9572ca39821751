"""Answers from hits, their faithfulness, and replaying them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.errors import InvariantError, UsageError
from corpusmill.functions.uris import basename
from corpusmill.operators.claims import evidence, segment
from corpusmill.operators.corpus import corpus_digest
from corpusmill.operators.evaluate import support_rate
from corpusmill.plans.ports import Embedder, Generator, Scorer, Verifier
from corpusmill.plans.resolve import RetrieveOptions, resolve
from corpusmill.store import Store
from corpusmill.tables import keep

_BRACKET = re.compile(r"\[([^\[\]]+)\]")


@dataclass(frozen=True)
class Answer:
    question: str
    text: str
    citations: list[str]
    grounded: bool


def prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, prompt): numbered passages with their file's name, then the question."""
    one = F.concat(F.lit("["), "pos", F.lit("] ("), basename(F.col("source")), F.lit(")\n"), "text")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))), lambda x: x["t"]), "\n\n")
    joined = hits.groupBy("query_id").agg(parts.alias("passages"))
    return joined.join(questions.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("q")), "query_id").select("query_id", F.concat("passages", F.lit("\n\nQuestion: "), "q").alias("prompt"))


def cite(text: str, ids: list[str]) -> tuple[str, list[str]]:
    """Ordinals in brackets as chunk ids. A bracket that holds anything else stays; citing nothing cites all."""
    used: list[str] = []

    def swap(m: re.Match[str]) -> str:
        parts = [p.strip() for p in m[1].split(",")]
        if not all(p.isascii() and p.isdecimal() and 1 <= int(p) <= len(ids) for p in parts):
            return m[0]
        found = [ids[int(p) - 1] for p in parts]
        used.extend(found)
        return "[" + ", ".join(found) + "]"

    out = _BRACKET.sub(swap, text)
    return out, list(dict.fromkeys(used)) or list(ids)


def renumber(text: str, citations: list[str]) -> tuple[str, list[str]]:
    """Chunk ids in brackets as ``[n]`` each, by first appearance; what the text does not cite follows.

    Unknown ids beside a known one are left out; a bracket without any known one stays.
    """
    known = set(citations)
    ids_in = lambda inside: [p for p in map(str.strip, inside.split(",")) if p in known]
    seen = dict.fromkeys(i for m in _BRACKET.finditer(text) for i in ids_in(m[1]))
    place = {i: n for n, i in enumerate([*seen, *(c for c in dict.fromkeys(citations) if c not in seen)], 1)}
    return _BRACKET.sub(lambda m: "".join(f"[{place[i]}]" for i in ids_in(m[1])) or m[0], text), list(place)


def synthesize(question: str, hits: list[tuple[str, str]], generator: Generator, strict: bool = False) -> Answer:
    """An answer over hits (chunk_id, text) in rank order; strict, without any it is not attempted."""
    if not hits:
        if strict:
            raise InvariantError("nothing was retrieved to answer from")
        return Answer(question, generator(question, []), [], False)
    text, cited = cite(generator(question, [t for _, t in hits]), [i for i, _ in hits])
    return Answer(question, text, cited, True)


def cache_key(salt: str, question: str, hits: list[tuple[str, str, str, int]]) -> str:
    """Of (id, text, source, seq) in order."""
    parts = [salt, question, *(str(x) for h in hits for x in h)]
    return hashlib.sha256("".join(p + "\0" for p in parts).encode()).hexdigest()


def cache_get(cache: DataFrame, keys: DataFrame, not_before: str) -> DataFrame:
    """Answers to keys stored since; ``cache``: (key, answer, stored_at), the latest of a key counts."""
    last = cache.where(F.col("stored_at") >= F.to_timestamp(F.lit(not_before))).groupBy("key").agg(F.max_by("answer", "stored_at").alias("answer"))
    return keys.join(last, "key", "left")


def cache_put(cache: DataFrame, more: DataFrame) -> DataFrame:
    return cache.join(more.select("key"), "key", "left_anti").unionByName(more)


def cache_prune(cache: DataFrame, cutoff: str) -> DataFrame:
    return cache.where(F.col("stored_at") >= F.to_timestamp(F.lit(cutoff)))


def ask(store: Store, spark: SparkSession, question: str, o: RetrieveOptions, embedder: Embedder, generator: Generator, scorer: Scorer | None = None, strict: bool = False) -> tuple[Answer, list]:
    """One question: retrieve, then answer from at most k passages."""
    asked = spark.createDataFrame([("q", question)], "query_id string, text string")
    hits = resolve(store, asked, o, embedder, scorer).orderBy("pos").collect()
    return synthesize(question, [(h.chunk_id, h.text) for h in hits], generator, strict), hits


def _judged(texts: DataFrame, verifier: Verifier) -> DataFrame:
    """(answer_id, pos, _v) of claims with evidence, a batch at a time."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [verifier(c, e)[0] if e else "unsupported" for c, e in zip(batch.column("claim").to_pylist(), batch.column("evidence").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("answer_id"), batch.column("pos"), pa.array(said, pa.string())], names=["answer_id", "pos", "_v"])

    kind = texts.schema["answer_id"].dataType.simpleString()
    return texts.select("answer_id", "pos", "claim", "evidence").mapInArrow(judge, f"answer_id {kind}, pos int, _v string")


def verify(answers: DataFrame, chunks: DataFrame, verifier: Verifier, origins: DataFrame | None = None, default: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims with verdicts, support per answer) of answers (answer_id, text, valid).

    ``origins`` and ``default`` tell the collections of cited ids (:func:`evidence`).

    Uncited claims are not judged. An answer that marks nothing but has citations is judged
    against all of them. Without evidence a claim is unsupported.
    """
    found = keep(segment(answers), "claims")
    unmarked = found.groupBy("answer_id").agg((F.max(F.size("cited")) == 0).alias("_bare"))
    valid = answers.select("answer_id", "valid")
    full = found.join(unmarked, "answer_id").join(valid, "answer_id")
    against_all = F.col("_bare") & (F.size("valid") > 0)
    full = full.withColumn("cited", F.when(against_all, F.col("valid")).otherwise(F.col("cited"))).withColumn("verdict", F.when(against_all, None).otherwise(F.col("verdict")))
    full = keep(full.select("answer_id", "pos", "claim", "cited", "verdict"), "cited-claims")
    judged = _judged(evidence(full, chunks, origins, default), verifier)
    out = full.join(judged, ["answer_id", "pos"], "left").withColumn("verdict", F.coalesce("verdict", "_v", F.lit("unsupported"))).drop("_v")
    out = keep(out, "verdicts")
    every = answers.select("answer_id").join(out.select("answer_id", "verdict"), "answer_id", "left")
    return out, support_rate(every)


@dataclass(frozen=True)
class Manifest:
    question: str
    corpora: dict[str, str]
    options: RetrieveOptions
    cited: list[str]
    answer_hash: str
    generation: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        raw = raw.get("manifest", raw)
        if not raw.get("corpora"):
            raise UsageError("the manifest names no corpus")
        return cls(**raw | {"options": RetrieveOptions(**raw["options"])})


def digests(store: Store, names: list[str]) -> dict[str, str]:
    empty = hashlib.sha256(b"").hexdigest()
    return {n: (r.digest if (r := corpus_digest(store.table(n, "documents")).first()) else empty) for n in names}


def manifest(store: Store, answer: Answer, o: RetrieveOptions, generation: dict[str, str] | None = None) -> Manifest:
    return Manifest(answer.question, digests(store, o.collections), o, answer.citations, hashlib.sha256(answer.text.encode()).hexdigest(), generation or {})


def replay(store: Store, spark: SparkSession, m: Manifest, embedder: Embedder, generator: Generator, scorer: Scorer | None = None) -> dict[str, bool]:
    """Whether the corpus, the retrieval and the answer are as they were; a changed corpus ends it there."""
    if digests(store, list(m.corpora)) != m.corpora:
        return {"corpus": False, "retrieval": False, "answer": False}
    answer, hits = ask(store, spark, m.question, m.options, embedder, generator, scorer)
    found = {h.chunk_id for h in hits}
    return {"corpus": True, "retrieval": set(m.cited) <= found, "answer": hashlib.sha256(answer.text.encode()).hexdigest() == m.answer_hash}
