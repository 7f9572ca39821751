"""One retrieval from its options, over a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.errors import InvariantError, UsageError
from corpusmill.functions.dates import document_time
from corpusmill.functions.globs import glob_to_regex, source_matches
from corpusmill.functions.predicates import parse, predicate
from corpusmill.operators import rank, search
from corpusmill.plans.ports import Embedder, Scorer, embedded
from corpusmill.store import Store
from corpusmill.tables import keep

OVERFETCH = 10
POOL = 50


@dataclass(frozen=True)
class RetrieveOptions:
    collections: list[str]
    k: int = 8
    where: list[str] = field(default_factory=list)
    source: str = ""
    lexical: bool = False
    hybrid: bool = False
    explain: bool = False
    rerank: bool = False
    candidates: int = 50
    mmr: bool = False
    weight: float = 0.5
    recency: bool = False
    half_life_days: float = 90.0
    now: str = ""
    max_per_source: int = 0
    budget: int = 0


def validate(o: RetrieveOptions, scorer: Scorer | None = None) -> None:
    """Raises UsageError for options that exclude each other, before any job."""
    names = list(dict.fromkeys(o.collections))
    several = len(names) > 1
    wrong = [
        (not names, "name a collection"),
        (o.lexical and (o.hybrid or o.rerank or o.mmr or o.recency), "lexical goes with neither hybrid, rerank, mmr nor recency"),
        (o.lexical and several, "lexical is of one collection"),
        (o.hybrid and several, "hybrid is of one collection"),
        (o.recency and (o.mmr or o.rerank), "recency goes with neither mmr nor rerank"),
        (o.recency and o.half_life_days <= 0, "the half life must be above 0"),
        (o.mmr and o.rerank, "mmr does not go with rerank"),
        (o.mmr and several, "mmr is of one collection"),
        (o.rerank and scorer is None, "no reranker is given"),
        (o.rerank and o.candidates < o.k, "fewer candidates than results"),
    ]
    for bad, why in wrong:
        if bad:
            raise UsageError(why)
    parse(o.where)
    if o.source:
        glob_to_regex(o.source)


def resolve(store: Store, questions: DataFrame, o: RetrieveOptions, embedder: Embedder, scorer: Scorer | None = None) -> DataFrame:
    """Hydrated hits (query_id, pos, chunk_id, score, ...) of questions (query_id, text), with ``runner_up`` when explained.

    Order of steps: fuse, rerank, decay or diversify, then the cap per source, then the token
    budget. A source pattern applies after ten times the hits are fetched. The collection is
    filled only where several were asked.
    """
    validate(o, scorer)
    names = list(dict.fromkeys(o.collections))
    spaces = {(c.model, c.dimensions) for c in map(store.get, names)}
    if spaces != {(embedder.model, embedder.dimensions)} and not o.lexical:
        raise InvariantError("the collections are of another embedding space than the embedder")
    if not questions.where(F.coalesce(F.trim("text"), F.lit("")) == "").isEmpty():
        raise UsageError("a question is empty")
    pooled = o.mmr or o.recency
    wanted = o.candidates if o.rerank else max(o.k, POOL) if pooled else o.k + (1 if o.explain else 0) if o.k > 0 else 0
    fetch = wanted * (OVERFETCH if o.source else 1)
    chunks = documents = vectors = None
    for name in names:
        c, d, v = (store.table(name, kind) for kind in ("chunks", "documents", "vectors"))
        chunks, documents, vectors = (c, d, v) if chunks is None else (chunks.unionByName(c), documents.unionByName(d), vectors.unionByName(v))
    holds = predicate(o.where, F.col("metadata"))
    asked = questions.select(F.col("query_id").cast("string").alias("query_id"), "text")
    lexical = near = None
    if o.lexical or o.hybrid:
        pool = fetch if o.lexical else max(wanted, POOL) * (OVERFETCH if o.source else 1) if o.k > 0 or pooled else 0
        with_meta = chunks.join(documents.select(F.col("id").alias("document_id"), "metadata"), "document_id", "left")
        lexical = search.bm25_topk(asked.withColumn("collection", F.lit(names[0])), with_meta, pool, where=holds)
    if not o.lexical:
        pool = fetch if not o.hybrid else max(wanted, POOL) * (OVERFETCH if o.source else 1) if o.k > 0 or pooled else 0
        of_query = keep(asked.withColumn("vector", embedded(F.col("text"), embedder)), "questions")
        every = of_query.withColumn("collection", F.explode(F.array(*map(F.lit, names)))).withColumn("query_id", F.concat("query_id", F.lit("\0"), "collection"))
        near = search.cosine_topk(every, vectors, pool, where=holds)
        near = near.withColumn("collection", F.substring_index("query_id", "\0", -1)).withColumn("query_id", F.substring_index("query_id", "\0", 1))
        near = search.collection_pool(near, pool)
    if o.lexical:
        hits = lexical.withColumn("score", F.lit(0.0))
    elif o.hybrid:
        hits = search.hybrid(keep(near.drop("collection"), "near"), lexical, fetch)
    else:
        hits = near
    if "collection" not in hits.columns or len(names) == 1:
        hits = hits.drop("collection").withColumn("collection", F.lit(None).cast("string"))
    hits = search.hydrate(hits.select("query_id", "chunk_id", "score", "pos", "collection"), chunks, documents)
    if o.source:
        hits = hits.where(source_matches(F.col("source"), o.source)).withColumnRenamed("pos", "_pos")
        hits = search.ranked(hits, ["query_id"], [F.asc("_pos")]).drop("_pos")
    hits = hits.where(F.col("pos") <= wanted).withColumn("rerank_score", F.lit(None).cast("double"))
    if o.rerank:
        hits = rank.rerank(hits.join(asked.withColumnRenamed("text", "query"), "query_id"), scorer, 0 if o.explain else o.k).drop("query")
    if o.explain and not pooled:
        value = F.coalesce("rerank_score", "score")
        hits = rank.explain(hits.withColumn("_kept", F.col("score")).withColumn("score", value), o.k).withColumn("score", F.col("_kept")).drop("_kept")
    elif o.mmr:
        hits = rank.mmr(hits, vectors, o.k, o.weight, POOL)
    elif o.recency:
        hits = rank.by_recency(hits, document_time(F.col("source"), F.col("metadata"), F.col("ingested_at")), o.now, o.half_life_days, o.k)
    else:
        hits = hits.where(F.col("pos") <= o.k)
    hits = rank.cap_per_source(hits, o.max_per_source)
    if o.budget > 0:
        from corpusmill.functions.text import words

        hits = rank.token_budget(hits, F.size(words(F.col("text"))), o.budget).drop("used_tokens")
    return hits
