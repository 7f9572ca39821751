"""Registered queries of the retrieval operators, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.dates import document_time, path_time
from corpusmill.functions.globs import source_matches
from corpusmill.functions.predicates import predicate
from corpusmill.functions.text import terms, words
from corpusmill.functions.uris import basename
from corpusmill.operators import chunking, claims, corpus, evaluate, rank, search, snapshots
from corpusmill.plans import answer, ports
from corpusmill.sources import evalset, extract
from corpusmill.tables import keep, read

NOW = "2025-06-14T00:00:00Z"
K = 8


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, one row per id."""
    t = read(spark, sf_dir, "chunks")
    return t.groupBy("id").agg(F.max(F.struct("document_id", "collection", "seq", "text", "heading_path")).alias("r")).select("id", "r.*")


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all collections, one row per id."""
    both = read(spark, sf_dir, "source_docs").unionByName(read(spark, sf_dir, "shared_docs"))
    return both.dropDuplicates(["id"])


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, one row per chunk, without those of which a component is not a number."""
    t = read(spark, sf_dir, "vectors")
    sound = F.coalesce(~F.exists("vector", lambda x: F.isnan(x) | x.isNull()), F.lit(True))
    return t.where(sound).groupBy("chunk_id").agg(F.max(F.struct("collection", "vector")).alias("r")).select("chunk_id", "r.*")


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer lists, one row per query and chunk (the latest logged), ranked anew from 1; null and NaN scores count 0."""
    t = read(spark, sf_dir, "hits")
    sound = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    last = t.groupBy("query_id", "chunk_id").agg(F.max(F.struct("logged_at", "pos", F.coalesce(sound, F.lit(0.0)).alias("score"), "rerank_score", "source", "ingested_at")).alias("r")).select("query_id", "chunk_id", "r.*")
    return search.ranked(last.withColumnRenamed("pos", "_pos"), ["query_id"], [F.asc("_pos"), F.asc("chunk_id")]).drop("_pos", "logged_at")


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading paths of chunks whose number is divisible by 20, asked in their collection."""
    t = chunks_of(spark, sf_dir).where((F.col("seq") % 20 == 0) & (F.col("heading_path") != ""))
    return t.select(F.col("id").alias("query_id"), "collection", F.col("heading_path").alias("text"))


def asking_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of chunks whose number is divisible by 20."""
    number = F.substring_index("chunk_id", ":", -1).cast("int")
    return vectors_of(spark, sf_dir).where(number % 20 == 0).select(F.col("chunk_id").alias("query_id"), "collection", "vector")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(search.cosine_topk(asking_vectors(spark, sf_dir), vectors_of(spark, sf_dir), K), "score")


def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors_of(spark, sf_dir).withColumn("document_id", F.substring_index("chunk_id", ":", 1))
    d = documents_of(spark, sf_dir).select(F.col("id").alias("document_id"), "metadata")
    return _round(search.cosine_topk(asking_vectors(spark, sf_dir), v.join(d, "document_id"), K, where=predicate(["tags~s*"], F.col("metadata"))), "score")


def cosine_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.cosine_topk(asking_vectors(spark, sf_dir), vectors_of(spark, sf_dir), K + 1)
    return _round(rank.explain(near, K), "score", "runner_up")


def cross_collection_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cross_collection_topk_all for the asking vectors of the handbook, a share that SQL can check."""
    space = read(spark, sf_dir, "collections").groupBy("name").agg(F.max("model").alias("model"), F.max("dimensions").alias("dimensions"))
    own = asking_vectors(spark, sf_dir).where("collection = 'handbook'").join(space.withColumnRenamed("name", "collection"), "collection").drop("collection")
    asked = own.join(space.withColumnRenamed("name", "collection"), ["model", "dimensions"]).select("query_id", "collection", "vector")
    each = search.cosine_topk(asked.withColumn("query_id", F.concat("query_id", F.lit("@"), "collection")), vectors_of(spark, sf_dir), K)
    tagged = each.withColumn("collection", F.substring_index("query_id", "@", -1)).withColumn("query_id", F.substring_index("query_id", "@", 1))
    return _round(search.collection_pool(tagged, K), "score")


def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """similarity_join_all for one pair of collections, a share that SQL can check; vectors without a match stay, unmatched."""
    v = vectors_of(spark, sf_dir)
    asked = v.where("collection = 'handbook'").select(F.col("chunk_id").alias("query_id"), F.lit("team-blog").alias("collection"), "vector")
    found = search.cosine_topk(asked, v, 3)
    return _round(asked.select("query_id").join(found, "query_id", "left"), "score")


def _comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collection, target): collections of one space, that is of the same model and dimensions, each with itself too."""
    space = read(spark, sf_dir, "collections").groupBy("name").agg(F.max("model").alias("model"), F.max("dimensions").alias("dimensions"))
    return space.withColumnRenamed("name", "collection").join(space.withColumnRenamed("name", "target"), ["model", "dimensions"]).select("collection", "target")


def _in_each(asked: DataFrame, vectors: DataFrame, k: int, query_block: int | None = None) -> DataFrame:
    """(query_id, collection, target, chunk_id, score, pos): the ``k`` best of each target; ``asked``: (query_id, collection, target, vector)."""
    named = asked.select(F.concat_ws("\0", "target", "collection", "query_id").alias("query_id"), F.col("target").alias("collection"), "vector")
    part = F.split("query_id", "\0", 3)
    found = search.cosine_topk(named, vectors, k, query_block=query_block)
    return found.select(part[2].alias("query_id"), part[1].alias("collection"), part[0].alias("target"), "chunk_id", "score", "pos")


def cross_collection_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asking vector, of whatever collection, in all collections of its space: the best of them all, tagged."""
    space = read(spark, sf_dir, "collections").groupBy(F.col("name").alias("collection")).agg(F.max("model").alias("model"), F.max("dimensions").alias("dimensions"))
    space = space.where("model is not null and dimensions is not null").select("collection", F.concat_ws("\0", "model", F.col("dimensions").cast("string")).alias("space"))
    v = vectors_of(spark, sf_dir).join(space, "collection")
    asked = asking_vectors(spark, sf_dir).join(space, "collection")
    found = search.cosine_topk(asked, v, K, "space", query_block=search.ENTRY_BLOCK)
    return _round(found.join(v.select("chunk_id", "collection"), "chunk_id").select("query_id", "chunk_id", "score", "collection", "pos"), "score")


def similarity_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against those of every other collection of its space, 3 of each; without a match it stays, unmatched."""
    v = vectors_of(spark, sf_dir)
    others = _comparable(spark, sf_dir).where("collection != target")
    asked = v.withColumnRenamed("chunk_id", "query_id").join(others, "collection", "left")
    found = _in_each(asked.where("target is not null"), v, 3, search.ENTRY_BLOCK)
    held = v.select(F.col("collection").alias("target")).distinct()
    alone = asked.join(held, "target", "left_anti").select("query_id", "collection", "target")
    return _round(found.unionByName(alone, allowMissingColumns=True), "score")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(search.bm25_topk(questions_of(spark, sf_dir), chunks_of(spark, sf_dir), K), "score")


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter cuts the answers, not the statistics."""
    return _round(search.bm25_topk(questions_of(spark, sf_dir), chunks_of(spark, sf_dir), K, where=F.col("seq") >= 2), "score")


def _pools(spark: SparkSession, sf_dir: str, pool: int = 50) -> tuple[DataFrame, DataFrame]:
    asked = questions_of(spark, sf_dir)
    near = search.cosine_topk(asking_vectors(spark, sf_dir).join(asked.select("query_id"), "query_id", "left_semi"), vectors_of(spark, sf_dir), pool)
    return near, search.bm25_topk(asked, chunks_of(spark, sf_dir), pool)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, lexical = _pools(spark, sf_dir)
    return _round(search.hybrid(keep(near, "near"), lexical, K), "score", "rrf")


def fuse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logged list fused with its own order by score."""
    hits = hits_of(spark, sf_dir)
    second = search.ranked(hits.drop("pos"), ["query_id"], [F.desc("score"), F.asc("chunk_id")])
    return _round(search.fuse([hits, second]), "rrf")


def source_glob_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten times the hits are fetched, then the source pattern applies, then the cut."""
    near = search.cosine_topk(asking_vectors(spark, sf_dir), vectors_of(spark, sf_dir), 10 * K)
    full = search.hydrate(near, chunks_of(spark, sf_dir), documents_of(spark, sf_dir))
    kept = full.where(source_matches(F.col("source"), "*-[0-9]*.md")).withColumnRenamed("pos", "_pos")
    return _round(search.ranked(kept, ["query_id"], [F.asc("_pos")], K).select("query_id", "chunk_id", "source", "score", "pos"), "score")


def hydrate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hits_of(spark, sf_dir).select("query_id", "chunk_id", "score", "pos")
    full = search.hydrate(hits, chunks_of(spark, sf_dir), documents_of(spark, sf_dir))
    return _round(full.select("query_id", "pos", "chunk_id", "document_id", "seq", "source", "score", F.length("text").alias("chars")), "score")


def cap_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.cap_per_source(hits_of(spark, sf_dir), 2).select("query_id", "chunk_id", "source", "pos")


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks_of(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.size(words(F.col("text"))).cast("long").alias("tokens"))
    priced = hits_of(spark, sf_dir).join(c, "chunk_id")
    priced = search.ranked(priced.withColumnRenamed("pos", "_pos"), ["query_id"], [F.asc("_pos")])
    return rank.token_budget(priced, F.col("tokens"), 600).select("query_id", "chunk_id", "pos", "used_tokens")


def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rank.by_recency(hits_of(spark, sf_dir), F.col("ingested_at"), NOW, 90.0, K).select("query_id", "chunk_id", "score", "pos"), "score")


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Means of scores with six digits end in a half often; twelve digits have none.
    return _round(rank.score_distribution(hits_of(spark, sf_dir)), "least", "greatest").withColumn("mean", F.round("mean", 12))


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.cosine_topk(asking_vectors(spark, sf_dir), vectors_of(spark, sf_dir), 50)
    return _round(rank.mmr(near, vectors_of(spark, sf_dir), K), "score")


def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions_of(spark, sf_dir)
    pool = search.bm25_topk(asked, chunks_of(spark, sf_dir), 20)
    texts = chunks_of(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.col("text"))
    full = pool.join(texts, "chunk_id").join(asked.select("query_id", F.col("text").alias("query")), "query_id")
    return _round(rank.rerank(full, ports.overlap_scores, K).select("query_id", "chunk_id", "score", "rerank_score", "pos"), "score", "rerank_score")


def where_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.create_map(F.lit("size"), F.substring_index("fingerprint", ":", 1))
    docs = documents_of(spark, sf_dir)
    return docs.where(predicate(["size>=1500", "size<2e4"], size)).select("id", "source_uri")


def where_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(spark, sf_dir).where(predicate(["mtime>=2025-01-01", "mtime<2025-07-01T12:00:00Z"], F.col("metadata"))).select("id", "source_uri")


def where_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(spark, sf_dir).where(predicate(["tags~[m-s]*", "author!=u-1"], F.col("metadata"))).select("id", "source_uri")


def inferred_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    return docs.select("id", document_time(F.col("source_uri"), F.col("metadata"), F.col("ingested_at")).alias("told_at"))


def path_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir).select("id", path_time(F.col("source_uri")).alias("named_at"))
    return docs.where("named_at is not null")


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per term and collection."""
    return search.postings(chunks_of(spark, sf_dir)).groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def chunk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).select("id", F.size(terms(F.col("text"))).alias("len"))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.fixed_chunks(read(spark, sf_dir, "documents"), 128, 16)
    return cut.select("doc_id", F.col("seq"), F.sha2("text", 256).alias("text_hash"))


def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document chunked by its content type: markdown by headings, sheets by rows, the rest as text."""
    return chunking.chunk_documents(read(spark, sf_dir, "documents"), 256, 32).select("doc_id", "seq", "heading_path", "text")


def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is the digest of their collection and name."""
    d = documents_of(spark, sf_dir)
    return d.select("id", (corpus.document_id(F.col("collection"), F.col("source_uri")) == F.col("id")).alias("holds"))


def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_digest(documents_of(spark, sf_dir))


def _run(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    rows = read(spark, sf_dir, "doc_snapshots").where((F.col("snapshot_no") == number) & F.col("source_uri").isNotNull())
    uri = F.concat(F.col("collection"), F.lit("|"), F.col("source_uri"))
    return rows.groupBy(uri.alias("source_uri")).agg(F.max(F.struct("loaded_at", "hash", "fingerprint")).alias("r")).select("source_uri", "r.hash", "r.fingerprint")


def collection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of run 4 against those of run 5 as written, collections kept apart: what SQL checks; collection_diff_all has every run."""
    return corpus.diff(_run(spark, sf_dir, 4), _run(spark, sf_dir, 5))


STEP = ("snapshot_no", "collection", "source_uri")


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    clean = keep(snapshots.clean_snapshots(spark, sf_dir, ("fingerprint",)), "snapshots")
    old, new = snapshots.run_pairs(clean, snapshots.previous_runs(spark, sf_dir))
    return keep(old, "run-before"), keep(new, "run")


def collection_diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete run of every collection against its complete run before, by files and digests."""
    return corpus.diff(*_steps(spark, sf_dir), STEP)


def prune_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents that no run delivered."""
    return corpus.prunable(documents_of(spark, sf_dir).select("id", "source_uri"), read(spark, sf_dir, "doc_snapshots").select("source_uri")).select("id", "source_uri")


def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest of run 6 would do to a store of run 5, as written: what SQL checks; ingest_outcomes_all has every run."""
    found = corpus.outcomes(_run(spark, sf_dir, 6), _run(spark, sf_dir, 5))
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"))


def ingest_outcomes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest of every complete run would do to a store of the complete run before, per run and collection."""
    old, new = _steps(spark, sf_dir)
    found = corpus.outcomes(new, old, STEP)
    return found.groupBy("snapshot_no", "collection", "outcome").agg(F.count(F.lit(1)).alias("documents"))


def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.status(read(spark, sf_dir, "collections"), documents_of(spark, sf_dir), vectors_of(spark, sf_dir))


def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose document is gone."""
    docs = documents_of(spark, sf_dir).select(F.col("id").alias("document_id"))
    return chunks_of(spark, sf_dir).join(docs, "document_id", "left_anti").select("id", "document_id")


def document_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.functions.globs import glob_to_regex

    return corpus.selected(documents_of(spark, sf_dir), "*.csv", glob_to_regex("*.csv")).select("id", "source_uri", basename(F.col("source_uri")).alias("name"))


def lookup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list's chunks looked up in its order; unknown ids are skipped."""
    ids = hits_of(spark, sf_dir).select("query_id", F.col("pos").alias("idx"), F.col("chunk_id").alias("id"))
    return search.lookup(ids, chunks_of(spark, sf_dir)).select("query_id", "idx", "id", "collection", "seq")


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document taken as a file's content: what extraction reads as title and how long the rest is."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "content_type", F.lit(None).cast("timestamp").alias("mtime"), F.encode("text", "UTF-8").alias("content"))
    found = extract.extract(docs.withColumn("content_type", F.when(F.col("content_type") == "text/markdown", F.col("content_type")).otherwise("text/plain")))
    return found.where("map_contains_key(metadata, 'title')").select("doc_id", F.col("metadata")["title"].alias("title"))


def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every question over its three best passages."""
    asked = questions_of(spark, sf_dir)
    full = search.hydrate(search.bm25_topk(asked, chunks_of(spark, sf_dir), 3), chunks_of(spark, sf_dir), documents_of(spark, sf_dir))
    return answer.prompts(full, asked).select("query_id", F.sha2("prompt", 256).alias("prompt_hash"))


def judged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk taken as an answer that cites itself and the first chunk of its document, judged by shared terms."""
    valid = F.array(F.col("id"), F.concat("document_id", F.lit(":0")))
    texts = chunks_of(spark, sf_dir).select(F.col("id").alias("answer_id"), "text", valid.alias("valid"))
    return _round(answer.verify(texts, chunks_of(spark, sf_dir), ports.overlap_verdict)[1], "rate")


def hits_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.hits_json(hits_of(spark, sf_dir).select("query_id", "pos", "chunk_id", "score", "source"))


def eval_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists judged by source: the source of the best score is expected, a source counts at its first place."""
    hits = hits_of(spark, sf_dir).where("source != ''")
    best = hits.groupBy("query_id").agg(F.min(F.struct(-F.col("score"), F.col("chunk_id"), F.col("source"))).alias("b")).select("query_id", F.col("b.source").alias("source"))
    return _round(evaluate.per_question(hits, best, 5, "source"), *evaluate.METRICS)


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every list, the chunks that its best score's document has."""
    hits = hits_of(spark, sf_dir)
    best = hits.groupBy("query_id").agg(F.min(F.struct(-F.col("score"), F.col("chunk_id"))).alias("b")).select("query_id", F.substring_index("b.chunk_id", ":", 1).alias("document_id"))
    return best.join(chunks_of(spark, sf_dir).select("document_id", F.col("id").alias("chunk_id")), "document_id").select("query_id", "chunk_id")


def eval_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.per_question(hits_of(spark, sf_dir), _expected(spark, sf_dir), 10, "chunk_id")
    return _round(found, *evaluate.METRICS)


def eval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.means(evaluate.per_question(hits_of(spark, sf_dir), _expected(spark, sf_dir), 10, "chunk_id"))
    return _round(found, *evaluate.METRICS)


def claim_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document taken as an answer that cites nothing known."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), "text", F.array().cast("array<string>").alias("valid"))
    return claims.segment(docs).select("answer_id", "pos", "claim", "verdict")


def support_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk texts as claims, judged against the chunk before them in their document by shared terms."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("document_id").orderBy("seq", "id"))
    pairs = chunks_of(spark, sf_dir).withColumn("evidence", before).where("evidence is not null")
    a, b = F.array_distinct(terms(F.col("text"))), F.array_distinct(terms(F.col("evidence")))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    judged = pairs.select(F.col("document_id").alias("answer_id"), F.when(share >= 0.2, "supported").otherwise("unsupported").alias("verdict"))
    return _round(evaluate.support_rate(judged), "rate")
