"""The queries of the core, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import snapshots
from corpusmill.plans import queries as q
from corpusmill.plans import sql

QUERIES = (
    q.cosine_topk, q.cosine_topk_filtered, q.cosine_explain, q.cross_collection_topk, q.similarity_join, q.bm25_topk, q.bm25_filtered,
    q.cross_collection_topk_all, q.similarity_join_all, q.collection_diff_all, q.ingest_outcomes_all,
    q.hybrid_rrf, q.fuse_lists, q.source_glob_overfetch, q.hydrate_hits, q.cap_per_source, q.token_budget, q.recency_decay,
    q.score_distribution, q.mmr_select, q.rerank_pool, q.where_numeric, q.where_date, q.where_tags, q.inferred_time, q.path_date,
    q.term_statistics, q.chunk_lengths, q.fixed_chunks, q.structured_chunks, q.document_identity, q.corpus_digest, q.collection_diff,
    q.prune_set, q.ingest_outcomes, q.collection_status, q.orphan_chunks, q.document_select, q.eval_questions, q.eval_means,
    q.claim_segments, q.support_rate, q.lookup_chunks, q.front_matter, q.answer_prompts, q.judged_claims, q.hits_as_json, q.eval_sources,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": snapshots.p3_found, "p3_old_values": snapshots.p3_old_values} | {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
