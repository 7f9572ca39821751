"""Ranked retrieval for whole batches of questions.

Every operator takes a table of questions and returns ranked hits per question. Ranks are
carried as ``pos`` from 1; ties go by chunk id in byte order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import terms
from corpusmill.tables import keep

QUERY_BLOCK = 1024
ENTRY_BLOCK = 16_384
TERM_BLOCK = 4_000_000  # terms of the chunks in a block
K1, B = 1.2, 0.75
RRF_K = 60


def ranked(df: DataFrame, by: list[str], order: list[Column], k: Column | int | None = None, pos: str = "pos") -> DataFrame:
    """``df`` with the rank inside each group, cut at ``k``; nothing for ``k`` of 0 or less."""
    out = df.withColumn(pos, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(pos) <= k)


def _best_of(asked: np.ndarray, m: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (asked, entry) and cosines of the ``k`` best entries of each asked row.

    Single precision says which entries cannot be among them, with more to spare than its error;
    the rest are compared exactly.
    """
    length, norm = np.sqrt((asked * asked).sum(axis=1)), np.sqrt((m * m).sum(axis=1))
    unit = lambda x, by: np.divide(x, by[:, None], out=np.zeros_like(x), where=by[:, None] > 0).astype(np.float32)
    left, right, n, found = unit(asked, length), unit(m, norm).T, len(m), []
    groups = n // 64
    for at in range(0, len(asked), 64):
        rough = left[at : at + 64] @ right
        # A bound that k entries reach: the k-th best of the groups' maxima, or the k-th best itself.
        tops = rough[:, : groups * 64].reshape(len(rough), 64, groups).max(axis=1) if groups > k else rough
        least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] - 1e-4 if n > k else np.full(len(rough), -np.inf)
        i, j = np.nonzero(~(rough < least[:, None]))  # so that a NaN stays
        score = np.zeros(len(i))
        for part in range(0, len(i), 100_000):
            x, y = i[part : part + 100_000] + at, j[part : part + 100_000]
            size = norm[y] * length[x]
            # Rounded, so that equal vectors tie whatever the block's shape.
            score[part : part + 100_000] = np.round(np.divide((m[y] * asked[x]).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0), 12)
        order = np.lexsort((rank[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[top] + at, j[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block(k: int):  # noqa: ANN202
    def best(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        q, e = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        out: tuple[list, list, list] = ([], [], [])
        if q.num_rows and e.num_rows:
            vectors = lambda t: [np.asarray(v, np.float64) for v in t.column("vector").combine_chunks().to_numpy(zero_copy_only=False)]
            entries, keys = vectors(e), np.array(e.column("key").to_pylist(), object)
            asked, names = vectors(q), np.array(q.column("key").to_pylist(), object)
            rank = np.argsort(np.argsort(keys.astype("U")))  # ties by id; ids are compared as code points, as bytes are
            for n in sorted({len(v) for v in asked}):
                m = np.zeros((len(entries), n))  # an entry of another length stays zero
                fit = [i for i, v in enumerate(entries) if len(v) == n]
                m[fit] = np.array([entries[i] for i in fit]).reshape(len(fit), n)
                mine = np.array([i for i, v in enumerate(asked) if len(v) == n])
                i, j, score = _best_of(np.array([asked[x] for x in mine]).reshape(len(mine), n), m, rank, k)
                out[0].extend(names[mine[i]].tolist())
                out[1].extend(keys[j].tolist())
                out[2].extend(score.tolist())
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["query_id", "chunk_id", "score"])

    return best


def _in_blocks(asked: DataFrame, rows: DataFrame, plan: DataFrame) -> GroupedData:
    """Every block of questions with every block of rows of its scope.

    ``asked`` and ``rows``: (scope, key, ...) with the same columns; ``plan``: (scope, qb, eb), the
    number of blocks of either side.
    """
    number = lambda of: F.pmod(F.xxhash64("key"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = asked.join(plan, "scope").withColumn("q", number("qb")).withColumn("e", every("eb")).withColumn("side", F.lit(0))
    right = rows.join(plan, "scope").withColumn("e", number("eb")).withColumn("q", every("qb")).withColumn("side", F.lit(1))
    cols = ["scope", "q", "e", "side", *(c for c in asked.columns if c != "scope")]
    return left.select(*cols).unionByName(right.select(*cols)).groupBy("scope", "q", "e")


def cosine_topk(questions: DataFrame, vectors: DataFrame, k: int, scope: str = "collection", where: Column | None = None, query_block: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, pos): exact cosine, the ``k`` best of the question's scope.

    ``questions``: (query_id, scope column, vector); ``vectors``: (chunk_id, scope column, vector,
    ...). Rows that fail ``where`` take no part. A cosine with a vector of another length, an
    empty, null or zero one is 0. Both sides are cut into blocks by hash; a block of questions
    meets each block of vectors in a task of its own, whose size no collection changes. Blocks
    keep their own ``k`` best, so what is ranked again is small. ``query_block``: questions in a
    block; many where there are about as many questions as vectors, so that both are copied alike.
    """
    if k <= 0:
        return questions.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double, pos int")
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select(F.col("chunk_id").alias("key"), F.col(scope).alias("scope"), F.coalesce("vector", F.array().cast("array<float>")).alias("vector"))
    asked = questions.select(F.col("query_id").cast("string").alias("key"), F.col(scope).alias("scope"), F.coalesce("vector", F.array().cast("array<float>")).alias("vector"))
    sizes = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    asks = asked.groupBy("scope").agg(F.count(F.lit(1)).alias("m"))
    plan = sizes.join(asks, "scope").select("scope", F.ceil(F.col("n") / ENTRY_BLOCK).cast("int").alias("eb"), F.ceil(F.col("m") / (query_block or QUERY_BLOCK)).cast("int").alias("qb"))
    met = _in_blocks(asked, rows, plan).applyInArrow(_block(k), "query_id string, chunk_id string, score double")
    return ranked(met, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def postings(chunks: DataFrame) -> DataFrame:
    """(collection, chunk_id, term, tf)."""
    each = chunks.select("collection", F.col("id").alias("chunk_id"), F.explode(terms(F.col("text"))).alias("term"))
    return each.groupBy("collection", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists, and where each list begins and the last ends."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


def _lexical_block(k: int, k1: float, b: float):  # noqa: ANN202
    def best(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        q, e = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        out: tuple[list, list, list] = ([], [], [])
        if q.num_rows and e.num_rows:
            names, keys = q.column("key").to_pylist(), np.array(e.column("key").to_pylist(), object)
            rank = np.argsort(np.argsort(keys.astype("U")))
            asked, begin = _lists(q.column("codes"))
            idf, _ = _lists(q.column("weights"))
            codes, at = np.unique(asked, return_inverse=True)
            words, ends = _lists(e.column("codes"))
            n, length = len(keys), np.diff(ends)
            place = np.minimum(np.searchsorted(codes, words), len(codes) - 1)
            known = codes[place] == words
            # Postings of the asked terms: term after term, the chunks that hold it and how often.
            pairs, tf = np.unique(place[known] * n + np.repeat(np.arange(n), length)[known], return_counts=True)
            term, chunk = pairs // n, pairs % n
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[chunk] / q.column("mean_length")[0].as_py()))
            starts = np.searchsorted(term, np.arange(len(codes) + 1))
            for i, name in enumerate(names):
                own = range(begin[i], begin[i + 1])
                held = [slice(starts[at[x]], starts[at[x] + 1]) for x in own]
                score = np.bincount(np.concatenate([chunk[h] for h in held]), np.concatenate([part[h] * idf[x] for h, x in zip(held, own, strict=True)]), n)
                found = np.flatnonzero(score)
                rounded = np.round(score[found], 9)
                if len(found) > k:
                    near = rounded >= np.partition(rounded, len(found) - k)[len(found) - k]
                    found, rounded = found[near], rounded[near]
                top = found[np.lexsort((rank[found], -rounded))[:k]]
                out[0].extend([name] * len(top))
                out[1].extend(keys[top].tolist())
                out[2].extend(score[top].tolist())
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["query_id", "chunk_id", "score"])

    return best


def bm25_topk(questions: DataFrame, chunks: DataFrame, k: int, where: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, score, pos): BM25 inside the question's collection.

    ``questions``: (query_id, collection, text); ``chunks``: (id, collection, text, ...), id
    unique. Chunk count, document frequency and mean length are of the whole collection, before
    ``where``, chunks without a term included. A question's repeated terms count once; chunks
    that share no term are not returned.

    Texts are cut into terms once, each kept as a 64-bit hash. Document frequencies are counted
    before the shuffle, so a term that most chunks hold costs a row a task. Questions and chunks
    meet in blocks of bounded size, as in :func:`cosine_topk`, and postings exist only inside a
    block: no shuffle by term, and what is ranked again is the ``k`` best of each block.
    """
    if k <= 0:
        return questions.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double, pos int")
    codes = lambda text: F.transform(terms(text), lambda t: F.xxhash64(t))
    base = keep(chunks.select(F.col("collection").alias("scope"), F.col("id").alias("key"), codes(F.col("text")).alias("codes"), (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("passes")), "terms")
    size = F.size("codes")
    stats = base.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean_length"), F.ceil(F.sum(size) / TERM_BLOCK).alias("_blocks"))
    asked = questions.select(F.col("query_id").cast("string").alias("key"), F.col("collection").alias("scope"), F.explode(F.array_distinct(codes(F.col("text")))).alias("code"))
    wanted = asked.select("scope", "code").distinct()
    df = base.select("scope", F.explode(F.array_distinct("codes")).alias("code")).join(wanted, ["scope", "code"], "left_semi").groupBy("scope", "code").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, ["scope", "code"]).join(stats, "scope").select("scope", "key", "mean_length", F.struct("code", idf.alias("weight")).alias("t"))
    each = keep(weighed.groupBy("scope", "key").agg(F.collect_list("t").alias("t"), F.max("mean_length").alias("mean_length")).select("scope", "key", F.col("t.code").alias("codes"), F.col("t.weight").alias("weights"), "mean_length"), "weighed-questions")
    rows = base.where("passes").select("scope", "key", "codes", F.lit(None).cast("array<double>").alias("weights"), F.lit(None).cast("double").alias("mean_length"))
    asks = each.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qb"))
    plan = stats.join(asks, "scope").select("scope", "qb", F.greatest(F.lit(1), "_blocks", F.ceil(F.col("n") / ENTRY_BLOCK)).cast("int").alias("eb"))
    met = _in_blocks(each, rows, plan).applyInArrow(_lexical_block(k, k1, b), "query_id string, chunk_id string, score double")
    return ranked(met, ["query_id"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], k)


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, rrf, pos): the sum of 1 / (k + rank) over ranked lists (query_id, chunk_id, pos).

    An id that a list holds twice counts at its first place, and the places behind move up.
    """
    parts = None
    for one in lists:
        first = one.groupBy("query_id", "chunk_id").agg(F.min("pos").alias("pos"))
        part = ranked(first, ["query_id"], [F.asc("pos"), F.asc("chunk_id")], pos="rank").select("query_id", "chunk_id", (1 / (k + F.col("rank"))).alias("rrf"))
        parts = part if parts is None else parts.unionByName(part)
    total = parts.groupBy("query_id", "chunk_id").agg(F.sum("rrf").alias("rrf"))
    return ranked(total, ["query_id"], [F.desc(F.round("rrf", 12)), F.asc("chunk_id")])


def hybrid(near: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Rank fusion of a vector and a lexical pool; the score stays the cosine, 0 for what only the lexical pool holds."""
    fused = fuse([near, lexical])
    cosine = near.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return fused.join(cosine, ["query_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).where(F.col("pos") <= k)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk and document. Unknown chunks drop out; of a missing document the source is empty. Ranks close up.

    ``chunks`` and ``documents`` have unique ids.
    """
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "seq", "text", "heading_path")
    d = documents.select(F.col("id").alias("document_id"), F.col("source_uri").alias("source"), "metadata", "ingested_at")
    full = hits.join(c, "chunk_id").join(d, "document_id", "left").withColumn("source", F.coalesce("source", F.lit("")))
    return ranked(full.withColumnRenamed("pos", "_pos"), ["query_id"], [F.asc("_pos")]).drop("_pos")


def lookup(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the requested ids in request order, repeats repeated, unknown ones left out; ``ids``: (request_id, idx, key)."""
    return ids.join(rows, key)


def collection_pool(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several collections as one ranking: best score first, ties by chunk id."""
    return ranked(hits.drop("pos"), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
