"""Most similar vectors for every vector, by an inverted multi-index.

Both halves of the vectors of a collection are quantised by their own centroids, whose number
grows with the square root of the collection, so that a cell holds about CELL vectors at every
size; a vector's cell is the pair of its nearest ones. A query visits a fixed number of pairs of
centroids in the order of their summed distance, taken from a heap over the two sorted lists, and
the vectors in the visited cells are reranked by their exact cosine.

Near centroids are grouped, and the cells of a group of the first half and one of the second are
a block of about SHARD vectors. A query is sent to the blocks that hold cells it visits. Blocks
that hold more are cut into parts, which share their queries; blocks that very many queries visit
are served by several tasks. A task holds one part of a block and streams queries past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.tables import keep, read

CELL = 6.4  # vectors in a cell, about
SAMPLE = 8192  # vectors per collection that the centroids are fitted on, chosen by hash
PER_CENTROID = 32  # but as many for each centroid at least
SHARD = 32_768
QUERIES = 65_536  # a task's queries, about
ROUNDS = 10  # of Lloyd's algorithm
PROBES = 24  # cells visited where only near neighbours are wanted
WIDE = 1280  # cells visited where all of the first ones are; about 8,000 vectors
SALT_ROWS = 20_000
SEEN = 500_000


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


_ROWS = "collection string, chunk_id string, key long, dims int, vec binary, least string, asks boolean"


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per usable vector, and rows per class of equal vectors.

    The first row of a class in this task has the vector; of further rows only the smallest id
    and whether any asks are told once more, at the end (without a chunk_id).
    """
    seen: dict[bytes, list] = {}

    def rest() -> pa.RecordBatch:
        more = [(c, None, k, d, None, i, a) for c, k, d, i, a, again in seen.values() if again]
        return _batch([list(x) for x in zip(*more, strict=True)] if more else [[]] * 7, _ROWS)

    for batch in batches:
        ids, places, dims, asks = (batch.column(c).to_pylist() for c in ("chunk_id", "collection", "dims", "asks"))
        vectors = batch.column("vector")
        flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
        ends = vectors.offsets.to_numpy()
        valid = vectors.is_valid().to_numpy(zero_copy_only=False)
        out: list[list] = [[] for _ in range(7)]
        for i, (key, place, d, ask) in enumerate(zip(ids, places, dims, asks, strict=True)):
            if not valid[i] or key is None or ends[i + 1] - ends[i] != d:
                continue
            v = flat[ends[i] : ends[i + 1]]
            if not np.isfinite(v).all() or not v.any():
                continue
            raw = v.tobytes()
            cls = xxhash.xxh3_128_digest(place.encode() + b"\0" + raw)
            number = int.from_bytes(cls[:8], "little", signed=True)
            known = seen.get(cls)
            if known is None:
                seen[cls] = [place, number, d, key, bool(ask), False]
            else:
                known[3:] = min(known[3], key), known[4] or bool(ask), True
            for col, x in zip(out, (place, key, number, d, *((None, None, None) if known else (raw, None, bool(ask)))), strict=True):
                col.append(x)
        yield _batch(out, _ROWS)
        if len(seen) > SEEN:
            yield rest()
            seen = {}
    yield rest()


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c**2).sum(axis=1)[None, :] - 2 * x @ c.T + (x**2).sum(axis=1)[:, None]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, 16_000_000 // len(c))
    return np.concatenate([_distances(x[at : at + step], c).argmin(axis=1) for at in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        c[used] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.r_[first, len(x)])[:, None]
    return c


def _grouped(c: np.ndarray, weight: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the centroids, and where its ``groups`` (a power of 2) begin: halved by weight along the widest axis, again and again."""
    parts = [np.arange(len(c))]
    while len(parts) < groups:
        halves = []
        for p in parts:
            if len(p) > 1:
                axis = np.linalg.svd(c[p] - c[p].mean(axis=0), full_matrices=False)[2][0]
                p = p[np.argsort(c[p] @ axis, kind="stable")]
                total = np.cumsum(weight[p])
                at = int(np.clip(np.searchsorted(total, total[-1] / 2) + 1, 1, len(p) - 1))
                halves += [p[:at], p[at:]]
            else:
                halves += [p, p[:0]]
        parts = halves
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def visit(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` cells of each query by summed distance, from its distances to both sets of centroids.

    The multi-sequence walk: per rank of the first list the heap holds the next untaken rank of
    the second; the least sum is taken and its successor put in. All queries of the batch take
    their steps together.
    """
    k = first.shape[1]
    n = min(n, k * second.shape[1])
    o1, o2 = np.argsort(first, axis=1), np.argsort(second, axis=1)
    d1, d2 = np.take_along_axis(first, o1, 1), np.take_along_axis(second, o2, 1)
    d2 = np.concatenate([d2, np.full((len(d2), 1), np.inf, d2.dtype)], axis=1)
    heap = d1[:, : min(n, k)] + d2[:, :1]
    taken = np.zeros(heap.shape, np.int64)
    rows = np.arange(len(first))
    cells = np.empty((len(first), n), np.int64)
    for step in range(n):
        i = heap.argmin(axis=1)
        j = taken[rows, i]
        cells[:, step] = o1[rows, i] * second.shape[1] + o2[rows, j]
        taken[rows, i] = j + 1
        heap[rows, i] = d1[rows, i] + d2[rows, j + 1]
    return cells


class Index:
    """The centroids of one collection, the blocks of its cells, and into how many parts and task slices each block goes."""

    def __init__(self, c1: np.ndarray, c2: np.ndarray, ends1: np.ndarray, ends2: np.ndarray, parts: np.ndarray, slices: np.ndarray):
        self.c1, self.c2, self.ends1, self.ends2, self.parts, self.slices = c1, c2, ends1, ends2, parts, slices
        self.base = np.cumsum(parts) - parts  # the number of a block's first part
        self.group1 = np.repeat(np.arange(len(ends1) - 1), np.diff(ends1))
        self.group2 = np.repeat(np.arange(len(ends2) - 1), np.diff(ends2))
        self.narrow = int(np.diff(ends1).max()) * int(np.diff(ends2).max()) <= 1 << 16

    @classmethod
    def fit(cls, x: np.ndarray, n: int, probes: int) -> Index:
        """On a sample ``x`` of ``n`` vectors."""
        k = max(2, round((n / CELL) ** 0.5))
        half, rng = x.shape[1] // 2, np.random.default_rng(5)
        groups = 2 ** max(0, round(np.log2((n / SHARD) ** 0.5)))
        halves = []
        for part in (x[:, :half], x[:, half:]):
            c = _centroids(part, k, rng)
            order, ends = _grouped(c, np.bincount(_nearest(part, c), minlength=k) + 1e-9, min(groups, k))
            halves.append((c[order], ends))
        (c1, ends1), (c2, ends2) = halves
        one = np.ones((len(ends1) - 1) * (len(ends2) - 1), np.int32)
        own = cls(c1, c2, ends1, ends2, one, one)
        load = np.bincount(own.blocks(own.cells(x)), minlength=len(one)) * (n / len(x))
        parts = np.maximum(1, np.ceil(load / SHARD)).astype(np.int32)
        touched = np.zeros(len(one))
        for at in range(0, min(len(x), SAMPLE), 1024):
            for reached in own.blocks(own.visited(x[at : min(at + 1024, SAMPLE)], probes)):
                touched[np.unique(reached)] += n / min(len(x), SAMPLE)
        return cls(c1, c2, ends1, ends2, parts, np.maximum(1, np.ceil(touched / QUERIES)).astype(np.int32))

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        return _nearest(x[:, :half], self.c1) * len(self.c2) + _nearest(x[:, half:], self.c2)

    def visited(self, x: np.ndarray, probes: int) -> np.ndarray:
        half = x.shape[1] // 2
        return visit(_distances(x[:, :half], self.c1), _distances(x[:, half:], self.c2), probes)

    def blocks(self, cells: np.ndarray) -> np.ndarray:
        return self.group1[cells // len(self.c2)] * (len(self.ends2) - 1) + self.group2[cells % len(self.c2)]

    def inside(self, cells: np.ndarray) -> np.ndarray:
        """The number of each cell inside its block."""
        i, j = cells // len(self.c2), cells % len(self.c2)
        g = self.group2[j]
        return (i - self.ends1[self.group1[i]]) * (self.ends2[g + 1] - self.ends2[g]) + j - self.ends2[g]

    def to_bytes(self) -> bytes:
        head = np.array([len(self.c1), self.c1.shape[1], self.c2.shape[1], len(self.ends1), len(self.ends2)], np.int32)
        return b"".join(a.tobytes() for a in (head, self.c1.astype(np.float32), self.c2.astype(np.float32), *(x.astype(np.int32) for x in (self.ends1, self.ends2, self.parts, self.slices))))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        k, a, b, m, n = (int(x) for x in np.frombuffer(raw, np.int32, 5))
        at, out, blocks = 20, [], (m - 1) * (n - 1)
        for shape, kind in (((k, a), np.float32), ((k, b), np.float32), ((m,), np.int32), ((n,), np.int32), ((blocks,), np.int32), ((blocks,), np.int32)):
            size = int(np.prod(shape))
            out.append(np.frombuffer(raw, kind, size, at).reshape(shape))
            at += 4 * size
        return cls(*out)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def _fit(probes: int):  # noqa: ANN202
    def fit(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        x = _unit(_matrix(table.column("vec"), dims))
        index = Index.fit(x, max(len(x), table.column("n")[0].as_py()), probes)
        return pa.table({"collection": [table.column("collection")[0].as_py()], "index": pa.array([index.to_bytes()], pa.binary())})

    return fit


_UNITS = "collection string, shard int, slice int, role int, key long, cell int, dims int, vec binary, visits binary, least string"


def _assign(probes: int):  # noqa: ANN202
    def assign(rows: pa.Table, index: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _UNITS.split(", ")]
        if rows.num_rows and index.num_rows:
            place, dims = rows.column("collection")[0].as_py(), rows.column("dims")[0].as_py()
            idx = Index.from_bytes(index.column("index")[0].as_py())
            classes: dict[int, list] = {}
            for key, raw, least, ask in zip(*(rows.column(c).to_pylist() for c in ("key", "vec", "least", "asks")), strict=True):
                known = classes.setdefault(key, [raw, least, ask])
                known[:] = known[0] or raw, min(known[1], least), known[2] or ask
            every = list(classes.items())
            for at in range(0, len(every), 2048):
                some = every[at : at + 2048]
                x = _unit(np.frombuffer(b"".join(c[0] for _, c in some), np.float32).reshape(-1, dims))
                cells = idx.cells(x)
                blocks, inside = idx.blocks(cells), idx.inside(cells)
                spread = np.array([k for k, _ in some], np.int64).view(np.uint64) >> np.uint64(8)
                asking = np.array([i for i, (_, c) in enumerate(some) if c[2]], np.int64)
                walks = {}
                if len(asking):
                    visited = idx.visited(x[asking], probes)
                    to, cell = idx.blocks(visited), idx.inside(visited).astype(np.uint16 if idx.narrow else np.uint32)
                    for q, i in enumerate(asking.tolist()):
                        walks[i] = {int(b): bytes([cell.itemsize]) + cell[q][to[q] == b].tobytes() for b in np.unique(to[q])}
                for i, (key, (raw, least, _)) in enumerate(some):
                    mine, walk, number = int(blocks[i]), walks.get(i, {}), int(spread[i])
                    home = int(idx.base[mine]) + number % int(idx.parts[mine])
                    turn = number % int(idx.slices[mine])
                    # The vector as an entry, in every slice; in one of them it asks too, if its walk comes by.
                    sent = [(home, s, 1 if s == turn and mine in walk else 0, walk.get(mine) if s == turn else None, least) for s in range(int(idx.slices[mine]))]
                    for b, visits in walk.items():
                        shards = range(int(idx.base[b]), int(idx.base[b] + idx.parts[b]))
                        sent += [(s, number % int(idx.slices[b]), 2, visits, None) for s in shards if s != home]
                    for shard, part, role, visits, own in sent:
                        for col, v in zip(out, (place, shard, part, role, key, int(inside[i]), dims, raw, visits, own), strict=True):
                            col.append(v)
        return pa.Table.from_batches([_batch(out, _UNITS)])

    return assign


def _search(k: int, least: float):  # noqa: ANN202
    def of_shard(entries: dict[str, np.ndarray], queries: dict[str, np.ndarray]) -> tuple[list, list, list]:
        """Reranked neighbours (query key, key, cosine) inside one part of a block, ``k`` at most; equal ones by smaller id."""
        limit, e, wide, keys, ids = (entries[c] for c in ("ends", "unit", "wide", "keys", "ids"))
        spare = max(1e-5, 1e-7 * e.shape[1])  # the last bits of single precision must not decide who is among the first k
        a, b, sims = [], [], []
        for at in range(0, len(queries["keys"]), 512):
            q = queries["wide"][at : at + 512]
            length = np.linalg.norm(q, axis=1)
            near = (q / length[:, None]).astype(np.float32)
            for i, visits in enumerate(queries["visits"][at : at + 512]):
                cells = np.frombuffer(visits, np.uint16 if visits[0] == 2 else np.uint32, offset=1).astype(np.int64)
                cells = cells[cells < len(limit) - 1]
                begin, size = limit[cells], limit[cells + 1] - limit[cells]
                some = size > 0
                begin, size = begin[some], size[some]
                total = int(size.sum())
                if not total:
                    continue
                found = np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)
                close = e[found] @ near[i]
                bound = least - spare
                if total > k + 1:  # with the query itself, k + 1
                    bound = max(bound, float(np.partition(close, total - k - 1)[total - k - 1]) - 2 * spare)
                chosen = found[close >= bound]
                own = queries["keys"][at + i]
                chosen = chosen[keys[chosen] != own]
                if not len(chosen):
                    continue
                w = wide[chosen].astype(np.float64)
                exact = np.round((w * q[i]).sum(axis=1) / (np.sqrt((w * w).sum(axis=1)) * length[i]), 12)
                good = np.argsort(-exact, kind="stable")
                if len(good) > k and exact[good[k]] == exact[good[k - 1]]:
                    good = np.lexsort((ids[chosen].astype("U"), -exact))  # code points, as bytes are ordered
                good = good[:k]
                good = good[exact[good] >= least]
                a.append(np.full(len(good), own))
                b.append(keys[chosen[good]])
                sims.append(exact[good])
        return a, b, sims

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by shard and role: vectors of the shard come before foreign queries."""
        place: tuple | None = None
        parts: list[dict] = []
        entries: dict | None = None

        def ready() -> dict:
            wide, cells, keys, ids = (np.concatenate([p[c] for p in parts]) for c in ("wide", "cells", "keys", "ids"))
            order = np.argsort(cells, kind="stable")
            ends = np.searchsorted(cells[order], np.arange(int(cells.max()) + 2))
            return {"wide": wide[order], "unit": _unit(wide[order]), "keys": keys[order], "ids": ids[order], "ends": ends}

        def answer(name: str, found: tuple[list, list, list]) -> Iterator[pa.RecordBatch]:
            if found[0]:
                a, b, s = (np.concatenate(x) for x in found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(a)), pa.array(a), pa.array(b), pa.array(s)], names=["collection", "a", "b", "similarity"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal entries
            if parts and entries is None:
                entries = ready()
                for p in parts:
                    both = np.flatnonzero(p["roles"] == 1)
                    asked = {"wide": p["wide"][both].astype(np.float64), "keys": p["keys"][both], "visits": [p["visits"][i] for i in both]}
                    yield from answer(place[0], of_shard(entries, asked))

        for batch in batches:
            if not batch.num_rows:
                continue
            names, shards, slices, roles = (batch.column(c).to_pylist() for c in ("collection", "shard", "slice", "role"))
            marks = list(zip(names, shards, slices, [r == 2 for r in roles], strict=True))
            starts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
            for begin, end in zip(starts, [*starts[1:], len(marks)], strict=True):
                *where, foreign = marks[begin]
                piece = batch.slice(begin, end - begin)
                part = {"wide": _matrix(piece.column("vec"), piece.column("dims")[0].as_py()), "keys": piece.column("key").to_numpy(), "cells": piece.column("cell").to_numpy(), "roles": piece.column("role").to_numpy(), "visits": piece.column("visits").to_pylist(), "ids": np.array(piece.column("least").to_pylist(), object)}
                if tuple(where) != place:
                    yield from close()
                    place, parts, entries = tuple(where), [], None
                if not foreign:
                    parts.append(part)
                    continue
                yield from close()
                if entries is not None:
                    yield from answer(place[0], of_shard(entries, {"wide": part["wide"].astype(np.float64), "keys": part["keys"], "visits": part["visits"]}))
        yield from close()

    return search


def nearest(vectors: DataFrame, spaces: DataFrame, k: int = 5, least: float = -2.0, probes: int = PROBES, asks: Column | None = None) -> DataFrame:
    """(collection, chunk_id, neighbour, similarity, place): the ``k`` most similar of each asking vector.

    ``vectors``: (chunk_id, collection, vector); ``spaces``: (collection, dims), one row each.
    Null, zero and non-finite vectors, vectors of another length than the collection's, null
    ids and collections that ``spaces`` lacks take no part. Rows that repeat an id and its
    vector count once. Equal vectors are one class: indexed once, and every member finds the
    others. Equal similarities (to twelve digits) go by smaller id. ``least`` leaves out smaller
    similarities; ``probes`` is the number of cells visited, of about CELL vectors whatever the
    size; ``asks`` restricts the queries (over chunk_id), never what is searched.
    """
    known = vectors.select("chunk_id", "collection", "vector").join(spaces.select("collection", "dims"), "collection")
    known = known.select("chunk_id", "collection", F.col("vector").cast("array<float>").alias("vector"), F.col("dims").cast("int").alias("dims"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks"))
    usable = keep(known.mapInArrow(_usable, _ROWS), "vectors")
    ids = usable.where("chunk_id is not null").select("collection", "key", "chunk_id").distinct()
    sizes = usable.where("vec is not null").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.greatest(F.lit(SAMPLE), (PER_CENTROID * F.sqrt(F.col("n") / CELL)).cast("long"))
    sampled = usable.where("vec is not null").join(sizes, "collection").where(F.pmod(F.xxhash64("key"), F.col("n")) < wanted)
    index = keep(sampled.select("collection", "dims", "vec", "n").groupBy("collection").applyInArrow(_fit(probes), "collection string, index binary"), "multi-index")
    salts = sizes.withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int")).select("collection", "salts")
    classes = usable.where("vec is not null or least is not null").withColumn("least", F.coalesce("least", "chunk_id")).join(salts, "collection").withColumn("salt", F.pmod("key", F.col("salts")).cast("int")).select("collection", "salt", "key", "dims", "vec", "least", "asks")
    spread = index.join(salts, "collection").select("collection", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "index")
    units = classes.groupBy("collection", "salt").cogroup(spread.groupBy("collection", "salt")).applyInArrow(_assign(probes), _UNITS)
    where = ["collection", "shard", "slice"]
    found = units.repartition(*where).sortWithinPartitions(*where, "role").mapInArrow(_search(k, least), "collection string, a long, b long, similarity double")
    found = keep(found, "neighbours")
    first = Window.partitionBy("collection", "key").orderBy("chunk_id")
    top = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    several = top.where("r = 2").select("collection", "key")
    asked = ids.where(asks) if asks is not None else ids
    left = asked.select("collection", F.col("key").alias("a"), "chunk_id")
    right = top.select("collection", F.col("key").alias("b"), F.col("chunk_id").alias("neighbour"))
    across = found.join(left, ["collection", "a"]).join(right, ["collection", "b"]).select("collection", "chunk_id", "neighbour", "similarity")
    copied = asked.join(several, ["collection", "key"]).join(top.select("collection", "key", F.col("chunk_id").alias("neighbour")), ["collection", "key"])
    copied = copied.where("chunk_id != neighbour").select("collection", "chunk_id", "neighbour", F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("collection", "chunk_id").orderBy(F.desc("similarity"), "neighbour")
    return across.unionByName(copied).where(F.col("similarity") >= least).dropDuplicates(["collection", "chunk_id", "neighbour"]).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "collections").groupBy(F.col("name").alias("collection")).agg(F.max("dimensions").alias("dims"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(read(spark, sf_dir, "vectors"), spaces(spark, sf_dir), least=0.9)
    return found.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar of every vector whose chunk number is divisible by 20, against all vectors."""
    asks = F.substring_index("chunk_id", ":", -1).try_cast("long") % 20 == 0
    found = nearest(read(spark, sf_dir, "vectors"), spaces(spark, sf_dir), probes=WIDE, asks=asks)
    return found.select("collection", "chunk_id", "place", "neighbour", F.round("similarity", 6).alias("similarity"))
