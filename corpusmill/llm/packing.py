"""Filling containers of fixed capacity by swap-based local search.

Documents are spread over groups by hash. A group starts from best fit by decreasing size; then
its containers, the emptiest first, give documents away, moving one, or exchanging one for one or
two for one, always by the trade with any other container that raises the sum of squared fills
most, until they are empty or nothing helps. What stays underfull in any group goes to the next
round, where the leftovers of many groups meet.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.tokens import VOCABULARY, token_counts
from corpusmill.tables import keep, read

CAPACITY = 2048
GROUP = 8192  # documents packed together
ROUNDS = 4
FULL = 0.995  # containers below go to the next round
MOST_TASKS = 20_000


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit by decreasing size; ties by position."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > size:
            insort(free, (room - size, b))
    return bins


class _Room:
    """The underfull containers of a group as flat arrays: a container's documents, and one place of size 0 that stands for a plain move."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
        self.item = np.r_[np.concatenate([np.asarray(b, np.int64) for b in bins]), np.full(len(bins), -1)]
        self.owner = np.r_[np.repeat(np.arange(len(bins)), [len(b) for b in bins]), np.arange(len(bins))]
        self.size = np.where(self.item >= 0, sizes[self.item], 0)
        self.place = {int(x): i for i, x in enumerate(self.item) if x >= 0}

    def best(self, e: int) -> tuple[list[int], int] | None:
        """The trade of container ``e`` that raises the squared fill most: documents given, and the place of what comes back.

        A container's documents have few distinct sizes (their sum is bounded), and so have its
        pairs; against each place of the others only the largest that still fits can be best.
        """
        own = np.array(self.bins[e], np.int64)
        mine, first = np.unique(self.sizes[own], return_index=True)
        counts = np.bincount(np.searchsorted(mine, self.sizes[own]))
        x, y = np.triu_indices(len(mine))
        twice = (x != y) | (counts[x] > 1)
        x, y = x[twice], y[twice]
        pairs, at = np.unique(mine[x] + mine[y], return_index=True)
        room = self.capacity - self.fill[self.owner] + self.size
        ahead = self.fill[self.owner] - self.fill[e]
        there = (self.owner != e) & (self.fill[self.owner] > 0)
        best, found = 0, None
        for values, double in ((mine, False), (pairs, True)):
            if not len(values):
                continue
            most = np.searchsorted(values, room, "right") - 1
            moved = values[np.maximum(most, 0)] - self.size
            gain = np.where(there & (most >= 0) & (moved > 0) & (self.size > 0 if double else True), moved * (ahead + moved), 0)
            j = int(gain.argmax())
            if gain[j] > best:
                best = int(gain[j])
                v = int(most[j])
                if double:
                    a, b = int(x[at[v]]), int(y[at[v]])
                    same = np.flatnonzero(self.sizes[own] == mine[a])
                    given = [int(own[same[0]]), int(own[same[1]] if a == b else own[first[b]])]
                else:
                    given = [int(own[first[v]])]
                found = (given, j)
        return found

    def trade(self, e: int, given: list[int], j: int) -> None:
        b, back = int(self.owner[j]), int(self.item[j])
        for x in given:
            self.owner[self.place[x]] = b
            self.bins[e].remove(x)
            self.bins[b].append(x)
        if back >= 0:
            self.owner[j] = e
            self.bins[b].remove(back)
            self.bins[e].append(back)
        moved = int(self.sizes[given].sum()) - int(self.size[j])
        self.fill[e] -= moved
        self.fill[b] += moved


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over underfull containers, to the end; empties what it can, never adds one.

    Every trade raises the sum of squared fills, which is bounded, so the search ends. A
    container that is full has no room, and no trade with it can raise the sum.
    """
    fills = [int(sizes[b].sum()) for b in bins]
    done = [b for b, f in zip(bins, fills, strict=True) if f >= capacity]
    under = [b for b, f in zip(bins, fills, strict=True) if f < capacity]
    if len(under) < 2:
        return done + under
    room, moved = _Room(under, sizes, capacity), True
    while moved:
        moved = False
        for e in np.argsort(room.fill, kind="stable").tolist():
            while 0 < room.fill[e] < capacity and (found := room.best(e)):
                room.trade(e, *found)
                moved = True
    return done + [b for b in room.bins if b]


def _pack(capacity: int, label: str):  # noqa: ANN202
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        sizes = table.column("tokens").to_numpy()
        real = np.flatnonzero(sizes > 0)
        bins = [[int(real[i]) for i in b] for b in improve(best_fit(sizes[real], capacity), sizes[real], capacity)]
        if len(real) < len(sizes):  # documents without a token take no room
            bins = bins or [[]]
            bins[0] = bins[0] + np.flatnonzero(sizes == 0).tolist()
        number, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for n, b in enumerate(bins):
            number[b], fill[b] = n, int(sizes[b].sum())
        group = table.column("grp")[0].as_py()
        return pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "tokens": table.column("tokens"), "container": pa.array([f"{label}-{group}-{n}" for n in number]), "fill": pa.array(fill)})

    return pack


def pack(lengths: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS, full: float = FULL) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container, fill): where every document goes.

    ``lengths``: (doc_id, n_tokens), doc_id unique. A document longer than a container is cut
    every ``capacity`` tokens: its full pieces are containers of their own, the rest is packed
    like any document. No other is cut. Documents without a token are assigned too and take no
    room. Null lengths count 0. An empty table gives an empty result. A group holds about
    ``group`` documents whatever the data.
    """
    sized = lengths.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    whole = (F.col("n") / F.lit(capacity)).cast("long")
    parts = sized.where(F.col("n") > capacity).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)))
    out = parts.select("doc_id", F.col("piece").cast("int").alias("piece"), F.lit(capacity).cast("long").alias("tokens"), F.concat(F.lit("full-"), "doc_id", F.lit("-"), "piece").alias("container"), F.lit(capacity).cast("long").alias("fill"))
    pool = sized.select("doc_id", F.when(F.col("n") > capacity, whole).otherwise(F.lit(0)).cast("int").alias("piece"), F.when(F.col("n") > capacity, F.col("n") % capacity).otherwise(F.col("n")).alias("tokens"), "n")
    pool = pool.where((F.col("tokens") > 0) | (F.col("n") <= capacity)).drop("n")
    count = pool.count()
    for r in range(rounds):
        groups = max(1, -(-count // group))
        grouped = pool.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(groups)).cast("int"))
        # A task for each group whatever its bytes: the work is computing.
        packed = keep(grouped.repartition(min(groups, MOST_TASKS), "grp").groupBy("grp").applyInArrow(_pack(capacity, f"r{r}"), "doc_id long, piece int, tokens long, container string, fill long"), "packed")
        if groups == 1 or r == rounds - 1:
            return _placed(out.unionByName(packed), capacity)
        out = out.unionByName(packed.where(F.col("fill") >= full * capacity))
        pool = packed.where(F.col("fill") < full * capacity).select("doc_id", "piece", "tokens")
        count = pool.count()
        if not count:
            break
    return _placed(out, capacity)


def _placed(df: DataFrame, capacity: int) -> DataFrame:
    return df.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "tokens", "container", "fill")


def document_lengths(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return keep(token_counts(read(spark, sf_dir, "documents"), path=path), "lengths")


def p6_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(document_lengths(spark, sf_dir)).drop("fill")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least number that could do, and the part of all room left unused."""
    placed = pack(document_lengths(spark, sf_dir))
    per = placed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    total = per.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("n").alias("pieces"))
    return total.select("containers", "pieces", "tokens", "fullest", F.ceil(F.col("tokens") / CAPACITY).alias("least_containers"), F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("unused"))
