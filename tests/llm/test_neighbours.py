from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import neighbours
from corpusmill.llm.neighbours import Index, nearest, visit

SCHEMA = "chunk_id string, collection string, vector array<float>, key long, dims string"


def brute(rows, dims, k, least=-2.0):
    by = {}
    for i, c, v in rows:
        if i is None or c not in dims or v is None or len(v) != dims[c]:
            continue
        v = np.array(v, np.float32).astype(float)
        if np.isfinite(v).all() and v.any():
            by.setdefault(c, {})[i] = v
    out = {}
    for c, m in by.items():
        ids = sorted(m)
        x = np.array([m[i] for i in ids])
        s = np.round(x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None], 9)
        for r, i in enumerate(ids):
            best = sorted((-s[r, j], ids[j]) for j in range(len(ids)) if j != r and s[r, j] >= least)[:k]
            out[c, i] = [b for _, b in best]
    return out


def table(n=300):
    rng = np.random.default_rng(4)
    rows = [(f"v{i:04d}", "a", rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    rows += [(f"w{i:04d}", "b", (np.array(rows[i % 7][2]) + rng.normal(size=8) * 0.05).tolist()) for i in range(40)]
    rows += [(f"copy{i}", "a", rows[0][2]) for i in range(9)] + rows[:3]
    rows += [("null", "a", None), ("zero", "a", [0.0] * 8), ("nan", "a", [float("nan")] * 8), ("short", "a", [1.0]), (None, "a", [1.0] * 8), ("gone", "c", [1.0] * 8), ("only", "d", [1.0] * 8)]
    return rows


def test_all_cells_give_the_exact_answer(spark):
    rows = table()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    spaces = spark.createDataFrame([("a", 8), ("b", 8), ("d", 8)], "collection string, dims int")
    got = {}
    for r in nearest(df, spaces, probes=100_000).orderBy("place").collect():
        got.setdefault((r.collection, r.chunk_id), []).append(r.neighbour)
    assert got == {k: v for k, v in brute(rows, {"a": 8, "b": 8, "d": 8}, 5).items() if v}


def test_few_cells_reach_the_promised_recall_of_near_ones(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 16))
    rows = [(f"v{i:05d}", "a", (base[i % 1200] + (rng.normal(size=16) * 0.1 if i >= 1200 else 0)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "chunk_id string, collection string, vector array<float>")
    spaces = spark.createDataFrame([("a", 16)], "collection string, dims int")
    got = {(r.chunk_id, r.neighbour) for r in nearest(df, spaces, least=0.9).collect()}
    want = {(i, j) for (_, i), near in brute(rows, {"a": 16}, 5, 0.9).items() for j in near}
    assert len(got & want) >= 0.95 * len(want) and not got - want


def crowded():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[:250] = x[0] + rng.normal(size=(250, 8)).astype(np.float32) * 0.01  # one crowded cell
    return x


def test_blocks_parts_and_slices(monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 20)
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    x = neighbours._unit(crowded())
    index = Index.fit(x, 400, 1000)
    assert len(index.parts) > 4 and index.parts.max() > 1 and index.slices.max() > 1
    again = Index.from_bytes(index.to_bytes())
    assert (again.parts == index.parts).all() and (again.slices == index.slices).all() and (again.ends2 == index.ends2).all()
    every = np.arange(len(index.c1) * len(index.c2))
    pairs = set(zip(index.blocks(every).tolist(), index.inside(every).tolist(), strict=True))
    assert len(pairs) == len(every)  # a cell is known by its block and its number there
    assert set(index.blocks(index.cells(x))) <= set(index.blocks(index.visited(x[:1], 10_000)[0]))


def test_centroids_grow_with_the_collection_and_cells_do_not():
    x = neighbours._unit(np.random.default_rng(1).normal(size=(3000, 8)))
    for n in (3000, 300_000, 3_000_000):
        index = Index.fit(x, n, 24)
        assert n / len(index.c1) / len(index.c2) < 1.3 * neighbours.CELL
        assert index.visited(x[:5], 24).shape == (5, 24)


@pytest.mark.parametrize("split", [False, True])
def test_parts_and_slices_change_nothing(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(neighbours, "SHARD", 20)
        monkeypatch.setattr(neighbours, "QUERIES", 30)
        monkeypatch.setattr(neighbours, "SALT_ROWS", 100)
    rows = [(f"v{i:04d}", "a", v.tolist()) for i, v in enumerate(crowded())]
    df = spark.createDataFrame(rows, "chunk_id string, collection string, vector array<float>")
    spaces = spark.createDataFrame([("a", 8)], "collection string, dims int")
    got = {}
    for r in nearest(df, spaces, probes=100_000).orderBy("place").collect():
        got.setdefault((r.collection, r.chunk_id), []).append(r.neighbour)
    assert got == brute(rows, {"a": 8}, 5)


def test_many_equal_similarities_go_by_smaller_id(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8).astype(np.float32)
    rows = [(f"{i:03d}", "a", (base * np.float32(2.0 ** (i % 40 - 20)) * (3 if i >= 40 else 1)).tolist()) for i in range(60)]
    rows += [(f"r{i:03d}", "a", rng.normal(size=8).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "chunk_id string, collection string, vector array<float>")
    spaces = spark.createDataFrame([("a", 8)], "collection string, dims int")
    got = {}
    for r in nearest(df, spaces, probes=100_000).orderBy("place").collect():
        got.setdefault(r.chunk_id, []).append(r.neighbour)
    assert got["030"] == ["000", "001", "002", "003", "004"] and got["002"] == ["000", "001", "003", "004", "005"]


def test_visit_goes_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random((5, 6)), rng.random((5, 7))
    for n in (1, 9, 42, 100):
        cells = visit(a, b, n)
        for q in range(5):
            sums = np.sort((a[q][:, None] + b[q][None]).ravel())[: min(n, 42)]
            got = a[q][cells[q] // 7] + b[q][cells[q] % 7]
            assert np.allclose(got, sums) and len(set(cells[q])) == min(n, 42)


@pytest.mark.parametrize("restricted", [False, True])
def test_empty(spark, restricted):
    spaces = spark.createDataFrame([("a", 8)], "collection string, dims int")
    none = spark.createDataFrame([], SCHEMA)
    assert nearest(none, spaces, asks=F.col("chunk_id") == "v1" if restricted else None).count() == 0
