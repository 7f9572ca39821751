from __future__ import annotations

import numpy as np
import pytest

from corpusmill.operators import search, snapshots
from corpusmill.plans import queries


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Three collections of one space, one alone in its space, and an empty one of the first space."""
    root = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(2)
    rows = [(f"{c}{i:02d}:{i}", c, rng.normal(size=n).round(1).tolist()) for c, n, m in (("a", 3, 45), ("b", 3, 30), ("c", 3, 25), ("x", 4, 22)) for i in range(m)]
    rows += [("c98:98", "c", [0.0, 0.0, 0.0]), ("b99:99", "b", rows[0][2])]
    spark.createDataFrame(rows, "chunk_id string, collection string, vector array<float>").write.parquet(f"{root}/vectors.parquet")
    spaces = [("a", "m", 3), ("b", "m", 3), ("c", "m", 3), ("empty", "m", 3), ("x", "m", 4)]
    spark.createDataFrame(spaces, "name string, model string, dimensions int").write.parquet(f"{root}/collections.parquet")
    return root, [(i, c, np.array(v, np.float32).astype(float)) for i, c, v in rows]


def cosine(a, b):
    size = np.sqrt(a @ a) * np.sqrt(b @ b)
    return round(float(a @ b / size), 12) if size > 0 else 0.0


def best(v, entries, k):
    return sorted(((-cosine(v, w), i, c) for i, c, w in entries), key=lambda r: r[:2])[:k]


def test_similarity_join_asks_every_collection_against_every_other(spark, place):
    root, rows = place
    want = {(i, c, None if c == "x" else "empty", None, None, None) for i, c, _ in rows}
    for i, c, v in rows:
        for target in set("abc") - {c} if c != "x" else ():
            want |= {(i, c, target, j, round(-s, 6), pos) for pos, (s, j, _) in enumerate(best(v, [r for r in rows if r[1] == target], 3), 1)}
    got = queries.similarity_join_all(spark, root).select("query_id", "collection", "target", "chunk_id", "score", "pos").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_cross_collection_topk_asks_for_every_collection(spark, place):
    root, rows = place
    asked = [r for r in rows if int(r[0].split(":")[1]) % 20 == 0]
    assert {c for _, c, _ in asked} == {"a", "b", "c", "x"}
    want = {(i, j, round(-s, 6), d, pos) for i, c, v in asked for pos, (s, j, d) in enumerate(best(v, [r for r in rows if (r[1] == "x") == (c == "x")], queries.K), 1)}
    got = queries.cross_collection_topk_all(spark, root).select("query_id", "chunk_id", "score", "collection", "pos").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("n", [2, 3, 150, 3000])
def test_best_of_against_a_full_sort(n):
    rng = np.random.default_rng(n)
    m = rng.integers(-2, 3, (n, 5)).astype(float)  # many ties, some zero vectors
    asked = np.concatenate([rng.integers(-2, 3, (80, 5)), np.zeros((1, 5))]).astype(float)
    rank = rng.permutation(n)
    i, j, score = search._best_of(asked, m, rank, 3)
    got = {x: list(zip(-score[i == x], rank[j[i == x]], strict=True)) for x in range(len(asked))}
    assert all(got[x] == sorted((-cosine(asked[x], m[y]), rank[y]) for y in range(n))[:3] for x in range(len(asked)))


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Seven runs: collection k in all but 3, of which 5 broke off; collection late only in 6 and 7."""
    root = str(tmp_path_factory.mktemp("runs"))
    complete = [(n, "k", "aborted" if n == 5 else "complete") for n in (1, 2, 4, 5, 6, 7)] + [(6, "late", "complete"), (7, "late", "complete")]
    spark.createDataFrame(complete, "snapshot_no int, collection string, status string").write.parquet(f"{root}/snapshot_runs.parquet")
    held = {"same": "1 1 1 9 1 1", "gone": "1 1 - - 1 -", "new": "- 1 2 - 2 3", "dark": "1 ? 1 - ? 2", "first": "? ? 5 - 5 5"}
    rows = [(n, "k", f"file:///{u}", None if h == "?" else h * 64, f"f{h}") for u, of in held.items() for n, h in zip((1, 2, 4, 5, 6, 7), of.split(), strict=True) if h != "-"]
    rows += [(6, "late", "file:///a", "1" * 64, "x"), (7, "late", "file:///a", "1" * 64, "y"), (7, "late", "file://localhost/b", "1" * 64, "x")]
    snaps = spark.createDataFrame(rows, "snapshot_no int, collection string, source_uri string, hash string, fingerprint string")
    snaps.selectExpr("*", "timestamp'2025-01-01 00:00:00' as loaded_at").write.parquet(f"{root}/doc_snapshots.parquet")
    return root


def test_diff_of_every_run(spark, runs):
    got = sorted((r.snapshot_no, r.collection, r.source_uri[8:], r.status) for r in queries.collection_diff_all(spark, runs).collect())
    assert got == [(2, "k", "new", "added"), (4, "k", "gone", "removed"), (4, "k", "new", "changed"), (6, "k", "gone", "added"), (7, "k", "dark", "changed"), (7, "k", "gone", "removed"), (7, "k", "new", "changed"), (7, "late", "b", "added")]


def test_outcomes_of_every_run(spark, runs):
    got = {(r.snapshot_no, r.collection, r.outcome): r.documents for r in queries.ingest_outcomes_all(spark, runs).collect()}
    assert got[(7, "late", "refreshed")] == got[(7, "late", "new")] == 1 and got[(7, "k", "changed")] == 2 and got[(7, "k", "unchanged")] == 2
    assert {n for n, c, _ in got if c == "k"} == {2, 4, 6, 7} and {n for n, c, _ in got if c == "late"} == {7}


def test_diff_of_every_run_is_what_the_snapshot_index_finds(spark, sf):
    a, b = queries.collection_diff_all(spark, sf), snapshots.p3_found(spark, sf)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and b.count()
