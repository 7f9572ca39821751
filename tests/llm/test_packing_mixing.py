from __future__ import annotations

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm.mixing import budgets, fit_counts, mix, source_key, subset_sum
from corpusmill.llm.packing import best_fit, improve, pack
from corpusmill.llm.tokens import token_counts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 80))
def test_local_search_keeps_items_and_never_adds_a_container(sizes, capacity):
    x = np.array(sizes, np.int64)
    first = best_fit(x, capacity)
    better = improve([b[:] for b in first], x, capacity)
    assert sorted(i for b in better for i in b) == list(range(len(sizes)))
    assert all(x[b].sum() <= capacity for b in better) and len(better) <= len(first)


def test_exchanges_empty_a_container():
    sizes = np.array([5, 4, 4, 3, 2, 2])  # 10 + 10 exactly, in two containers
    bins = improve([[0, 1], [2, 3], [4, 5]], sizes, 10)  # only exchanges can do it
    assert len(bins) == 2


def test_two_for_one_with_very_many_documents():
    # 5 of 6 containers are full but for 2; only two of the last container's ones fit each.
    sizes = np.array([98] * 5 + [1] * 10)
    bins = improve([[i] for i in range(5)] + [list(range(5, 15))], sizes, 100)
    assert len(bins) == 5
    sizes = np.array([60, 35, 55, 40, 7, 6, 5, 4] + [1] * 88)
    bins = improve([[0, 1], [2, 3], [4, 5, 6, 7, *range(8, 86)], list(range(86, 96))], sizes, 100)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(96))


def test_every_trade_raises_the_squared_fill():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 60, 60)
        bins = [list(range(i, 60, 30)) for i in range(30)]
        bins = [b for b in bins if sizes[b].sum() <= 100]
        after = improve([b[:] for b in bins], sizes, 100)
        squares = lambda x: sum(int(sizes[b].sum()) ** 2 for b in x)
        assert squares(after) >= squares(bins) and sorted(i for b in after for i in b) == sorted(i for b in bins for i in b)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 7, 100, 333, 1000, 2048, 5000]), "x") for i in range(3000)] + [(9000, None, "x"), (9001, 4096, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container string")
    out = pack(df, 2048, group=500).collect()
    whole = Counter()
    for r in out:
        whole[r.doc_id] += r.tokens
    assert {i: n or 0 for i, n, _ in rows} == dict(whole)
    fill = Counter()
    for r in out:
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 2048 and all(r.fill == fill[r.container] for r in out)
    pieces = Counter(r.doc_id for r in out)
    assert all(pieces[i] == max(1, -(-(n or 0) // 2048)) for i, n, _ in rows)
    assert len(fill) <= 1.01 * sum(n or 0 for _, n, _ in rows) / 2048 + 1
    assert pack(df.limit(0)).count() == 0
    assert [r.tokens for r in pack(df.where("n_tokens = 0").limit(2)).collect()] == [0, 0]


def test_token_counts(spark):
    rows = [(1, "hello world", "a"), (2, None, "b"), (3, "", "c"), (4, "x" * 200_000, "d")]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), carry=()).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda t: t[0]), st.integers(0, 40))
def test_subset_sum_is_best(items, budget):
    lengths, counts = [a for a, _ in items], [b for _, b in items]
    chosen = subset_sum(lengths, counts, budget)
    assert all(0 <= x <= c for x, c in zip(chosen, counts, strict=True))
    best = max(s for s in (sum(x * n for x, n in zip(xs, lengths, strict=True)) for xs in product(*(range(c + 1) for c in counts))) if s <= budget)
    assert sum(x * n for x, n in zip(chosen, lengths, strict=True)) == best


def test_fit_counts_and_budgets():
    lengths, counts = np.array([3, 10, 700]), np.array([5000, 400, 900])
    took = fit_counts(lengths, counts, 123_457)
    assert (took <= counts).all() and (took * lengths).sum() == 123_457
    assert budgets({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 10}, 500) == {"a": 490, "b": 10, "c": 0}
    assert budgets({}, {}, 5) == {}


def test_the_draw_prefers_no_length():
    rng = np.random.default_rng(0)
    lengths = np.unique(rng.integers(1, 4000, 1300))
    counts = rng.integers(1, 3, len(lengths))
    total, mean = int((lengths * counts).sum()), (lengths * counts).sum() / counts.sum()
    for seed in range(5):
        took = fit_counts(lengths, counts, total // 2, seed)
        assert (took * lengths).sum() == total // 2 and (took <= counts).all()
        assert abs((took * lengths).sum() / took.sum() - mean) < 0.02 * mean
        for part in np.array_split(np.arange(len(lengths)), 10):
            assert abs(took[part].sum() - counts[part].sum() / 2) < 0.12 * counts[part].sum()
    odd = fit_counts(np.array([70_000, 90_000]), np.array([3, 3]), 230_000)  # far beyond any window
    assert (odd * np.array([70_000, 90_000])).sum() == 230_000


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Big", "big ", " BIG"]), rng.choice([3, 5, 5, 90])) for i in range(2000)]
    rows += [(5000 + i, "tiny_one", 7) for i in range(3)] + [(7000, None, 9), (7001, "other", 9), (7002, "big", 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, n_tokens long, times int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny-one", 0.3, 4), ("gone", 0.2, None)], "source string, target_weight double, max_repeats int")
    used, shares = mix(df, targets, total=20_000)
    got = used.collect()
    assert len(got) == len({r.doc_id for r in got}) and {r.source for r in got} == {"big", "tiny-one"}
    assert all(r.times == 4 for r in got if r.source == "tiny-one") and all(r.times == 1 for r in got if r.source == "big")
    by = {r.source: r for r in shares.collect()}
    assert by["tiny-one"].mixed_tokens == 84 and by["big"].mixed_tokens == 20_000 - 84 == sum(r.n_tokens for r in got if r.source == "big") and by["gone"].share == 0
    assert used.exceptAll(mix(df, targets, total=20_000)[0]).count() == 0  # the same again
    assert mix(df.limit(0), targets)[0].count() == 0 and mix(df, targets.limit(0))[0].count() == 0
    key = spark.createDataFrame([(" Wiki__Core-",), ("",), (None,)], "s string").select(source_key(F.col("s"))).collect()
    assert [r[0] for r in key] == ["wiki-core", None, None]


@pytest.mark.parametrize("run", [2, 10_000])
def test_runs_rank_alike(spark, monkeypatch, run):
    from corpusmill.llm import mixing

    monkeypatch.setattr(mixing, "RUN", run)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(5).cast("long").alias("n_tokens"))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    used = mixing.mix(df, targets, total=500)[0]
    assert used.count() == 100
    assert sorted(r.doc_id for r in used.collect())[:3] == sorted(r.doc_id for r in df.orderBy(F.xxhash64(F.lit(mixing.SEED), "doc_id")).limit(100).collect())[:3]
