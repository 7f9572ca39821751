from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusmill.llm.capping import Cap, best_first, nested_caps

SCHEMA = "q long, source string, folder string, id string, score double, _n int, _part string, dropped_by string"


def brute(rows, caps):
    def key(r):
        bad = r[4] is None or r[4] != r[4]
        return (bad, 0 if bad else -r[4], r[3])

    alive, dropped = list(rows), {}
    for number, (cols, most) in enumerate(caps):
        groups = {}
        for r in sorted(alive, key=key):
            groups.setdefault(tuple(r[c] for c in cols), []).append(r)
        alive = []
        for g in groups.values():
            alive += g[:most]
            dropped |= {r[3]: number for r in g[most:]}
    return dropped


def test_nested_caps_equal_brute_force_with_a_hot_group(spark):
    rng = random.Random(1)
    scores = [None, float("nan"), 0.1, 0.5, 0.5, 0.9]
    rows = [(rng.choice([1, None]), rng.choice(["hot", "hot", "hot", "a", None]), rng.choice(["x", "y"]), f"c{i:04d}", rng.choice(scores), 7, "p", "old") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = nested_caps(df, [Cap(("q", "source", "folder"), 3), Cap(("q", "folder"), 5)], best_first("score", "id"), F.col("id"), salts=4)
    got = {r.id: r.dropped_by for r in out.where("dropped_by is not null").collect()}
    assert got == brute(rows, [((0, 1, 2), 3), ((0, 2), 5)])
    assert {"_n", "_part"} <= set(out.columns)  # the input's own columns stay
    assert out.count() == len(rows)


def test_share_of_a_list(spark):
    rows = [(1, "a", "x", f"c{i}", float(i), 0, "", "") for i in range(8)] + [(1, "b", "x", "d0", 1.0, 0, "", ""), (1, "b", "x", "d1", 2.0, 0, "", "")]
    out = nested_caps(spark.createDataFrame(rows, SCHEMA), [Cap(("q", "source"), share=0.3, within=("q",))], best_first("score", "id"), F.col("id"))
    assert sorted(r.id for r in out.where("dropped_by is null").collect()) == ["c5", "c6", "c7", "d0", "d1"]


def test_empty_table(spark):
    assert nested_caps(spark.createDataFrame([], SCHEMA), [Cap(("q",), 1)], best_first("score", "id"), F.col("id")).count() == 0


def test_share_of_a_group_that_lies_in_many_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, None]), rng.choice(["hot"] * 8 + ["a", None]), "x", f"c{i:05d}", rng.choice([None, float("nan"), *(j / 40 for j in range(40))]), 7, "p", "old") for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    caps = [Cap(("q", "source"), 700), Cap(("q", "source"), share=0.1, within=("q",)), Cap(("q",), share=0.12)]
    out = nested_caps(df, caps, best_first("score", "id"), F.col("id"), salts=4)
    got = {r.id: r.dropped_by for r in out.where("dropped_by is not null").collect()}

    def key(r):
        bad = r[4] is None or r[4] != r[4]
        return (bad, 0 if bad else -r[4], r[3])

    dropped = {}
    for number, (cols, limit) in enumerate([((0, 1), lambda q: 700), ((0, 1), lambda q: int(0.1 * sum(r[0] == q for r in rows))), ((0,), lambda q: int(0.12 * len(rows)))]):
        groups = {}
        for r in sorted((r for r in rows if r[3] not in dropped), key=key):
            groups.setdefault(tuple(r[c] for c in cols), []).append(r)
        dropped |= {r[3]: number for k, g in groups.items() for r in g[limit(k[0]) :]}
    assert got == dropped and out.count() == len(rows) and set(dropped.values()) == {0, 1, 2}
