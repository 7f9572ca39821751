from __future__ import annotations

import random
from itertools import combinations

import pytest

from corpusmill.errors import UsageError
from corpusmill.llm import neardup
from corpusmill.llm.neardup import NearDuplicates, connected, words

NAMES = [f"w{i}" for i in range(4000)]


def texts(seed=3, clusters=40, size=4):
    rng = random.Random(seed)
    out = []
    for c in range(clusters):
        base = rng.sample(NAMES, 60)
        for k in range(size):
            own = base[:]
            for i in rng.sample(range(60), rng.randint(0, 9)):
                own[i] = rng.choice(NAMES)
            rng.shuffle(own)
            out.append((f"{c:03d}-{k}", " ".join(own)))
    return out


def brute(rows, least=0.6):
    sets = [(i, words(t)) for i, t in rows if i is not None and words(t)]
    return {(min(a, b), max(a, b)) for (a, x), (b, y) in combinations(sets, 2) if a != b and len(x & y) >= least * len(x | y)}


def test_words():
    text = f"Stra{chr(0xDF)}e caf{chr(0xE9)} cafe{chr(0x301)} we{chr(0xAD)}kly {chr(0xFF11)}2 a_b <p>X</p> wo<b>rd</b> &#252;ber"
    assert words(text) == {"strasse", "cafe", "wekly", "12", "a", "b", "x", "word", "uber"}
    assert words(None) == words("") == words(" -_- ") == set()


def test_pairs_against_brute_force(spark):
    rows = texts()
    rows += [(i + "-copy", t) for i, t in rows[:20]] + rows[:5]  # copies, and rows twice
    rows += [("none", None), ("empty", ""), (None, "alpha beta"), ("long", " ".join(NAMES * 20)), ("long2", " ".join(NAMES))]
    df = spark.createDataFrame([(i, t, b"x", "y") for i, t in rows], "id string, text string, cls binary, sketch string")
    got = {(r.chunk_id_a, r.chunk_id_b) for r in NearDuplicates(df).pairs().collect()}
    want = brute({(i, t) for i, t in rows})
    assert not got - want
    assert len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize(("bucket", "block"), [(4, 3), (1000, 2)])
def test_large_buckets_lose_nothing(spark, monkeypatch, bucket, block):
    rows = texts(seed=5, clusters=3, size=12)
    df = spark.createDataFrame(rows, "id string, text string")
    want = {(r.rep_a, r.rep_b) for r in NearDuplicates(df).links.collect()}

    def limited(batches, bucket=bucket, block=block):
        neardup.BUCKET, neardup.BLOCK = bucket, block
        return neardup._meet(batches)

    monkeypatch.setattr(neardup, "BLOCK", block)
    sketches = neardup.keep(df.mapInArrow(neardup._sketch, "id string, cls binary, sketch binary"), "s")
    one = sketches.groupBy("cls").agg(neardup.F.first("sketch").alias("sketch"))
    met = one.mapInArrow(neardup._spread, "bucket long, doc long, second binary").repartition(2, "bucket").sortWithinPartitions("bucket").mapInArrow(limited, "a long, b long, key long, second binary")
    met = neardup.keep(met, "m")
    over = met.where("b is null").select("a", "key", "second")
    assert not over.isEmpty()
    pairs = met.where("b is not null").select("a", "b").unionByName(neardup._large_keys(over)).distinct()
    assert pairs.count() >= len(want)
    assert pairs.exceptAll(neardup.candidates(sketches)).count() == 0 and neardup.candidates(sketches).exceptAll(pairs).count() == 0


@pytest.mark.parametrize("meta", [3, 4096])
def test_frequent_sub_keys_are_spread_before_the_shuffle(spark, monkeypatch, meta):
    rows = texts(seed=5, clusters=3, size=12)
    df = spark.createDataFrame(rows, "id string, text string")
    sketches = neardup.keep(df.mapInArrow(neardup._sketch, "id string, cls binary, sketch binary"), "s")
    want = neardup.candidates(sketches)
    monkeypatch.setattr(neardup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(neardup, "BUCKET", 8)
    monkeypatch.setattr(neardup, "META", meta)
    one = sketches.groupBy("cls").agg(neardup.F.first("sketch").alias("sketch"))
    assert not neardup._frequent(one).isEmpty()
    got = neardup.candidates(sketches)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_an_id_with_two_texts(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [("a", base), ("a", "quite other words of this same id in a table"), ("b", base + " eleven"), ("c", "quite other words of this same id in a list")]
    links = {(r.rep_a, r.rep_b): round(r.similarity, 4) for r in NearDuplicates(spark.createDataFrame(rows, "id string, text string")).links.collect()}
    assert links == {("a", "b"): round(10 / 11, 4), ("a", "c"): round(9 / 11, 4)}


def test_many_copies_keep_every_link(spark):
    rows = [(f"a{i}", "one two three four five six") for i in range(10)] + [("b", "one two three four five seven"), ("z", "other words here")]
    nd = NearDuplicates(spark.createDataFrame(rows, "id string, text string"))
    got = {(r.chunk_id_a, r.chunk_id_b) for r in nd.pairs(copies=4).collect()}
    assert got == {("a0", f"a{i}") for i in range(1, 10)} | {("a0", "b")}
    groups = {r.id: (r.rep, r.copies, r.links, r.group_id) for r in nd.groups().collect()}
    assert groups["a7"] == ("a0", 10, 1, "a0") and groups["b"] == ("b", 1, 1, "a0") and groups["z"] == ("z", 1, 0, "z")


@pytest.mark.parametrize("block", [512, 7])
def test_large_class_of_different_texts_keeps_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    base = "one two three four five six".split()
    rows = [(f"a{i:02d}", " ".join(base) + "." * (i // 2)) for i in range(70)]  # one word set, raw texts twice each
    rows += [(f"b{i:02d}", " ".join(base[:5]) + " seven" + "!" * i) for i in range(66)] + [("c", " ".join(base[1:]) + " eight"), ("z", "other words here")]
    nd = NearDuplicates(spark.createDataFrame(rows, "id string, text string"))
    got = [(r.chunk_id_a, r.chunk_id_b) for r in nd.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    some = {(r.chunk_id_a, r.chunk_id_b) for r in nd.pairs(copies=1).collect()}
    gone = {f"a{i:02d}" for i in range(1, 70, 2)}
    assert some == {p for p in brute(rows) if not gone & set(p)} | {(f"a{i - 1:02d}", f"a{i:02d}") for i in range(1, 70, 2)}


def test_lower_similarity_is_refused(spark):
    with pytest.raises(UsageError):
        NearDuplicates(spark.createDataFrame([("a", "x")], "id string, text string"), 0.5)
    assert [round(neardup.miss_rate(s), 3) for s in (0.6, 0.68, 0.75)] == [0.172, 0.033, 0.003]


def test_components(spark):
    path = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y"), ("hub", "h1"), ("hub", "h2"), ("h2", "h3")]
    got = {r.u: r.root for r in connected(spark.createDataFrame(path, "u string, v string")).collect()}
    assert {got[f"n{i:02d}"] for i in range(21)} == {"n00"} and got["y"] == "x" and {got[h] for h in ("h1", "h2", "h3", "hub")} == {"h1"}


def test_empty(spark):
    nd = NearDuplicates(spark.createDataFrame([], "id string, text string"))
    assert nd.pairs().count() == 0 and nd.groups().count() == 0
