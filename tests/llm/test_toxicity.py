from __future__ import annotations

import random

import numpy as np
import pytest

from corpusmill.llm.toxicity import Counts, KneserNey, Model, Shared, codes, plain_text, plain_word, score, verdicts

RUDE = ["you are a worthless grumbler", "shut up you pathetic grumbler", "crawl away you worthless snarker", "nobody wants you here snarker"]
CALM = ["the queue of {} is empty today", "please restart {} before noon", "we moved {} to the other shelf", "the report on {} is late", "a worthless default for {} was removed"]


def documents(n=700, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        lines = [rng.choice(CALM).format(f"box{rng.randint(0, 40)}") + "." for _ in range(rng.randint(2, 9))]
        if bad:
            lines.insert(rng.randrange(len(lines)), rng.choice(RUDE) + "!")
        rows.append((i, "\n".join(lines), "src" if i % 2 else "Src "))
        if i < 400:
            labels.append((i, "r1", "abusive" if bad else "clean"))
    return rows, labels


def test_disguises():
    assert plain_word("b17ch5") == "bitchs" and plain_word("stuuuupid") == "stupid" and plain_word("st_upid") == "stupid" and plain_word("2024") == "0"
    assert plain_text(f"S.t.u.p.i.d i d i o t st{chr(0x200B)}ar {chr(0x441)}alm caf{chr(0xE9)}") == "stupid idiot star calm cafe"
    assert (codes("a p***y")[1] == codes("b q**x")[1]) and not len(codes(None)) and not len(codes(" \n "))
    assert codes("One two. Three")[2] == 0 and codes("x" * 100_000)[-1] == 0


def test_probabilities_sum_to_less_than_one():
    pairs = np.array([1 << 32 | 2, 1 << 32 | 2, 1 << 32 | 3, 4 << 32 | 2], np.int64)
    shared = Shared(Counts.of(pairs), Counts(np.array([1, 4]), np.array([3, 1])), Counts(np.array([2, 3]), np.array([2, 1])), 3)
    model = KneserNey(pairs, shared)
    every = np.array([1 << 32 | w for w in (2, 3)], np.int64)
    p = np.exp(model.log_probability(every, shared.pair(every)))
    assert 0 < p.sum() <= 1.2 and p[0] > p[1]
    m = Model.of(model, KneserNey(pairs[:0], shared), shared)
    again = Model.from_bytes(m.to_bytes())
    assert np.allclose(again.ratios(every), m.ratios(every))


def test_held_out_documents(spark):
    rows, labels = documents()
    docs = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, source string, score double, flagged boolean")
    marks = spark.createDataFrame([(*x, None) for x in labels] + [(1, "r2", None, None), (None, "r1", "hateful", None), (99_999, "r1", "sexual", None)], "doc_id long, reviewer string, verdict string, reviewed_at timestamp")
    got = {r.doc_id: r.flagged for r in score(docs, marks).collect()}
    bad = {i for i, _, _ in rows if i % 6 == 0 and i >= 400}
    found = {i for i, f in got.items() if f and i >= 400}
    assert len(got) == len(rows) and len(found & bad) >= 0.9 * len(bad) and len(found - bad) <= 0.1 * len(bad)


def test_few_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, marks = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "review_labels"))
    found = {r.doc_id for r in score(docs, marks).where("flagged").collect()}
    sides = {r.doc_id: r.n for r in verdicts(marks).collect()}
    assert sum(sides.values()) < 10 and 5 < len(found) < 40  # few people's verdicts, more found
    assert not [i for i in found if sides.get(i) == 0]


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_and_unlabelled(spark, labelled):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "some text", "a"), (4, "w " * 60_000, "a")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(3, "r", "clean", None)] if labelled else [], "doc_id long, reviewer string, verdict string, reviewed_at timestamp")
    assert not any(r.flagged for r in score(docs, marks).collect())
    assert score(docs.limit(0), marks).count() == 0


def test_verdicts(spark):
    import datetime as dt

    t = [dt.datetime(2025, 1, d) for d in range(1, 9)]
    rows = [(1, "a", "clean", t[0]), (1, "a", "abusive", t[1]), (2, "a", "clean", t[0]), (2, "b", "hateful", t[0]), (3, "a", "unsure", t[0]), (4, "a", "clean", t[0]), (4, "a", "clean", t[0])]
    got = {r.doc_id: r.n for r in verdicts(spark.createDataFrame(rows, "doc_id long, reviewer string, verdict string, reviewed_at timestamp")).collect()}
    assert got == {1: 1.0, 4: 0.0}
