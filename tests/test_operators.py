from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.errors import GateError, NotFound, UsageError
from corpusmill.operators import chunking as c
from corpusmill.operators import claims, corpus, evaluate, rank, search, snapshots

VECTORS = [("a", [1.0, 0.0, 0.0], {}), ("b", [0.0, 1.0, 0.0], {}), ("c", [0.9, 0.1, 0.0], {})]


def vectors(spark, rows=VECTORS):
    return spark.createDataFrame([(i, "k", v, m) for i, v, m in rows], "chunk_id string, collection string, vector array<float>, metadata map<string,string>")


def question(spark, vector):
    return spark.createDataFrame([("q", "k", vector)], "query_id string, collection string, vector array<float>")


def ids(df):
    return [r.chunk_id for r in df.orderBy("pos").collect()]


def test_cosine(spark):
    v, q = vectors(spark), question(spark, [1.0, 0.0, 0.0])
    assert ids(search.cosine_topk(q, v, 2)) == ["a", "c"]
    assert ids(search.cosine_topk(q, v, 100)) == ["a", "c", "b"]
    assert ids(search.cosine_topk(q, v, 0)) == [] == ids(search.cosine_topk(q, v, -1))
    assert ids(search.cosine_topk(q, v, 3, where=F.col("chunk_id") != "a")) == ["c", "b"]
    odd = vectors(spark, [("z", [0.0, 0.0, 0.0], {}), ("s", [1.0], {}), ("n", None, {}), ("y", [-1.0, 0.0, 0.0], {})])
    got = search.cosine_topk(q, odd, 9)
    assert ids(got) == ["n", "s", "z", "y"] and [r.score for r in got.orderBy("pos").collect()] == [0, 0, 0, -1]
    assert search.cosine_topk(q, v.where("false"), 3).count() == 0


def test_cosine_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"v{i:03d}", rng.normal(size=4).astype(np.float32).tolist(), {}) for i in range(200)]
    v = vectors(spark, rows)
    q = v.where("chunk_id < 'v020'").select(F.col("chunk_id").alias("query_id"), "collection", "vector")
    one = search.cosine_topk(q, v, 5).collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "ENTRY_BLOCK", 7)
    assert sorted(map(tuple, one)) == sorted(map(tuple, search.cosine_topk(q, v, 5).collect()))


def test_bm25(spark):
    rows = [("d1", "alpha alpha alpha beta", 1), ("d2", "alpha beta gamma delta", 2), ("d3", "zeta eta theta iota", 1), ("d4", "", 1)]
    chunks = spark.createDataFrame([(i, "k", t, a) for i, t, a in rows], "id string, collection string, text string, author int")
    ask = lambda t: spark.createDataFrame([("q", "k", t)], "query_id string, collection string, text string")
    assert ids(search.bm25_topk(ask("Alpha alpha"), chunks, 9)) == ["d1", "d2"]
    assert ids(search.bm25_topk(ask("alpha beta"), chunks, 1)) == ["d1"]
    some = search.bm25_topk(ask("alpha"), chunks, 9, where=F.col("author") == 2)
    assert ids(some) == ["d2"]
    idf, mean = math.log(1 + (4 - 2 + 0.5) / 2.5), 12 / 4
    assert some.first().score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / mean)))
    assert search.bm25_topk(ask("?"), chunks, 9).count() == 0


def lists(spark, *names):
    return spark.createDataFrame([("q", x, n + 1) for n, x in enumerate(names)], "query_id string, chunk_id string, pos int")


def test_fusion(spark):
    assert ids(search.fuse([lists(spark, "a", "b", "c"), lists(spark, "b", "x", "y")])) == ["b", "a", "x", "c", "y"]
    twice, once = (search.fuse([lists(spark, *x)]).orderBy("pos").collect() for x in (("a", "a", "b"), ("a", "b")))
    assert [(r.chunk_id, r.rrf) for r in twice] == [(r.chunk_id, r.rrf) for r in once]
    near = lists(spark, "cv").withColumn("score", F.lit(0.8))
    got = search.hybrid(near, lists(spark, "cl", "cv"), 8).orderBy("pos").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("cv", 0.8), ("cl", 0.0)]


def test_mmr(spark):
    hits = spark.createDataFrame([("q", "A", 0.9, 1), ("q", "B", 0.85, 2), ("q", "C", 0.7, 3)], "query_id string, chunk_id string, score double, pos int")
    v = vectors(spark, [("A", [1.0, 0.0], {}), ("B", [1.0, 0.0], {}), ("C", [0.0, 1.0], {})])
    assert ids(rank.mmr(hits, v, 0, 0.5)) == ["A", "C", "B"]
    assert ids(rank.mmr(hits, v, 0, 1.0)) == ["A", "B", "C"]
    assert ids(rank.mmr(hits, v, 2, 0.5)) == ["A", "C"]
    assert ids(rank.mmr(hits, v.where("false"), 0, 0.5)) == ["A", "B", "C"]


def test_cap_and_budget(spark):
    hits = spark.createDataFrame([("q", str(i + 1), s, i + 1, 10) for i, s in enumerate("aabac")], "query_id string, chunk_id string, source string, pos int, tokens int")
    assert ids(rank.cap_per_source(hits, 2)) == ["1", "2", "3", "5"]
    assert ids(rank.cap_per_source(hits, 0)) == ["1", "2", "3", "4", "5"]
    assert ids(rank.token_budget(hits, F.col("tokens"), 25)) == ["1", "2"]
    assert ids(rank.token_budget(hits, F.col("tokens"), 1)) == ["1"]


@pytest.mark.parametrize(
    ("rows", "order"),
    [
        ([("stale", 0.8, "2025-01-01"), ("fresh", 0.7, "2026-06-10")], ["fresh", "stale"]),
        ([("strong", 0.95, "2026-05-15"), ("fresh", 0.4, "2026-06-13")], ["strong", "fresh"]),
        ([("old", 0.8, "2024-01-01"), ("undated", 0.75, None)], ["undated", "old"]),
        ([("near", 0.55, "2026-06-14"), ("future", 0.5, "2099-01-01")], ["near", "future"]),
    ],
)
def test_recency(spark, rows, order):
    data = [("q", i, s, n + 1, dt.datetime.fromisoformat(t) if t else None) for n, (i, s, t) in enumerate(rows)]
    hits = spark.createDataFrame(data, "query_id string, chunk_id string, score double, pos int, at timestamp")
    assert ids(rank.by_recency(hits, F.col("at"), "2026-06-14T00:00:00Z", 90.0)) == order
    assert ids(rank.by_recency(hits, F.col("at"), "2026-06-14T00:00:00Z", 0.0)) == [r[0] for r in rows]


def test_rerank(spark):
    hits = spark.createDataFrame([("q", x, "ask", t, 0.5, n + 1) for n, (x, t) in enumerate([("a", "no"), ("b", "ask"), ("c", "ask")])], "query_id string, chunk_id string, query string, text string, score double, pos int")
    score = lambda q, texts: [(i, float(t == q)) for i, t in enumerate(texts)]
    got = rank.rerank(hits, score).orderBy("pos").collect()
    assert [(r.chunk_id, r.rerank_score, r.score) for r in got] == [("b", 1.0, 0.5), ("c", 1.0, 0.5), ("a", 0.0, 0.5)]
    assert ids(rank.rerank(hits, lambda q, t: [(2, 0.1)], 5)) == ["c"]
    with pytest.raises(Exception, match="position"):
        rank.rerank(hits, lambda q, t: [(7, 0.1)]).collect()


def test_metrics(spark):
    hits = spark.createDataFrame([("q", x, n + 1) for n, x in enumerate("axbya")] + [("other", "a", 1)], "query_id string, chunk_id string, pos int")
    want = spark.createDataFrame([("q", x) for x in "abca"] + [("none", "z")], "query_id string, chunk_id string")
    got = {r.query_id: r for r in evaluate.per_question(hits, want, 4, "chunk_id").collect()}
    assert set(got) == {"q", "none"}
    r = got["q"]
    assert (r.recall, r.precision, r.mrr, r.hit_rate) == (pytest.approx(2 / 3), 0.5, 1.0, 1.0)
    assert r.ndcg == pytest.approx(1.5 / (1 + 1 / math.log2(3) + 0.5))
    assert tuple(got["none"])[1:] == (0, 0, 0, 0, 0)
    assert {r.query_id: r.recall for r in evaluate.per_question(hits, want, 2, "chunk_id").collect()}["q"] == pytest.approx(1 / 3)
    report = evaluate.means(evaluate.per_question(hits, want, 4, "chunk_id"))
    evaluate.gate(report, {"mrr": 0.5})
    with pytest.raises(GateError, match="mrr.*recall"):
        evaluate.gate(report, {"recall": 0.9, "mrr": 0.9})
    with pytest.raises(UsageError):
        evaluate.gate(report, {"speed": 1})


def test_support(spark):
    rows = [("a", "supported"), ("a", "unsupported"), ("b", None), ("c", "supported")]
    got = {r.answer_id: (r.claims, r.rate, r.all_supported) for r in evaluate.support_rate(spark.createDataFrame(rows, "answer_id string, verdict string")).collect()}
    assert got == {"a": (2, 0.5, False), "b": (0, 1.0, True), "c": (1, 1.0, True)}


def test_diff_prune_outcomes(spark):
    make = lambda rows: spark.createDataFrame(rows, "source_uri string, hash string, fingerprint string")
    old, new = make([("a", "1", "f1"), ("b", "2", "f2"), ("c", "3", "f3")]), make([("b", "2", "f9"), ("c", "4", "f4"), ("d", "5", "f5")])
    assert {tuple(r) for r in corpus.diff(old, new).collect()} == {("a", "removed"), ("c", "changed"), ("d", "added")}
    assert [r.source_uri for r in corpus.prunable(old, new).collect()] == ["a"]
    assert {tuple(r) for r in corpus.outcomes(new, old).collect()} == {("b", "refreshed"), ("c", "changed"), ("d", "new")}
    assert corpus.diff(old, old).count() == 0


def test_snapshots_nulls_returns_and_first_runs(spark):
    rows = [
        (1, "k", "a", "1"), (1, "k", "b", "1"), (1, "k", "n", None),
        (2, "k", "a", None), (2, "k", "c", "1"), (2, "k", "n", "7"), (2, "j", "x", "1"),
        (3, "k", "a", "2"), (3, "k", "b", "1"), (3, "k", "n", "8"),
        (4, "k", "a", None), (4, "j", "y", "1"),
        (5, "k", "a", "2"), (5, "k", "b", None),
        (6, "k", "a", "2"), (6, "k", "b", "5"),
    ]
    clean = spark.createDataFrame(rows, "snapshot_no int, collection string, source_uri string, hash string")
    runs = [(1, ["k"]), (2, ["j", "k"]), (3, ["k"]), (4, ["j", "k"]), (5, ["k"]), (6, ["k"])]
    clean = clean.withColumn("at", F.concat(F.lit("t"), "snapshot_no"))
    with snapshots.Snapshots(clean, runs, buckets=8) as s:
        changes = s.changes()
        old = s.with_old_values(changes, ["at"])
        plan = s.step(3, ["k"], s.spark.table(s._names[2]))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "PartitionFilters: [isnotnull(snapshot_no" in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("snapshot_")]
    got = {(r.snapshot_no, r.collection, r.source_uri, r.change_kind) for r in changes.collect()}
    assert {(r.snapshot_no, r.source_uri, r.old_at) for r in old.collect()} == {(2, "b", "t1"), (3, "a", "t2"), (3, "c", "t2"), (3, "n", "t2"), (4, "b", "t3"), (4, "n", "t3"), (4, "x", "t2")}
    assert got == {
        (2, "k", "b", "removed"), (2, "k", "c", "added"),
        (3, "k", "a", "changed"), (3, "k", "b", "added"), (3, "k", "c", "removed"), (3, "k", "n", "changed"),
        (4, "k", "b", "removed"), (4, "k", "n", "removed"), (4, "j", "x", "removed"), (4, "j", "y", "added"),
        (5, "k", "b", "added"),
    }
    for rows, of in ((clean, []), (clean.where("false"), runs)):
        with snapshots.Snapshots(rows, of, buckets=8) as s:
            assert s.with_old_values(s.changes(), ["at"]).count() == s.changes().count() == 0


def test_latest_with_ties_and_nulls(spark):
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", t, "1", "x"), ("a", t, "2", "x"), ("a", None, "9", "x"), (None, None, None, "x"), ("a", t, "2", "x")], "k string, at timestamp, hash string, _last string")
    assert sorted(map(tuple, snapshots.latest(df, ["k"], "at", ["hash"]).collect()), key=str) == [("a", t, "2"), (None, None, None)]


def test_markdown():
    text = "# Auth\none two three four five six\n## Keys\nseven eight nine ten eleven twelve\n"
    assert [p.heading_path for p in c.split_markdown(text, c.Sizes(10))] == ["Auth", "Auth > Keys"]
    assert [p.heading_path for p in c.split_markdown(text, c.Sizes(100))] == ["Auth"]
    assert [p.path for p in c.sections("x\n```\n# no\n```\n# A #\n### B\n## C\n#tag")] == [(), ("A",), ("A", "B"), ("A", "C")]
    assert c.split_markdown(" \n", c.Sizes(5)) == []


def test_sheet():
    rows = ["1 a x", "2 b y", "3 c z", "4 d w"]
    pieces = c.split_sheet("# Sheet: T\nID Status Owner\n" + "\n".join(rows), c.Sizes(14))
    assert all(p.text.startswith("# Sheet: T\nID Status Owner\n") and p.heading_path == "T" for p in pieces) and len(pieces) > 1
    assert [line for p in pieces for line in p.text.split("\n")[2:]] == rows
    assert [p.text for p in c.split_sheet("h1 h2", c.Sizes(5))] == ["h1 h2"]


def test_text():
    assert [p.text for p in c.split_text("a b.\n\nc d e.", c.Sizes(4))] == ["a b.", "c d e."]
    assert [p.text for p in c.split_text("One two. Three four. Five", c.Sizes(4))] == ["One two. Three four.", "Five"]
    assert c.windows("a b c d e", c.Sizes(3, 1)) == ["a b c", "c d e"]
    with pytest.raises(UsageError):
        c.Sizes(3, 3)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#`|", max_size=200), st.integers(1, 9), st.integers(0, 3))
def test_chunkers_keep_words(text, size, overlap):
    s = c.Sizes(size, min(overlap, size - 1))
    for split in (c.split_text, c.split_markdown):
        pieces = [p.text for p in split(text, s)]
        if s.overlap == 0:
            assert " ".join(pieces).split() == text.split()
        assert all(c.count_words(p) <= size for p in pieces)


def test_claims():
    known = {"d:1", "d:2"}
    assert claims.claims("A is b [d:1, d:2]. C is d [d:9]. E.", known) == [("A is b", ["d:1", "d:2"]), ("C is d", ["d:1", "d:2"]), ("E.", ["d:1", "d:2"])]
    assert claims.claims("See e.g. the U.S. case vs. it [d:1].\n\n1. Next one", known) == [("See e.g. the U.S. case vs. it", ["d:1"]), ("Next one", [])]
    assert claims.claims(" ", known) == []


def test_claims_and_evidence(spark):
    answers = spark.createDataFrame([(1, "A is b [x]. So it is.\n\nAlone", ["x", "y"]), (2, None, None)], "answer_id long, text string, valid array<string>")
    found = claims.segment(answers)
    assert [(r.claim, r.verdict) for r in found.orderBy("pos").collect()] == [("A is b", None), ("So it is", None), ("Alone", "uncited")]
    texts = spark.createDataFrame([("x", "text of x")], "id string, text string")
    assert {r.evidence for r in claims.evidence(found, texts).collect()} == {"text of x"}


def test_digest(spark):
    import hashlib

    df = spark.createDataFrame([("k", "b", "2", None), ("k", "a", "1", None)], "collection string, source_uri string, hash string, ingested_at timestamp")
    assert corpus.corpus_digest(df).first().digest == hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest()


def test_evidence_by_collection(spark):
    found = spark.createDataFrame([("q", 0, "c", ["x", "y"])], "answer_id string, pos int, claim string, cited array<string>")
    chunks = spark.createDataFrame([("x", "a", "x of a"), ("x", "b", "x of b"), ("y", "a", "y of a"), ("y", "b", "y of b")], "id string, collection string, text string")
    origins = spark.createDataFrame([("q", "x", "b"), ("q", "y", "")], "answer_id string, chunk_id string, collection string")
    assert [r.evidence for r in claims.evidence(found, chunks, origins, "a").collect()] == ["x of b\n\ny of a"]


def test_digest_and_selector(spark):
    import hashlib

    t = dt.datetime(2025, 1, 1)
    rows = [("c", f"u{i:04d}", f"h{i}", t + dt.timedelta(days=i % 7)) for i in range(500)] + [("d", "x", "h", None), ("e", None, None, t)]
    docs = spark.createDataFrame(rows, "collection string, source_uri string, hash string, ingested_at timestamp").repartition(5)
    got = {r.collection: (r.digest, r.last_ingest) for r in corpus.corpus_digest(docs).collect()}
    whole = "".join(f"{u}\0{h}\0" for c, u, h, _ in sorted(rows[:500]))
    assert got == {"c": (hashlib.sha256(whole.encode()).hexdigest(), t + dt.timedelta(days=6)), "d": (hashlib.sha256(b"x\0h\0").hexdigest(), None), "e": (hashlib.sha256(b"").hexdigest(), t)}
    assert corpus.corpus_digest(docs.limit(0)).count() == 0
    assert corpus.select_one(docs, "u0007", None).hash == "h7"
    with pytest.raises(UsageError, match="several"):
        corpus.select_one(docs, "u00", None)
    with pytest.raises(NotFound):
        corpus.select_one(docs, "none", None)


def test_bm25_against_brute_force(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "TERM_BLOCK", 300)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    texts = {f"c{i:03d}": " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 30))) for i in range(200)}
    texts |= {f"e{i}": t for i, t in enumerate(list(texts.values())[:20])}
    asked = {f"q{i}": " ".join(rng.sample(words, 4) + ["w0", "unknown"]) for i in range(30)} | {"none": "unknown", "empty": ""}
    chunks = spark.createDataFrame([(i, "k", t, "x") for i, t in texts.items()] + [("z", "k", None, "x"), ("o", "other", "w0", "x")], "id string, collection string, text string, codes string")
    questions = spark.createDataFrame([(q, "k", t) for q, t in asked.items()], "query_id string, collection string, text string")
    got = {}
    for r in search.bm25_topk(questions, chunks, 5).orderBy("pos").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    held = {i: Counter(t.split()) for i, t in texts.items()} | {"z": Counter()}
    n, mean = len(held), sum(sum(c.values()) for c in held.values()) / len(held)
    df = Counter(w for c in held.values() for w in c)
    want = {}
    for q, t in asked.items():
        score = {i: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(t.split()) if c[w]) for i, c in held.items()}
        best = sorted((-round(s, 9), i) for i, s in score.items() if s)[:5]
        if best:
            want[q] = [i for _, i in best]
    assert got == want
    assert search.bm25_topk(questions, chunks, 0).count() == search.bm25_topk(questions.limit(0), chunks, 5).count() == search.bm25_topk(questions, chunks.limit(0), 5).count() == 0
