from __future__ import annotations

import io
import json
import tempfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.errors import GateError, InvariantError, NotFound, UsageError
from corpusmill.plans import answer, ports
from corpusmill.plans.evaluation import evaluate_file
from corpusmill.plans.resolve import RetrieveOptions, resolve, validate
from corpusmill.sources import evalset, extract, files, render
from corpusmill.store import Chunker, Store
from corpusmill.streaming.ingest import ingest_stream
from corpusmill.tables import clear, keep, rows_at, stored

EMBED = ports.HashingEmbedder(32)


@pytest.fixture
def folder():
    place = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    (place / "in" / ".hidden").mkdir(parents=True)
    (place / "in" / "alpha.txt").write_text("alpha beta gamma delta epsilon")
    (place / "in" / "_notes.md").write_text("---\nauthor: alice\ntags: [a, b]\n---\n# Keys\nrotate the signing keys every month\n")
    (place / "in" / "rows.csv").write_text("id,status,owner\ncsvsentinel,open,ruiz\n")
    (place / "in" / ".hidden" / "x.md").write_text("no")
    (place / "in" / "bad.txt").write_bytes(b"\xff\xfe")
    (place / "in" / "a.pdf").write_bytes(b"%PDF")
    return place


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    assert extract.docx(office({"word/document.xml": f"<w:document {w}><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p><w:p/></w:document>"})) == "one two\nthree"
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = {
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Second" r:id="r2"/><sheet name="First" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>shared</t></si></sst>",
        "xl/worksheets/s1.xml": f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c/><c><v>7</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet {s}><sheetData><row><c t="inlineStr"><is><t>inline</t></is></c></row></sheetData></worksheet>',
    }
    assert extract.xlsx(office(book)) == "# Sheet: Second\ninline\n\n# Sheet: First\nshared\t7"


def test_front_matter():
    assert extract.front_matter("---\na: 'x'\n# no\nb: [1, \"2\"]\na: y\n---\nbody") == ({"a": "y", "b": "1,2"}, "body")
    assert extract.front_matter("---\na: x\nbody") == ({}, "---\na: x\nbody")
    assert extract.front_matter("text") == ({}, "text")


def test_fingerprint_counts_every_byte_of_small_files():
    a, b = bytearray(16_000), bytearray(16_000)
    b[9_000] = 1
    assert files.fingerprint(bytes(a)) != files.fingerprint(bytes(b)) and files.fingerprint(b"").startswith("0:")


def test_ingest_sync_export(spark, folder):
    store = Store(spark, f"file://{folder}/store")
    store.create("docs", EMBED, Chunker(20, 2))
    with pytest.raises(InvariantError):
        store.create("docs", EMBED)
    with pytest.raises(NotFound):
        store.get("other")
    assert store.add("docs", str(folder / "in"), EMBED, exclude=["*.pdf"]) == {"new": 3, "unsupported": 1}
    docs = {r.source_uri.rsplit("/", 1)[1]: r for r in store.table("docs", "documents").collect()}
    assert set(docs) == {"alpha.txt", "_notes.md", "rows.csv"} and docs["_notes.md"].metadata["tags"] == "a,b"
    assert store.add("docs", str(folder / "in"), EMBED, exclude=["*.pdf"]) == {"unchanged": 3, "unsupported": 1}
    with pytest.raises(InvariantError):
        store.ingest("docs", store.spark.createDataFrame([], files.FILES), ports.HashingEmbedder(8))
    (folder / "in" / "alpha.txt").write_text("changed words here")
    (folder / "in" / "_notes.md").write_text("---\nauthor: bob\n---\n# Keys\nrotate the signing keys every month\n")
    (folder / "in" / "rows.csv").unlink()
    assert store.sync("docs", EMBED, prune=True, dry_run=True) == {"pruned": 1}
    done = store.sync("docs", EMBED, prune=True)
    assert done["changed"] == 1 and done["refreshed"] == 1 and done["pruned"] == 1
    docs = {r.source_uri.rsplit("/", 1)[1]: r for r in store.table("docs", "documents").collect()}
    assert set(docs) == {"alpha.txt", "_notes.md"} and docs["_notes.md"].metadata["author"] == "bob"
    assert {r.text for r in store.table("docs", "chunks").collect()} == {"changed words here", "# Keys\nrotate the signing keys every month"}
    store.export("docs", f"file://{folder}/out")
    copy = store.load(f"file://{folder}/out", name="copy")
    assert copy.name == "copy" and store.names() == ["copy", "docs"]
    texts = lambda n: sorted(r.text for r in store.table(n, "chunks").collect())
    assert texts("copy") == texts("docs") and store.table("copy", "vectors").count() == 2
    assert store.table("copy", "chunks").join(store.table("docs", "chunks"), "id").count() == 0
    some = store.table("copy", "chunks").first().id
    assert store.remove_chunks("copy", [some]) == 1 and store.table("copy", "documents").count() == 2
    with pytest.raises(NotFound):
        store.remove_chunks("copy", [some])
    store.drop("copy")
    assert store.names() == ["docs"]


def test_stream(spark, folder):
    (folder / "in" / "a.pdf").unlink()
    (folder / "in" / "bad.txt").unlink()
    store = Store(spark, f"file://{folder}/store")
    store.create("live", EMBED, Chunker(20, 2))
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(spark, f"file://{folder}/in", store, "live", EMBED, f"file://{folder}/checkpoint").awaitTermination(120)
    assert store.table("live", "documents").count() >= 2
    (folder / "in" / "later.txt").write_text("later words")
    ingest_stream(spark, f"file://{folder}/in", store, "live", EMBED, f"file://{folder}/checkpoint").awaitTermination(120)
    assert store.table("live", "documents").where("source_uri like '%later.txt'").count() == 1


def test_resolve_ask_verify_replay(spark, folder):
    store = Store(spark, f"file://{folder}/store")
    store.create("docs", EMBED, Chunker(20, 2))
    store.add("docs", str(folder / "in"), EMBED)
    store.create("more", EMBED, Chunker(20, 2))
    store.ingest("more", files.in_memory(spark, b"signing keys live in the vault", "vault"), EMBED)
    asks = spark.createDataFrame([(1, "signing keys"), (2, "csvsentinel ruiz")], "query_id long, text string")
    first = lambda df: {r.query_id: r.source.rsplit("/", 1)[-1] for r in df.where("pos = 1").collect()}
    for o in (RetrieveOptions(["docs"]), RetrieveOptions(["docs"], lexical=True), RetrieveOptions(["docs"], hybrid=True), RetrieveOptions(["docs"], mmr=True), RetrieveOptions(["docs"], explain=True), RetrieveOptions(["docs"], recency=True, now="2100-01-01T00:00:00Z")):
        assert first(resolve(store, asks, o, EMBED)) == {"1": "_notes.md", "2": "rows.csv"}, o
    both = resolve(store, asks, RetrieveOptions(["docs", "more"], k=2, max_per_source=1), EMBED)
    assert {r.collection for r in both.collect()} <= {"docs", "more"} and both.where("query_id = '1' and source = 'vault'").count() == 1
    reranked = resolve(store, asks, RetrieveOptions(["docs"], rerank=True, k=1), EMBED, ports.overlap_scores)
    assert first(reranked) == {"1": "_notes.md", "2": "rows.csv"} and reranked.count() == 2
    assert first(resolve(store, asks, RetrieveOptions(["docs"], where=["author=alice"], source="_n*", budget=50), EMBED)) == {"1": "_notes.md", "2": "_notes.md"}
    assert resolve(store, asks, RetrieveOptions(["docs"], k=0), EMBED).count() == 0
    found, hits = answer.ask(store, spark, "signing keys", RetrieveOptions(["docs"], k=2), EMBED, ports.extract)
    assert found.grounded and found.citations and set(found.citations) <= {h.chunk_id for h in hits}
    m = answer.manifest(store, found, RetrieveOptions(["docs"], k=2))
    again = answer.Manifest.from_json(m.to_json())
    assert answer.replay(store, spark, again, EMBED, ports.extract) == {"corpus": True, "retrieval": True, "answer": True}
    texts = spark.createDataFrame([("x", found.text, found.citations)], "answer_id string, text string, valid array<string>")
    claims, rates = answer.verify(texts, store.table("docs", "chunks"), ports.overlap_verdict)
    assert claims.count() >= 1 and rates.first().rate > 0.5
    store.remove_documents("docs", [hits[0].source])
    assert answer.replay(store, spark, again, EMBED, ports.extract)["corpus"] is False
    assert answer.prompts(both, asks).count() == 2


@pytest.mark.parametrize("bad", [{"lexical": True, "mmr": True}, {"collections": ["a", "b"], "hybrid": True}, {"collections": []}, {"recency": True, "half_life_days": 0.0}, {"rerank": True}, {"mmr": True, "collections": ["a", "b"]}, {"where": ["x"]}, {"source": "["}])
def test_options_that_exclude_each_other(bad):
    with pytest.raises(UsageError):
        validate(RetrieveOptions(**{"collections": ["a"]} | bad))


def test_citations_and_cache(spark):
    assert answer.cite("A [1]. B [2, 1] [x] [9].", ["i", "j"]) == ("A [i]. B [j, i] [x] [9].", ["i", "j"])
    assert answer.cite("none", ["i", "j"])[1] == ["i", "j"]
    assert answer.cite(f"A [{chr(0xB2)}] [1].", ["i"]) == (f"A [{chr(0xB2)}] [i].", ["i"])
    assert answer.renumber("A [j]. B [i, j, z] [z].", ["i", "j", "k"]) == ("A [1]. B [2][1] [z].", ["j", "i", "k"])
    cache = spark.sql("SELECT 'k' AS key, 'old' AS answer, timestamp'2025-01-01' AS stored_at")
    keys = spark.createDataFrame([("k",), ("z",)], "key string")
    assert {tuple(r) for r in answer.cache_get(cache, keys, "2024-12-31").collect()} == {("k", "old"), ("z", None)}
    assert {tuple(r) for r in answer.cache_get(cache, keys, "2025-01-02").collect()} == {("k", None), ("z", None)}
    more = spark.sql("SELECT 'k' AS key, 'new' AS answer, timestamp'2025-02-01' AS stored_at")
    assert [r.answer for r in answer.cache_put(cache, more).collect()] == ["new"] and answer.cache_prune(cache, "2025-03-01").count() == 0


def test_question_sets(spark, folder):
    path = folder / "cases.jsonl"
    path.write_text('\n{"version": 1}\n{"question": "a?", "expected_chunks": ["x"], "expected_sources": ["s"]}\n\n{"question": "b?", "expected_sources": ["s", "t"]}\n{"question": "c?"}\n')
    cases = evalset.read_cases(spark, str(path))
    chunks, sources = evalset.expected_items(cases)
    assert cases.count() == 3 and chunks.count() == 1 and sources.count() == 2
    for text in ("", '{"version": 2}\n{"question": "a"}', '{"question": " "}'):
        path.write_text(text)
        with pytest.raises(UsageError):
            evalset.read_cases(spark, str(path))
    hits = spark.createDataFrame([("q", 2, "b", None), ("q", 1, "a", 0.5)], "query_id string, pos int, chunk_id string, score double")
    assert evalset.hits_json(hits).first().json == '[{"chunk_id":"a","score":0.5},{"chunk_id":"b"}]'
    path.write_text('[{"chunk_id": "a", "score": 0.5}, {"chunk_id": "b"}]')
    assert [r.chunk_id for r in evalset.read_hits(spark, str(path)).orderBy("pos").collect()] == ["a", "b"]
    (folder / "more").mkdir()
    for name, ids in (("a", "xy"), ("b", "zw")):
        (folder / "more" / f"{name}.json").write_text(json.dumps([{"chunk_id": i} for i in ids]))
    assert [(r.pos, r.chunk_id) for r in evalset.read_hits(spark, str(folder / "more")).orderBy("pos").collect()] == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    path.write_text(json.dumps({"question": "a" * evalset.MOST_BYTES}))
    with pytest.raises(UsageError, match="more than"):
        evalset.read_cases(spark, str(path))


def test_evaluation_from_a_file(spark, folder):
    store = Store(spark, str(folder / "store"))
    store.create("docs", EMBED)
    store.add("docs", str(folder / "in"), EMBED, exclude=["*.pdf", "bad.txt"])
    path = folder / "cases.jsonl"
    uri = f"file://{folder}/in/_notes.md"
    path.write_text("\n".join(json.dumps(x) for x in ({"version": 1}, {"question": "rotate the signing keys", "expected_sources": [uri]}, {"question": "alpha beta", "expected_sources": ["file:///none"]}, {"question": "nothing expected"})))
    options = RetrieveOptions(["docs"], k=2, hybrid=True)
    each, report = evaluate_file(store, str(path), options, EMBED)
    assert {r.question: r.mrr for r in each.collect()} == {"rotate the signing keys": 1.0, "alpha beta": 0.0}
    assert report.first().questions == 2 and report.first().recall == 0.5
    with pytest.raises(GateError, match="mrr"):
        evaluate_file(store, str(path), options, EMBED, least={"mrr": 0.9})
    recent = resolve(store, spark.createDataFrame([("q", "alpha beta")], "query_id string, text string"), RetrieveOptions(["docs"], k=2, recency=True), EMBED)
    assert recent.count() == 2  # now is when it runs


def test_two_writers_and_imported_sources(spark, folder):
    store = Store(spark, str(folder / "store"))
    store.create("docs", EMBED)
    store.add("docs", str(folder / "in"), EMBED, exclude=["*.pdf", "bad.txt"])
    one, two = store.get("docs"), store.get("docs")
    one.sources.append("x")
    store._save(one)
    with pytest.raises(InvariantError, match="another writer"):
        store._save(two)
    one.sources.remove("x")
    store._save(one)
    store.export("docs", str(folder / "out"))
    other = store.load(str(folder / "out"), "again")
    assert other.sources == store.get("again").sources == [str(folder / "in")]
    assert store.load(str(folder / "out"), "again", force=True).name == "again" and store.names() == ["again", "docs"]
    ids = [r.id for r in store.table("docs", "chunks").select("id").collect()]
    with pytest.raises(NotFound):
        store.remove_chunks("docs", [ids[0], "none"])
    assert store.remove_chunks("docs", ids[:1] * 2) == 1 and store.table("docs", "chunks").count() == store.table("docs", "vectors").count() == len(ids) - 1


def test_walk_below_the_root(spark, folder):
    for place in ("in/a/b", "in/a/.no", "in/c"):
        (folder / place).mkdir(parents=True)
        (folder / place / "_x.Markdown").write_text("x")
    got = {r.source_uri: (r.content_type, r.size) for r in files.walk(spark, str(folder / "in"), ["*.pdf"]).collect()}
    root = f"file://{folder}/in"
    assert got == {f"{root}/alpha.txt": ("text/plain", 30), f"{root}/_notes.md": ("text/markdown", 78), f"{root}/rows.csv": ("text/csv", 38), f"{root}/bad.txt": ("text/plain", 2), f"{root}/a/b/_x.Markdown": ("text/markdown", 1), f"{root}/c/_x.Markdown": ("text/markdown", 1)}
    assert files.walk(spark, str(folder / "in" / "rows.csv")).count() == 1
    with pytest.raises(NotFound):
        files.walk(spark, str(folder / "none"))
    names = ["/a/b.MD", "/a.b/c", "/x.tar.gz", "/.hidden", "/d.pdf", "/e.", "/f.unknownext"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", files.content_type_of(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in rows} == {n: files.content_type(n) for n in names}


def test_markdown(spark):
    rows = [("q", 2, "file:///a/y.md", 3, 0.25, 0.75, "two"), ("q", 1, "file:///a/x.md", 0, 0.5, None, "one\n"), ("r", 1, None, None, None, None, None)]
    hits = spark.createDataFrame(rows, "query_id string, pos int, source string, seq int, score double, rerank_score double, text string")
    got = {r.query_id: r.markdown for r in render.hits_markdown(hits).collect()}
    dot = chr(0xB7)
    assert got["q"] == f"**[1]**  x.md#0  {dot}  `0.5000`\n\none\n\n\n---\n\n**[2]**  y.md#3  {dot}  sim=`0.2500` rerank=`0.7500`\n\ntwo"
    assert got["r"] == f"**[1]**  #?  {dot}  `0.0000`"
    answers = spark.createDataFrame([("a", "Yes [1].", ["x.md", "y.md"]), ("b", "No.", [])], "answer_id string, text string, labels array<string>")
    assert {r.answer_id: r.markdown for r in render.sources_markdown(answers).collect()} == {"a": "Yes [1].\n\n## Sources\n\n1. x.md\n2. y.md\n", "b": "No."}


def test_intermediate_tables_can_be_cleared(spark):
    clear(spark)
    assert keep(spark.range(3), "t").count() == 3
    path = stored(spark.range(5), "t")
    assert rows_at(path).num_rows == 5 and rows_at("/" + path.removeprefix("file:").lstrip("/")).num_rows == 5
    assert clear(spark) == 2 and clear(spark) == 0
    with pytest.raises(FileNotFoundError):
        rows_at(path)
