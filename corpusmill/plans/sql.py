"""SQL counterparts of the core's queries, for a second engine over the same tables."""

from __future__ import annotations

CHUNKS = """chunks1 AS (SELECT id, unnest(r) FROM (SELECT id, max({'document_id': document_id, 'collection': collection, 'seq': seq, 'text': text, 'heading_path': heading_path}) AS r FROM chunks GROUP BY id))"""
DOCS = """docs1 AS (SELECT id, any_value(collection) AS collection, any_value(source_uri) AS source_uri, any_value(hash) AS hash, any_value(ingested_at) AS ingested_at, any_value(fingerprint) AS fingerprint, any_value(metadata) AS metadata FROM (SELECT * FROM source_docs UNION ALL SELECT * FROM shared_docs) GROUP BY id)"""
VECTORS = """vectors1 AS (SELECT chunk_id, collection, vector::DOUBLE[] AS v, sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM (
  SELECT chunk_id, r.collection AS collection, r.vector AS vector FROM (SELECT chunk_id, max({'collection': collection, 'vector': vector}) AS r FROM vectors
  WHERE NOT coalesce(len(list_filter(vector, lambda x: isnan(x) OR x IS NULL)) > 0, false) GROUP BY chunk_id)))"""
HITS = """hits1 AS (SELECT query_id, chunk_id, score, rerank_score, source, ingested_at, row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id)::INT AS pos FROM (
  SELECT query_id, chunk_id, unnest(r) FROM (SELECT query_id, chunk_id, arg_max({'pos': pos, 'score': CASE WHEN score IS NULL OR isnan(score) THEN 0.0 ELSE score END, 'rerank_score': rerank_score, 'source': source, 'ingested_at': ingested_at}, logged_at) AS r FROM hits GROUP BY query_id, chunk_id)))"""
TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
ASKING = "asking AS (SELECT chunk_id AS query_id, collection, v, norm FROM vectors1 WHERE split_part(chunk_id, ':', 2)::INT % 20 = 0)"
COSINE = "CASE WHEN coalesce(len(q.v), 0) = 0 OR coalesce(len(e.v), 0) <> len(q.v) OR q.norm = 0 OR e.norm = 0 THEN 0.0 ELSE list_inner_product(q.v, e.v) / (q.norm * e.norm) END"


def _near(k: int, entries: str = "vectors1", asking: str = "asking") -> str:
    return f"""scored AS (SELECT q.query_id, e.chunk_id, {COSINE} AS score FROM {asking} q JOIN {entries} e USING (collection)),
near AS (SELECT query_id, chunk_id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id)::INT AS pos FROM scored) WHERE pos <= {k})"""


QUESTIONS = "questions AS (SELECT id AS query_id, collection, heading_path AS text FROM chunks1 WHERE seq % 20 = 0 AND heading_path <> '')"


def _bm25(k: int, keep: str = "true") -> str:
    return f"""tok AS (SELECT collection, id AS chunk_id, seq, coalesce({TERMS.format("text")}, []) AS terms FROM chunks1),
stats AS (SELECT collection, count(*) AS n, avg(len(terms)) AS avgdl FROM tok GROUP BY collection),
post AS (SELECT collection, chunk_id, seq, len, term, count(*) AS tf FROM (SELECT collection, chunk_id, seq, len(terms) AS len, unnest(terms) AS term FROM tok) GROUP BY ALL),
df AS (SELECT collection, term, count(*) AS df FROM post GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, collection, term FROM (SELECT query_id, collection, unnest({TERMS.format("text")}) AS term FROM questions)),
bm AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
  FROM asked JOIN post USING (collection, term) JOIN df USING (collection, term) JOIN stats USING (collection) WHERE {keep} GROUP BY query_id, chunk_id),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS pos FROM bm) WHERE pos <= {k})"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


PARSED = r"""CASE WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:\d{{2}})$') THEN try_cast({0} AS TIMESTAMPTZ)
  WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}(T\d{{2}}:\d{{2}}:\d{{2}})?$') THEN try_cast({0} || '+00' AS TIMESTAMPTZ) END"""


def _parsed(x: str) -> str:
    utc = rf"replace({x}, 'Z', '')"
    day = rf"regexp_matches({x}, '^\d{{4}}-\d{{2}}-\d{{2}}(T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?Z?)?$')"
    return f"CASE WHEN {day} THEN try_cast({utc} AS TIMESTAMP) END"


def _key(name: str) -> str:
    entry = f"list_filter(map_entries(metadata), lambda e: lower(e.key) = '{name}')"
    return _parsed(f"list_sort(list_transform({entry}, lambda e: {{'k': e.key, 'v': e.value}}))[1].v")


_PATH_DAY = r"try_cast(regexp_replace(regexp_extract_all(source_uri, '\d{4}[-_/]\d{2}[-_/]\d{2}')[-1], '[_/]', '-', 'g') AS TIMESTAMP)"
_WEEK = r"regexp_extract_all(source_uri, '\d{4}-[Ww]\d{2}')[-1]"
_PATH_WEEK = f"CASE WHEN right({_WEEK}, 2)::INT BETWEEN 1 AND 53 THEN date_trunc('week', make_date(left({_WEEK}, 4)::INT, 1, 4))::TIMESTAMP + to_days((right({_WEEK}, 2)::INT - 1) * 7) END"
PATH_TIME = f"coalesce({_PATH_DAY}, {_PATH_WEEK})"

_SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x0b"


def name_of(uri: str) -> str:
    """A file's canonical name."""
    bare = rf"regexp_replace({uri}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
    path = rf"CASE WHEN regexp_matches({bare}, '^(?i:file:)') THEN url_decode(regexp_replace(regexp_replace({bare}, '^(?i:file:)(//(?i:localhost)?)?', ''), '[?#].*$', '')) ELSE {bare} END"
    path = rf"regexp_replace(regexp_replace({path}, '/(\./)+', '/', 'g'), '//+', '/', 'g')"
    for _ in range(3):
        path = rf"regexp_replace({path}, '/[^/]+/\.\./', '/')"
    return f"nullif(nfc_normalize('file://' || nullif({path}, '')), 'file://')"


def _step(number: int) -> str:
    """The row of each file in one run; names as written, collections kept apart."""
    return f"""run{number} AS (SELECT source_uri, r.hash AS hash, r.fingerprint AS fingerprint FROM (SELECT collection || '|' || source_uri AS source_uri, max({{'l': loaded_at, 'hash': hash, 'fingerprint': fingerprint}}) AS r
  FROM doc_snapshots WHERE snapshot_no = {number} AND source_uri IS NOT NULL GROUP BY 1))"""


_DIGEST = r"lower(regexp_replace(regexp_replace(hash, '^\s+|\s+$', '', 'g'), '^(?i:sha-?256)[:=]', ''))"
_BASE64 = r"lower(hex(from_base64(regexp_replace(regexp_replace(hash, '^\s+|\s+$', '', 'g'), '^sha256-', ''))))"

P3 = f"""WITH runs AS (SELECT collection, snapshot_no, lag(snapshot_no) OVER (PARTITION BY collection ORDER BY snapshot_no) AS prev, lead(snapshot_no) OVER (PARTITION BY collection ORDER BY snapshot_no) AS next FROM snapshot_runs WHERE status = 'complete'),
named AS (SELECT snapshot_no, collection, {name_of("source_uri")} AS source_uri, CASE WHEN regexp_matches(hash, '^\\s*sha256-') THEN {_BASE64} ELSE nullif({_DIGEST}, '') END AS hash, loaded_at
  FROM doc_snapshots SEMI JOIN runs USING (snapshot_no, collection)),
c AS (SELECT snapshot_no, collection, source_uri, arg_max({{'h': hash}}, loaded_at).h AS hash FROM named WHERE source_uri IS NOT NULL GROUP BY ALL),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY collection ORDER BY snapshot_no) AS n FROM runs),
rows AS (SELECT c.*, n, prev, next, n - row_number() OVER (PARTITION BY collection, source_uri ORDER BY snapshot_no) AS island FROM c JOIN numbered USING (collection, snapshot_no)),
known AS (SELECT *, last_value(hash IGNORE NULLS) OVER (PARTITION BY collection, source_uri, island ORDER BY snapshot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER (PARTITION BY collection, source_uri, island ORDER BY snapshot_no) AS place, row_number() OVER (PARTITION BY collection, source_uri, island ORDER BY snapshot_no DESC) AS place_back FROM rows)
SELECT snapshot_no, collection, source_uri, 'added' AS change_kind FROM known WHERE place = 1 AND prev IS NOT NULL
UNION ALL SELECT next, collection, source_uri, 'removed' FROM known WHERE place_back = 1 AND next IS NOT NULL
UNION ALL SELECT snapshot_no, collection, source_uri, 'changed' FROM known WHERE place > 1 AND hash <> before"""

# The state a file was left in, with the digest known by then, and that of the run that follows.
P3_OLD = P3.split("\nSELECT snapshot_no, collection, source_uri, 'added'")[0].replace("hash, loaded_at\n", "hash, loaded_at, ingested_at\n").replace("arg_max({'h': hash}, loaded_at).h AS hash", "arg_max({'h': hash, 'i': ingested_at}, loaded_at).h AS hash, arg_max({'h': hash, 'i': ingested_at}, loaded_at).i AS ingested_at") + """,
filled AS (SELECT *, coalesce(hash, before) AS after, lag(ingested_at) OVER (PARTITION BY collection, source_uri, island ORDER BY snapshot_no) AS ingested_before FROM known)
SELECT next AS snapshot_no, collection, source_uri, 'removed' AS change_kind, NULL AS hash, after AS old_hash, ingested_at AS old_ingested_at FROM filled WHERE place_back = 1 AND next IS NOT NULL
UNION ALL SELECT snapshot_no, collection, source_uri, 'changed', hash, before, ingested_before FROM filled WHERE place > 1 AND hash <> before"""


def _mmr(k: int, pool: int, weight: float) -> list[str]:
    """One pick after another: the best of what is left, then every likeness to it."""
    unit = lambda v: f"list_transform({v}.v, lambda x: x / {v}.norm)"
    parts = [
        f"left1 AS (SELECT n.query_id, n.chunk_id, round(n.score, 12) AS score, CASE WHEN e.norm > 0 THEN {unit('e')} END AS u, 0.0 AS nearest FROM near n LEFT JOIN vectors1 e USING (chunk_id) WHERE n.pos <= {pool})",
    ]
    for i in range(1, k + 1):
        value = f"{weight} * score - {1 - weight} * nearest"
        parts.append(f"pick{i} AS (SELECT query_id, unnest(arg_min({{'chunk_id': chunk_id, 'score': score, 'u': u}}, {{'a': -round({value}, 12), 'b': chunk_id}})) FROM left{i} GROUP BY query_id)")
        like = "coalesce(CASE WHEN len(l.u) = len(p.u) THEN list_inner_product(l.u, p.u) END, 0.0)"
        parts.append(f"left{i + 1} AS (SELECT l.query_id, l.chunk_id, l.score, l.u, greatest(l.nearest, {like}) AS nearest FROM left{i} l JOIN pick{i} p USING (query_id) WHERE l.chunk_id <> p.chunk_id)")
    return parts


_BLANK = rf"{_SPACE}\x1c-\x1f"
_SHORT = "etc vs cf al approx no fig eq inc ltd co corp dept mr mrs ms dr prof sr jr st"


def _claims(rows: str) -> list[str]:
    """Claims of ``rows`` (answer_id, text), in order: runs of characters, whether each ends its sentence, sentences without markers."""
    ends_none = f"(regexp_full_match(w, '[A-Za-z](\\.[A-Za-z])*') OR list_contains(string_split('{_SHORT}', ' '), lower(trim(w, '.'))))"
    return [
        f"runs AS (SELECT answer_id, unnest(r) AS r, generate_subscripts(r, 1) AS i FROM (SELECT answer_id, regexp_extract_all(text, '[^{_BLANK}]+[{_BLANK}]*') AS r FROM {rows}))",
        f"parts AS (SELECT answer_id, i, regexp_extract(r, '^[^{_BLANK}]+') AS run, regexp_extract(r, '[{_BLANK}]*$') AS space FROM runs)",
        "bared AS (SELECT *, rtrim(run, '.!?') AS bare, space <> '' AND rtrim(run, '.!?') <> run AS closed, lag(run) OVER (PARTITION BY answer_id ORDER BY i) AS before FROM parts)",
        f"first AS (SELECT *, CASE WHEN closed THEN NOT {ends_none} ELSE contains(space, chr(10)) END AS ends FROM (SELECT *, bare AS w FROM bared))",
        # Bare punctuation looks at the run before it, unless that ended its sentence.
        f"last AS (SELECT * REPLACE (CASE WHEN closed AND bare = '' THEN NOT {ends_none} ELSE ends END AS ends) FROM (SELECT * REPLACE (CASE WHEN lag(ends) OVER (PARTITION BY answer_id ORDER BY i) THEN '' ELSE coalesce(before, '') END AS w) FROM first))",
        "numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY answer_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM last)",
        f"said AS (SELECT answer_id, n, trim(regexp_replace(regexp_replace(string_agg(CASE WHEN ends AND closed THEN bare ELSE run END, ' ' ORDER BY i), '\\[[^\\[\\]]+\\]', '', 'g'), '[{_BLANK}]+', ' ', 'g'), ' ') AS claim FROM numbered GROUP BY answer_id, n)",
        "claims AS (SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY n) - 1)::INT AS pos, claim FROM said WHERE regexp_matches(claim, '\\p{L}'))",
    ]


def oracle_sql() -> dict[str, str]:
    second = "second AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM hits1)"
    expected = """best AS (SELECT query_id, split_part(arg_min(chunk_id, {'a': -score, 'b': chunk_id}), ':', 1) AS document_id FROM hits1 GROUP BY query_id),
expected AS (SELECT DISTINCT query_id, id AS chunk_id FROM best JOIN chunks1 USING (document_id)), rel AS (SELECT query_id, count(*) AS relevant FROM expected GROUP BY query_id),
judged AS (SELECT h.query_id, h.pos, (e.chunk_id IS NOT NULL)::INT AS rel FROM hits1 h LEFT JOIN expected e USING (query_id, chunk_id)),
per AS (SELECT query_id, sum(rel) FILTER (pos <= 10) AS found, count(*) FILTER (pos <= 10) AS returned, min(pos) FILTER (rel = 1) AS first, sum(rel / log2(pos + 1)) FILTER (pos <= 10) AS gain FROM judged GROUP BY query_id),
m AS (SELECT query_id, coalesce(found, 0) / relevant AS recall, CASE WHEN returned > 0 THEN found / returned ELSE 0.0 END AS precision, coalesce(1.0 / first, 0.0) AS mrr,
  coalesce(gain, 0.0) / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, (coalesce(found, 0) > 0)::INT::DOUBLE AS hit_rate FROM rel LEFT JOIN per USING (query_id))"""
    near_out = "SELECT query_id, chunk_id, round(score, 6) AS score, pos FROM near"
    fused = """lists AS (SELECT query_id, chunk_id, pos FROM near UNION ALL SELECT query_id, chunk_id, pos FROM lexical),
total AS (SELECT query_id, chunk_id, sum(1 / (60 + pos)) AS rrf FROM lists GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, chunk_id)::INT AS pos FROM total)"""
    return {
        "p3_found": P3,
        "p3_old_values": P3_OLD,
        # A null hash makes no change, so the runs' differences are the changes of problem 3.
        "collection_diff_all": f"SELECT snapshot_no, collection, source_uri, change_kind AS status FROM ({P3})",
        "ingest_outcomes_all": P3.split("\nSELECT snapshot_no, collection, source_uri, 'added'")[0].replace("hash, loaded_at\n", "hash, loaded_at, fingerprint\n").replace("arg_max({'h': hash}, loaded_at).h AS hash", "arg_max({'h': hash, 'i': fingerprint}, loaded_at).h AS hash, arg_max({'h': hash, 'i': fingerprint}, loaded_at).i AS fingerprint") + """,
filled AS (SELECT *, coalesce(hash, before, first_value(hash IGNORE NULLS) OVER (PARTITION BY collection, source_uri, island ORDER BY snapshot_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS h FROM known),
pairs AS (SELECT *, lag(h) OVER w AS old_h, lag(fingerprint) OVER w AS old_f FROM filled WINDOW w AS (PARTITION BY collection, source_uri, island ORDER BY snapshot_no))
SELECT snapshot_no, collection, CASE WHEN place = 1 THEN 'new' WHEN fingerprint <> '' AND fingerprint = old_f THEN 'unchanged' WHEN h = old_h THEN 'refreshed' ELSE 'changed' END AS outcome, count(*) AS documents FROM pairs WHERE prev IS NOT NULL GROUP BY ALL""",
        "mmr_select": _with(VECTORS, ASKING, _near(50), *_mmr(8, 50, 0.5), select=" UNION ALL ".join(f"SELECT query_id, chunk_id, round(score, 6) AS score, {i}::INT AS pos FROM pick{i}" for i in range(1, 9))),
        "hits_as_json": _with(
            HITS, r"""digits AS (SELECT *, CASE WHEN score = 0 OR abs(score) >= 0.001 THEN score::VARCHAR WHEN score::VARCHAR LIKE '%e%' THEN regexp_replace(regexp_replace(score::VARCHAR, 'e-0?', 'E-'), '^(-?\d)E', '\1.0E')
  ELSE CASE WHEN score < 0 THEN '-' ELSE '' END || regexp_extract(score::VARCHAR, '0\.0*([1-9])', 1) || '.' || coalesce(nullif(regexp_extract(score::VARCHAR, '0\.0*[1-9](\d*)', 1), ''), '0') || 'E-' || (len(regexp_extract(score::VARCHAR, '0\.(0*)', 1)) + 1) END AS shown FROM hits1)""",
            select="""SELECT query_id, '[' || string_agg('{"chunk_id":' || to_json(chunk_id) || ',"score":' || shown || coalesce(',"source":' || to_json(source), '') || '}', ',' ORDER BY pos) || ']' AS json FROM digits GROUP BY query_id"""),
        "cross_collection_topk_all": _with(
            VECTORS, ASKING, f"spaced AS (SELECT e.*, c.model, c.dimensions FROM vectors1 e JOIN collections c ON c.name = e.collection), every AS (SELECT q.query_id, e.collection, e.chunk_id, {COSINE} AS score FROM asking q JOIN collections c ON c.name = q.collection JOIN spaced e ON e.model = c.model AND e.dimensions = c.dimensions)",
            select="SELECT query_id, chunk_id, round(score, 6) AS score, collection, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id)::INT AS pos FROM every) WHERE pos <= 8"),
        "similarity_join_all": _with(
            VECTORS, "others AS (SELECT a.name AS collection, b.name AS target FROM collections a JOIN collections b ON a.model = b.model AND a.dimensions = b.dimensions AND a.name <> b.name)",
            "asked AS (SELECT v.chunk_id AS query_id, v.collection, o.target, v.v, v.norm FROM vectors1 v LEFT JOIN others o USING (collection))",
            f"every AS (SELECT q.query_id, q.collection, q.target, e.chunk_id, {COSINE} AS score FROM asked q LEFT JOIN vectors1 e ON e.collection = q.target)",
            select="SELECT query_id, collection, target, chunk_id, CASE WHEN chunk_id IS NOT NULL THEN round(score, 6) END AS score, CASE WHEN chunk_id IS NOT NULL THEN pos END AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY round(score, 12) DESC, chunk_id)::INT AS pos FROM every) WHERE pos <= 3"),
        "cosine_topk": _with(VECTORS, ASKING, _near(8), select=near_out),
        "cosine_topk_filtered": _with(
            VECTORS, ASKING, DOCS,
            "passing AS (SELECT v.* FROM vectors1 v JOIN docs1 d ON d.id = split_part(v.chunk_id, ':', 1) WHERE len(list_filter(string_split(lower(d.metadata['tags']), ','), lambda t: trim(t) LIKE 's%' AND trim(t) NOT LIKE '%/%')) > 0)",
            _near(8, "passing"), select=near_out),
        "cosine_explain": _with(VECTORS, ASKING, _near(9), select="SELECT * FROM (SELECT query_id, chunk_id, round(score, 6) AS score, pos, round(max(score) FILTER (pos = 9) OVER (PARTITION BY query_id), 6) AS runner_up FROM near) WHERE pos <= 8"),
        "cross_collection_topk": _with(
            VECTORS, ASKING, f"every AS (SELECT q.query_id, e.collection, e.chunk_id, {COSINE} AS score FROM asking q, vectors1 e WHERE q.collection = 'handbook' AND e.collection IN (SELECT name FROM collections WHERE dimensions = 64))",
            select="SELECT query_id, chunk_id, round(score, 6) AS score, collection, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id)::INT AS pos FROM every) WHERE pos <= 8"),
        "similarity_join": _with(VECTORS, "pairs AS (SELECT chunk_id AS query_id, 'team-blog' AS collection, v, norm FROM vectors1 WHERE collection = 'handbook')", _near(3, asking="pairs"), select="SELECT query_id, chunk_id, round(score, 6) AS score, pos FROM pairs LEFT JOIN near USING (query_id)"),
        "bm25_topk": _with(CHUNKS, QUESTIONS, _bm25(8), select="SELECT query_id, chunk_id, round(score, 6) AS score, pos FROM lexical"),
        "bm25_filtered": _with(CHUNKS, QUESTIONS, _bm25(8, "seq >= 2"), select="SELECT query_id, chunk_id, round(score, 6) AS score, pos FROM lexical"),
        "hybrid_rrf": _with(CHUNKS, QUESTIONS, VECTORS, ASKING.replace(" WHERE ", " WHERE chunk_id IN (SELECT query_id FROM questions) AND "), _near(50), _bm25(50), fused, select="SELECT r.query_id, r.chunk_id, round(r.rrf, 6) AS rrf, r.pos, round(coalesce(n.score, 0.0), 6) AS score FROM ranked r LEFT JOIN near n USING (query_id, chunk_id) WHERE r.pos <= 8"),
        "rerank_pool": _with(
            CHUNKS, QUESTIONS, _bm25(20),
            f"part AS (SELECT l.query_id, l.chunk_id, l.score, l.pos AS p, len(list_intersect(list_distinct({TERMS.format('q.text')}), list_distinct({TERMS.format('c.text')}))) / greatest(1, len(list_distinct({TERMS.format('q.text')}))) AS r FROM lexical l JOIN questions q USING (query_id) JOIN chunks1 c ON c.id = l.chunk_id)",
            select="SELECT query_id, chunk_id, round(score, 6) AS score, round(r, 6) AS rerank_score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, p)::INT AS pos FROM part) WHERE pos <= 8"),
        "claim_segments": _with("docs AS (SELECT doc_id AS answer_id, text FROM documents)", *_claims("docs"), select="SELECT answer_id, pos, claim, 'uncited' AS verdict FROM claims"),
        # No chunk marks one of its own ids, so all its claims are judged against all that it cites.
        "judged_claims": _with(
            CHUNKS, "answers AS (SELECT id AS answer_id, text FROM chunks1)", *_claims("answers"),
            f"held AS (SELECT a.id AS answer_id, list_distinct(list_concat(coalesce({TERMS.format('a.text')}, []), coalesce({TERMS.format('b.text')}, []))) AS e FROM chunks1 a LEFT JOIN chunks1 b ON b.id = a.document_id || ':0')",
            f"judged AS (SELECT answer_id, len(t) > 0 AND len(list_intersect(t, e)) / greatest(1, len(t)) >= 0.6 AS ok FROM (SELECT answer_id, list_distinct({TERMS.format('claim')}) AS t, e FROM claims JOIN held USING (answer_id)))",
            select="SELECT a.id AS answer_id, count(ok) AS claims, count(*) FILTER (ok) AS supported, CASE WHEN count(ok) > 0 THEN round(count(*) FILTER (ok) / count(ok), 6) ELSE 1.0 END AS rate, count(*) FILTER (ok) = count(ok) AS all_supported FROM chunks1 a LEFT JOIN judged j ON j.answer_id = a.id GROUP BY a.id"),
        "fuse_lists": _with(HITS, second, "total AS (SELECT query_id, chunk_id, sum(1 / (60 + pos)) AS rrf FROM (SELECT query_id, chunk_id, pos FROM hits1 UNION ALL FROM second) GROUP BY ALL)", select="SELECT query_id, chunk_id, round(rrf, 6) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, chunk_id)::INT AS pos FROM total"),
        "source_glob_overfetch": _with(
            VECTORS, ASKING, CHUNKS, DOCS, _near(80),
            r"kept AS (SELECT n.query_id, n.chunk_id, coalesce(d.source_uri, '') AS source, n.score, n.pos AS p FROM near n JOIN chunks1 c ON c.id = n.chunk_id LEFT JOIN docs1 d ON d.id = c.document_id WHERE regexp_matches(coalesce(d.source_uri, ''), '(^|/)[^/]*-[0-9][^/]*\.md$'))",
            select="SELECT query_id, chunk_id, source, round(score, 6) AS score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p)::INT AS pos FROM kept) WHERE pos <= 8"),
        "hydrate_hits": _with(HITS, CHUNKS, DOCS, select="SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.pos)::INT AS pos, h.chunk_id, c.document_id, c.seq, coalesce(d.source_uri, '') AS source, round(h.score, 6) AS score, length(c.text)::INT AS chars FROM hits1 h JOIN chunks1 c ON c.id = h.chunk_id LEFT JOIN docs1 d ON d.id = c.document_id"),
        "cap_per_source": _with(HITS, select="SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS place FROM hits1) WHERE place <= 2"),
        "token_budget": _with(
            HITS, CHUNKS, f"priced AS (SELECT h.query_id, h.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY h.pos)::INT AS pos, coalesce(len(list_filter(string_split_regex(c.text, '[{_SPACE}]+'), lambda x: x <> '')), 0) AS tokens FROM hits1 h JOIN chunks1 c ON c.id = h.chunk_id)",
            select="SELECT * FROM (SELECT query_id, chunk_id, pos, (sum(tokens) OVER (PARTITION BY query_id ORDER BY pos))::BIGINT AS used_tokens FROM priced) WHERE used_tokens <= 600 OR pos = 1"),
        "recency_decay": _with(
            HITS, "aged AS (SELECT *, score * CASE WHEN ingested_at < TIMESTAMP '2025-06-14' THEN pow(2.0, -((epoch_us(TIMESTAMP '2025-06-14') - epoch_us(ingested_at)) / (86400 * 1e6)) / 90.0) ELSE 1.0 END AS adjusted FROM hits1)",
            select="SELECT query_id, chunk_id, round(score, 6) AS score, place AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, pos)::INT AS place FROM aged) WHERE place <= 8"),
        "score_distribution": _with(
            HITS, "used AS (SELECT query_id, CASE WHEN max((pos = 1 AND rerank_score IS NOT NULL)::INT) OVER (PARTITION BY query_id) = 1 THEN coalesce(rerank_score, 0.0) ELSE score END AS s FROM hits1)",
            select="SELECT query_id, count(*) AS hits, round(min(s), 6) AS least, round(max(s), 6) AS greatest, round(avg(s), 12) AS mean FROM used GROUP BY query_id"),
        "where_numeric": _with(DOCS, select="SELECT id, source_uri FROM docs1 WHERE split_part(fingerprint, ':', 1)::DOUBLE >= 1500 AND split_part(fingerprint, ':', 1)::DOUBLE < 20000"),
        "where_date": _with(DOCS, select=f"SELECT id, source_uri FROM docs1 WHERE coalesce({_parsed("metadata['mtime']")} >= TIMESTAMP '2025-01-01' AND {_parsed("metadata['mtime']")} < TIMESTAMP '2025-07-01 12:00:00', false)"),
        "where_tags": _with(DOCS, select="SELECT id, source_uri FROM docs1 WHERE len(list_filter(string_split(lower(metadata['tags']), ','), lambda t: regexp_matches(trim(t), '^[m-s][^/]*$'))) > 0 AND coalesce(metadata['author'] <> 'u-1', false)"),
        "inferred_time": _with(
            DOCS,
            select=f"SELECT id, coalesce({', '.join(_key(k) for k in ('updated', 'updated_at', 'modified', 'last_modified', 'lastmod'))}, {_parsed("metadata['mtime']")}, {PATH_TIME}, {', '.join(_key(k) for k in ('created', 'created_at', 'date', 'published', 'publishdate', 'publish_date'))}, ingested_at) AS told_at FROM docs1"),
        "path_date": _with(DOCS, select=f"SELECT id, {PATH_TIME} AS named_at FROM docs1 WHERE {PATH_TIME} IS NOT NULL"),
        "term_statistics": _with(CHUNKS, f"post AS (SELECT collection, id, term, count(*) AS tf FROM (SELECT collection, id, unnest({TERMS.format('text')}) AS term FROM chunks1) GROUP BY ALL)", select="SELECT collection, term, count(*) AS df, sum(tf)::BIGINT AS total FROM post GROUP BY ALL"),
        "chunk_lengths": _with(CHUNKS, select=f"SELECT id, coalesce(len({TERMS.format('text')}), 0)::INT AS len FROM chunks1"),
        "fixed_chunks": f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[{_SPACE}]+'), lambda x: x <> '') AS words FROM documents),
cut AS (SELECT doc_id, words, unnest(range(0, greatest(0, ceil((len(words) - 128) / 112))::INT + 1)) AS seq FROM w WHERE len(words) > 0)
SELECT doc_id, seq::INT AS seq, sha256(array_to_string(words[seq * 112 + 1 : seq * 112 + 128], ' ')) AS text_hash FROM cut""",
        "document_identity": _with(DOCS, select="SELECT id, sha256(collection || chr(0) || source_uri) = id AS holds FROM docs1"),
        "corpus_digest": _with(DOCS, select="SELECT collection, sha256(string_agg(source_uri || chr(0) || hash || chr(0), '' ORDER BY source_uri, hash)) AS digest, max(ingested_at) AS last_ingest FROM docs1 GROUP BY collection"),
        "collection_diff": _with(_step(4), _step(5), select="SELECT source_uri, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS status FROM (SELECT *, 1 AS k FROM run4) a FULL JOIN (SELECT *, 1 AS k FROM run5) b USING (source_uri) WHERE a.k IS NULL OR b.k IS NULL OR a.hash IS DISTINCT FROM b.hash"),
        "prune_set": _with(DOCS, select="SELECT id, source_uri FROM docs1 d WHERE NOT EXISTS (SELECT 1 FROM doc_snapshots s WHERE s.source_uri = d.source_uri)"),
        "ingest_outcomes": _with(_step(5), _step(6), select="SELECT CASE WHEN b.source_uri IS NULL THEN 'new' WHEN a.fingerprint <> '' AND a.fingerprint = b.fingerprint THEN 'unchanged' WHEN a.hash = b.hash THEN 'refreshed' ELSE 'changed' END AS outcome, count(*) AS documents FROM run6 a LEFT JOIN run5 b USING (source_uri) GROUP BY 1"),
        "collection_status": _with(DOCS, VECTORS, select="SELECT c.name AS collection, coalesce(d.n, 0) AS documents, d.last_ingest, coalesce(v.n, 0) AS chunks FROM collections c LEFT JOIN (SELECT collection, count(*) AS n, max(ingested_at) AS last_ingest FROM docs1 GROUP BY 1) d ON d.collection = c.name LEFT JOIN (SELECT collection, count(*) AS n FROM vectors1 GROUP BY 1) v ON v.collection = c.name"),
        "orphan_chunks": _with(CHUNKS, DOCS, select="SELECT id, document_id FROM chunks1 c WHERE NOT EXISTS (SELECT 1 FROM docs1 d WHERE d.id = c.document_id)"),
        "document_select": _with(DOCS, select=r"SELECT id, source_uri, regexp_extract(source_uri, '[^/]*$') AS name FROM docs1 WHERE regexp_matches(source_uri, '\.csv$')"),
        "eval_questions": _with(HITS, CHUNKS, expected, select="SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(hit_rate, 6) AS hit_rate FROM m"),
        "eval_means": _with(HITS, CHUNKS, expected, select="SELECT count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hit_rate), 6) AS hit_rate FROM m"),
        "lookup_chunks": _with(HITS, CHUNKS, select="SELECT h.query_id, h.pos AS idx, c.id, c.collection, c.seq FROM hits1 h JOIN chunks1 c ON c.id = h.chunk_id"),
        "front_matter": r"""WITH m AS (SELECT doc_id, regexp_extract(text, '^---[ \t]*\n((?s:.*?)\n)?---[ \t]*(\n|$)', 1) AS head FROM (SELECT doc_id, content_type, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents) WHERE content_type = 'text/markdown' AND regexp_matches(text, '^---[ \t]*\n')),
t AS (SELECT doc_id, regexp_extract_all(head, '(?m)^title:(.*)$', 1)[-1] AS title FROM m) SELECT doc_id, trim(title, ' ') AS title FROM t WHERE title IS NOT NULL""",
        "answer_prompts": _with(
            CHUNKS, DOCS, QUESTIONS, _bm25(3),
            r"full_ AS (SELECT l.query_id, l.pos, c.text, coalesce(d.source_uri, '') AS source FROM lexical l JOIN chunks1 c ON c.id = l.chunk_id LEFT JOIN docs1 d ON d.id = c.document_id)",
            "parts AS (SELECT query_id, string_agg('[' || pos || '] (' || regexp_extract(source, '[^/]*$') || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS p FROM full_ GROUP BY query_id)",
            select="SELECT query_id, sha256(p || chr(10) || chr(10) || 'Question: ' || text) AS prompt_hash FROM parts JOIN questions USING (query_id)"),
        "eval_sources": _with(
            HITS, "h AS (SELECT * FROM hits1 WHERE source <> '')", "best AS (SELECT query_id, arg_min(source, {'a': -score, 'b': chunk_id, 'c': source}) AS source FROM h GROUP BY query_id)",
            "f AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(pos), source) AS place FROM h GROUP BY query_id, source)",
            "m AS (SELECT query_id, place, count(*) OVER (PARTITION BY query_id) AS n, f.source = b.source AS hit FROM f JOIN best b USING (query_id))",
            select="SELECT query_id, CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END AS recall, round(CASE WHEN place <= 5 THEN 1.0 / least(n, 5) ELSE 0.0 END, 6) AS precision, round(1.0 / place, 6) AS mrr, round(CASE WHEN place <= 5 THEN 1 / log2(place + 1) ELSE 0.0 END, 6) AS ndcg, CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END AS hit_rate FROM m WHERE hit"),
        "support_rate": _with(
            CHUNKS,
            f"""pairs AS (SELECT document_id, list_distinct({TERMS.format('text')}) AS a, list_distinct({TERMS.format('evidence')}) AS b FROM (SELECT *, lag(text) OVER (PARTITION BY document_id ORDER BY seq, id) AS evidence FROM chunks1) WHERE evidence IS NOT NULL),
judged AS (SELECT document_id AS answer_id, coalesce(len(list_intersect(a, b)), 0) / greatest(coalesce(len(a), 0), 1) >= 0.2 AS ok FROM pairs)""",
            select="SELECT answer_id, count(*) AS claims, count(*) FILTER (ok) AS supported, round(count(*) FILTER (ok) / count(*), 6) AS rate, bool_and(ok) AS all_supported FROM judged GROUP BY answer_id"),
    }
