"""SQL counterparts of the queries on training data, where SQL can say them."""

from __future__ import annotations

import string

from corpusmill.plans.sql import _SPACE, name_of

P1_RANKED = f"""WITH last AS (SELECT query_id, chunk_id, unnest(r) FROM (SELECT query_id, chunk_id, arg_max({{'score': score, 'source': source}}, logged_at) AS r FROM hits GROUP BY ALL)),
docs AS (SELECT id, any_value({name_of("source_uri")}) AS file FROM (SELECT id, source_uri FROM source_docs UNION ALL SELECT id, source_uri FROM shared_docs) GROUP BY id),
named AS (SELECT query_id, chunk_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, coalesce({name_of("l.source")}, file, 'document:' || split_part(chunk_id, ':', 1)) AS name FROM last l LEFT JOIN docs ON docs.id = split_part(chunk_id, ':', 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY score DESC NULLS LAST, chunk_id) AS place FROM named)"""

P4_PAIRS = """WITH usable AS (SELECT DISTINCT v.chunk_id, v.collection, v.vector::DOUBLE[] AS v FROM vectors v JOIN collections c ON c.name = v.collection WHERE len(vector) = c.dimensions AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM usable WHERE list_inner_product(v, v) > 0),
pairs AS (SELECT a.collection, a.chunk_id AS a, b.chunk_id AS b, round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 12) AS s FROM n a JOIN n b ON a.collection = b.collection AND a.chunk_id <> b.chunk_id)"""


def _parent(name: str) -> str:
    return f"CASE WHEN regexp_matches({name}, '^.+/[^/]+$') THEN regexp_extract({name}, '^(.+)/[^/]+$', 1) ELSE {name} END"


_BARE = r"""regexp_replace(regexp_replace(text, '(?i)</?(?:a|abbr|b|big|code|em|font|i|ins|mark|s|small|span|strong|sub|sup|tt|u|wbr)\b[^<>]*>', '', 'g'), '(?is)<!--.*?-->|</?[a-z!?][^<>]*>', ' ', 'g')"""
_ENTITIES = [("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("auml", "ä"), ("ouml", "ö"), ("uuml", "ü"), ("szlig", "ss"), ("eacute", "é"), ("egrave", "è"), ("ntilde", "ñ")]
for _name, _sign in [*_ENTITIES, *((f"#{ord(c)}", c) for c in "äöüßÄÖÜáéíóúñàâçèêëîïôûùÁÉÍÓÚÑÀÂÇÈÊÎÔ¿¡"), ("amp", "&")]:
    _BARE = f"replace({_BARE}, '&{_name};', '{_sign}')"
# Full-width digits and letters.
_WIDE = "".join(chr(0xFEE0 + ord(c)) for c in string.digits + string.ascii_letters)
_PLAIN_LETTERS = string.digits + string.ascii_letters
P2_TEXT = rf"""replace(lower(strip_accents(translate(regexp_replace({_BARE}, '[\x{{ad}}\x{{34f}}\x{{61c}}\x{{180b}}-\x{{180f}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{206f}}\x{{fe00}}-\x{{fe0f}}\x{{feff}}]', '', 'g'), '{_WIDE}', '{_PLAIN_LETTERS}'))), 'ß', 'ss')"""

# Words by plain means; pairs that count lie well above 60 %, others clearly below.
P2_LINKS = f"""WITH t AS (SELECT DISTINCT id, {P2_TEXT} AS text FROM chunks WHERE id IS NOT NULL),
w AS (SELECT DISTINCT id, text, unnest(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS word FROM t),
n AS (SELECT id, text, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT row_number() OVER (ORDER BY id, text) AS k, * FROM n), wk AS (SELECT k, n, word FROM w JOIN k USING (id, text)),
met AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM wk a JOIN wk b ON a.word = b.word AND a.k < b.k AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    words = f"len(list_filter(string_split_regex(text, '[{_SPACE}]+'), lambda x: x <> ''))"
    return {
        "p1_found": P1_RANKED + " SELECT query_id, chunk_id FROM ranked WHERE place > 3",
        "p1_nested": P1_RANKED + f""",
f AS (SELECT *, {_parent("name")} AS folder FROM ranked), w AS (SELECT *, {_parent("folder")} AS workspace, CASE WHEN place > 3 THEN 0 END AS d FROM f),
b AS (SELECT * REPLACE (CASE WHEN d IS NULL AND row_number() OVER (PARTITION BY query_id, folder, d IS NULL ORDER BY score DESC NULLS LAST, chunk_id) > 5 THEN 1 ELSE d END AS d), count(*) OVER (PARTITION BY query_id) AS n FROM w)
SELECT query_id, chunk_id, name AS source_file, CASE WHEN d IS NULL AND row_number() OVER (PARTITION BY query_id, workspace, d IS NULL ORDER BY score DESC NULLS LAST, chunk_id) > greatest(floor(n * 0.4), 1) THEN 2 ELSE d END AS dropped_by FROM b""",
        "p2_found": P2_LINKS + " SELECT DISTINCT least(x.id, y.id) AS chunk_id_a, greatest(x.id, y.id) AS chunk_id_b FROM met JOIN k x ON x.k = a JOIN k y ON y.k = b WHERE c >= 0.6 * (x.n + y.n - c) AND x.id <> y.id",
        "p2_groups": P2_LINKS.replace("WITH t AS", "WITH RECURSIVE t AS") + """,
sets AS (SELECT id, text, string_agg(word, ' ' ORDER BY word) AS cls FROM w GROUP BY ALL),
classes AS (SELECT cls, min(id) AS rep, count(DISTINCT id) AS copies FROM sets GROUP BY cls),
of AS (SELECT k.k, cls, rep, copies FROM k JOIN sets USING (id, text) JOIN classes USING (cls)),
links AS (SELECT DISTINCT x.rep AS u, y.rep AS v, x.cls AS cu, y.cls AS cv FROM met JOIN k p ON p.k = a JOIN k q ON q.k = b JOIN of x ON x.k = a JOIN of y ON y.k = b WHERE c >= 0.6 * (p.n + q.n - c) AND x.cls <> y.cls),
both_ways AS (SELECT u, v, cv FROM links UNION SELECT v, u, cu FROM links),
reach(u, v) AS (SELECT DISTINCT u, v FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON e.u = r.v),
roots AS (SELECT u, least(u, min(v)) AS root FROM reach GROUP BY u),
degree AS (SELECT u, count(DISTINCT least(u, v) || greatest(u, v)) AS n FROM both_ways GROUP BY u)
SELECT DISTINCT s.id AS chunk_id, c.rep AS class_id, c.copies, coalesce(d.n, 0) AS links, coalesce(r.root, c.rep) AS group_id FROM sets s JOIN classes c USING (cls) LEFT JOIN roots r ON r.u = c.rep LEFT JOIN degree d ON d.u = c.rep""",
        "p1_dominance": P1_RANKED + " SELECT name AS source_file, count(*) AS hits, count(*) FILTER (place > 3) AS dropped FROM ranked GROUP BY name",
        # At sf0.01 every cell is visited, so that the answer is exact there.
        "p4_neighbours": P4_PAIRS.replace("AND a.chunk_id <> b.chunk_id", "AND a.chunk_id <> b.chunk_id AND split_part(a.chunk_id, ':', 2)::INT % 20 = 0") + """,
top AS (SELECT *, row_number() OVER (PARTITION BY collection, a ORDER BY s DESC, b)::INT AS place FROM pairs)
SELECT collection, a AS chunk_id, place, b AS neighbour, round(s, 6) AS similarity FROM top WHERE place <= 5""",
        "p4_found": P4_PAIRS + """,
top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM pairs WHERE s >= 0.9)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM top WHERE place <= 5""",
        "p5_sizes": f"""WITH cut AS (SELECT DISTINCT id, collection, {words} AS n FROM chunks JOIN collections c ON c.name = collection WHERE c.chunker_size > 0 AND {words} > c.chunker_size)
SELECT collection, count(*) AS texts, sum(n) AS words, max(n) AS longest FROM cut GROUP BY collection""",
        "p7_held": f"""WITH keyed AS (SELECT nullif(regexp_replace(regexp_replace(lower(source), '[{_SPACE}_-]+', '-', 'g'), '^-|-$', '', 'g'), '') AS source, text FROM documents),
held AS (SELECT source, count(*) AS n FROM keyed WHERE text <> '' GROUP BY source),
wanted AS (SELECT nullif(regexp_replace(regexp_replace(lower(source), '[{_SPACE}_-]+', '-', 'g'), '^-|-$', '', 'g'), '') AS source, sum(target_weight) AS w, max(greatest(coalesce(max_repeats, 1), 0)) AS r FROM mix_targets WHERE target_weight > 0 GROUP BY 1)
SELECT source, round(w / (SELECT sum(w) FROM wanted), 6) AS target_weight, r AS max_repeats, coalesce(n, 0) AS held_docs FROM wanted LEFT JOIN held USING (source) WHERE source IS NOT NULL""",
        "p5_found": f"SELECT DISTINCT id AS chunk_id FROM chunks JOIN collections c ON c.name = collection WHERE c.chunker_size > 0 AND {words} > c.chunker_size",
    }
