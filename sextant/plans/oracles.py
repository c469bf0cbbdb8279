"""SQL for the queries of the catalogue, written from their definitions."""

from __future__ import annotations

TOKEN = r"[\p{L}\p{N}_]+"
TERMS = ("queue", "index", "filter")

CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch, id ORDER BY seq DESC) AS rn FROM chunks) WHERE rn = 1)"
DOCS = "(SELECT doc_id AS seq, text, source AS repo FROM documents)"


def _bm25(rows: str, where: str = "true", terms: tuple[str, ...] = TERMS) -> str:
    """CTEs t (tokens), st (statistics), df, and b (seq, score) of all matching rows."""
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""
src AS (SELECT * FROM {rows}),
t AS (SELECT seq, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM src),
st AS (SELECT count(*)::DOUBLE AS nd, avg(len(w)) AS av FROM t),
q AS (SELECT seq, len(w) AS dl, u.term, len(list_filter(w, lambda x: x = u.term)) AS f FROM t, (SELECT unnest([{wanted}]) AS term) u),
df AS (SELECT term, count(*)::DOUBLE AS df FROM q WHERE f > 0 GROUP BY term),
b AS (SELECT q.seq, sum(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f / (f + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / av))) AS score
      FROM q JOIN df USING (term) CROSS JOIN st JOIN (SELECT seq AS kept FROM src WHERE {where}) k ON k.kept = q.seq WHERE f > 0 GROUP BY q.seq)"""


_HASH = """
hq AS (SELECT unnest(['queue', 'index', 'filter']) AS tok),
hd AS (SELECT seq, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS tok FROM src),
hash AS (SELECT tok, list_reduce(list_prepend(1::BIGINT, list_transform(string_split(tok, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: (a * 31 + x) & 4294967295) AS h FROM (SELECT tok FROM hq UNION SELECT tok FROM hd)),
bucket AS (SELECT tok, (((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 384) + 384) % 384 AS b FROM hash),
dv AS (SELECT seq, b, count(*)::DOUBLE AS n FROM hd JOIN bucket USING (tok) GROUP BY 1, 2),
qv AS (SELECT b, count(*)::DOUBLE AS n FROM hq JOIN bucket USING (tok) GROUP BY 1),
dn AS (SELECT seq, sqrt(sum(n * n)) AS l FROM dv GROUP BY 1),
s AS (SELECT dn.seq, (1 + coalesce(sum(dv.n * qv.n), 0) / (any_value(l) * (SELECT sqrt(sum(n * n)) FROM qv))) / 2 AS score
      FROM dn LEFT JOIN dv ON dv.seq = dn.seq LEFT JOIN qv ON qv.b = dv.b GROUP BY dn.seq)"""

_HEADING = "coalesce(title, path)"


def _hybrid(terms: tuple[str, ...], where: str, k: int) -> str:
    """Hits of a search over current chunks by both legs, k of them, without reranking."""
    hashed = _HASH.replace("['queue', 'index', 'filter']", str(list(terms)))
    near = _RRF.replace("FROM s QUALIFY", f"FROM s JOIN (SELECT seq FROM src WHERE {where}) USING (seq) QUALIFY")
    return f"""
WITH {_bm25(CURRENT, where, terms)}, {hashed}, {near}
SELECT id, repo, path, domain, type, fqn, title, section, {SNIPPET.replace("text", "coalesce(text, '')")} AS snippet, round(rk.score, 6) AS score, round(rrf, 6) AS rrf_score, rank
FROM rk JOIN src USING (seq) WHERE rank <= {k}"""


_RRF = f"""
bl AS (SELECT seq, score, row_number() OVER (ORDER BY score DESC, seq) AS r FROM b QUALIFY r <= 50),
kl AS (SELECT seq, score, row_number() OVER (ORDER BY score DESC, seq) AS r FROM s QUALIFY r <= 50),
fu AS (SELECT coalesce(bl.seq, kl.seq) AS seq, coalesce(bl.score, kl.score) AS score, bl.r AS br, kl.r AS kr,
       coalesce(1.0::DOUBLE / (60 + bl.r), 0) + coalesce(1.0::DOUBLE / (60 + kl.r), 0) AS rrf FROM bl FULL JOIN kl ON bl.seq = kl.seq),
rk AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, br NULLS LAST, kr NULLS LAST, seq) AS rank FROM fu)"""

SNIPPET = """CASE WHEN length(text) <= 500 THEN text
 WHEN strpos(substring(text, 1, 501), ' ') > 0 AND 501 - strpos(reverse(substring(text, 1, 501)), ' ') > 0
 THEN substring(text, 1, 501 - strpos(reverse(substring(text, 1, 501)), ' ')) || '...'
 ELSE substring(text, 1, 500) || '...' END"""


def _knn(rows: str, query: str, where: str) -> str:
    return f"""
WITH q AS (SELECT {query} AS v), r AS (SELECT * FROM {rows}),
c AS (SELECT seq, list_dot_product(vector::DOUBLE[], q.v) / (sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v))) AS c
      FROM (SELECT * FROM r WHERE {where} AND len(vector) = 64 AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0) CROSS JOIN q)
SELECT seq, round((1 + c) / 2, 6) AS score FROM c ORDER BY c DESC, seq LIMIT 10"""


_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
_EMBEDDINGS = "(SELECT vec_id AS seq, embedding AS vector, label FROM embeddings)"

NODES = """
n AS (SELECT * FROM graph_events WHERE kind = 'N'),
lastn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM n) WHERE rn = 1),
firstn AS (SELECT id, min(seq) AS first FROM n GROUP BY id),
tg AS (SELECT id, unnest(tags) AS tag FROM n UNION SELECT e.id, e.tag FROM graph_events e JOIN firstn f ON e.id = f.id WHERE e.kind = 'T' AND e.seq > f.first),
tl AS (SELECT id, string_agg(tag, '|' ORDER BY tag) AS tags FROM (SELECT DISTINCT id, tag FROM tg WHERE tag IS NOT NULL) GROUP BY id),
nodes AS (SELECT l.id, l.label, coalesce(tl.tags, '') AS tags, l.signature, l.javadoc FROM lastn l LEFT JOIN tl ON tl.id = l.id),
edges AS (SELECT src, dst, edge_type AS type, seq FROM graph_events WHERE kind = 'E' AND src IS NOT NULL AND dst IS NOT NULL)"""


def _tag(t: str) -> str:
    return f"list_contains(string_split(tags, '|'), '{t}')"


def _bfs(steps: str, seed: str, depth: int) -> str:
    return f"""
WITH RECURSIVE {NODES},
steps AS ({steps}),
walk AS (SELECT {seed} AS id, 0 AS depth UNION SELECT s.b, w.depth + 1 FROM walk w JOIN steps s ON s.a = w.id WHERE w.depth < {depth})
SELECT f.id, coalesce(nodes.signature, f.id) AS signature, f.depth FROM (SELECT id, min(depth)::BIGINT AS depth FROM walk GROUP BY id) f
LEFT JOIN nodes ON nodes.id = f.id WHERE f.depth > 0"""


_SEED = "(SELECT min(id) FROM nodes WHERE label = '{}')"
_SLUG = "CASE WHEN title IS NULL OR trim(title) = '' THEN 'body' ELSE regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g') END"
_SPEC = f"SELECT DISTINCT fqn AS id FROM {CURRENT} WHERE type = 'OPENAPI_OP' AND fqn IS NOT NULL"
_KEYS = f"SELECT id FROM nodes WHERE {_tag('ENDPOINT')} AND id IN (SELECT dst FROM edges WHERE type = 'EXPOSES')"

_FITS = """CASE WHEN ceil(length(block) / 4.0) <= room THEN block WHEN strpos(substring(block, 1, room * 4 + 1), ' ') > 0 AND room * 4 + 1 - strpos(reverse(substring(block, 1, room * 4 + 1)), ' ') > 0
 THEN substring(block, 1, room * 4 + 1 - strpos(reverse(substring(block, 1, room * 4 + 1)), ' ')) ELSE substring(block, 1, room * 4) END"""

# The hits' blocks in order of rank, each within what the budget of 400 leaves after 20 for every hit to come.
_ANSWER = f"""
WITH RECURSIVE {_bm25("(SELECT doc_id AS seq, text, doc_type AS title, 'docs/' || doc_id || '.txt' AS path FROM documents)")}, {_HASH}, {_RRF},
h AS (SELECT rank, '## ' || {_HEADING} || chr(10) || {SNIPPET.replace("text", "coalesce(text, '')")} AS block FROM rk JOIN src USING (seq) WHERE rank <= 10),
n AS (SELECT count(*) AS n FROM h),
w AS (SELECT 1::BIGINT AS i, '' AS text, 0::BIGINT AS used, 0::BIGINT AS kept
 UNION ALL SELECT i + 1, CASE WHEN keep THEN CASE WHEN kept = 0 THEN fits ELSE text || chr(10) || chr(10) || fits END ELSE text END,
  CASE WHEN keep THEN used + greatest(1, ceil(length(fits) / 4.0)::BIGINT) ELSE used END, CASE WHEN keep THEN kept + 1 ELSE kept END
 FROM (SELECT *, used < 400 AND trim(fits) <> '' AS keep FROM (SELECT *, {_FITS} AS fits FROM (SELECT w.*, block, greatest(20, 400 - used - 20 * (n - i))::BIGINT AS room FROM w JOIN h ON h.rank = w.i CROSS JOIN n))))
SELECT regexp_replace(text, '\\s+$', '') AS context, used AS used_tokens, kept AS n_hits FROM w ORDER BY i DESC LIMIT 1"""

# Paragraphs are joined while 4,000 characters hold them; what is full is handed on in done.
_PACKER = f"""
WITH RECURSIVE t AS (SELECT seq, regexp_split_to_array(text, '\\n\\n+') AS p FROM {CURRENT} WHERE length(text) > 4000),
w AS (SELECT seq, 1 AS i, p[1] AS cur, 0 AS part, NULL::VARCHAR AS done, 0 AS no, len(p) AS n FROM t
 UNION ALL SELECT w.seq, i + 1, CASE WHEN i = w.n THEN NULL WHEN cur = '' OR full_ THEN nxt ELSE cur || chr(10) || chr(10) || nxt END,
  part + (full_ AND cur <> '')::INT, CASE WHEN full_ AND cur <> '' THEN cur END, part, n
 FROM (SELECT w.*, t.p[i + 1] AS nxt, i = w.n OR (cur <> '' AND length(cur) + length(t.p[i + 1]) + 2 > 4000) AS full_ FROM w JOIN t ON t.seq = w.seq WHERE w.i <= w.n) w)
SELECT seq, no AS part, length(regexp_replace(regexp_replace(done, '^\\s+', ''), '\\s+$', '')) AS n_chars FROM w WHERE done IS NOT NULL"""

_SYMBOL = f"(SELECT text FROM {CURRENT} WHERE fqn = (SELECT min(fqn) FROM {CURRENT} WHERE type = 'METHOD' AND length(text) > 200) ORDER BY seq LIMIT 1)"

ORACLES: dict[str, str] = {
    "keyword_hits": f"""
WITH {_bm25(DOCS)}
SELECT 'doc-' || doc_id AS id, source AS repo, 'docs/' || doc_id || '.txt' AS path, 'KNOWLEDGE' AS domain, 'DOCUMENT' AS type, NULL::VARCHAR AS fqn, doc_type AS title, NULL::VARCHAR AS section,
 {SNIPPET.replace("text", "coalesce(documents.text, '')")} AS snippet, round(score, 6) AS score
FROM b JOIN documents ON doc_id = b.seq ORDER BY b.score DESC, b.seq LIMIT 10""",
    "rerank_documents": f"""
SELECT doc_id AS seq, round(len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')), ['queue', 'index', 'filter'])) / 3.0::DOUBLE, 6) AS rerank_score
FROM documents ORDER BY 2 DESC, 1 LIMIT 10""",
    "discover_symbols": f"SELECT * EXCLUDE (snippet) FROM ({_hybrid(('queue', 'filter', 'segment'), "domain = 'CODE'", 10)})",
    "fits_budget": f"SELECT seq, length(coalesce(text, '')) <= 100 AS fits FROM {CURRENT}",
    "text_by_fqn": f"SELECT text FROM {_SYMBOL} WHERE text IS NOT NULL",
    "symbol_body": f"""
SELECT CASE WHEN length(text) <= 200 THEN text WHEN strpos(left(text, 200), chr(10)) > 0 THEN left(text, 200 - strpos(reverse(left(text, 200)), chr(10))) || chr(10) || '// ... (truncated)'
 ELSE left(text, 200) || chr(10) || '// ... (truncated)' END AS body FROM {_SYMBOL}""",
    "hash_by_id": f"SELECT content_hash FROM {CURRENT} WHERE id = (SELECT min(id) FROM {CURRENT}) ORDER BY seq LIMIT 1",
    "edge_scan": "SELECT src, dst, edge_type AS type, seq FROM graph_events WHERE kind = 'E' AND src IS NOT NULL AND dst = 'log.info' AND edge_type = 'CALLS'",
    "design_for_symbol": _hybrid(("queue",), "domain = 'KNOWLEDGE'", 5),
    "code_for_document": _hybrid(("queue", "filter", "segment"), "domain = 'CODE'", 5),
    "answer_context": _ANSWER,
    "section_packer": _PACKER,
    "bm25_topk": f"WITH {_bm25(DOCS)} SELECT seq, round(score, 6) AS score FROM b ORDER BY b.score DESC, seq LIMIT 10",
    "bm25_scan": f"WITH {_bm25(DOCS)} SELECT seq, round(score, 6) AS score FROM b ORDER BY b.score DESC, seq LIMIT 10",
    "bm25_filtered": f"WITH {_bm25(CURRENT, "domain = 'KNOWLEDGE' AND type = 'MD_SECTION'")} SELECT seq, round(score, 6) AS score FROM b ORDER BY b.score DESC, seq LIMIT 10",
    "document_frequencies": f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""",
    "knn_topk": _knn(_EMBEDDINGS, _VECTOR, "true"),
    "knn_prefilter_label": _knn(_EMBEDDINGS, _VECTOR, "label = 3"),
    "knn_chunks": _knn(CURRENT, _VECTOR, "domain = 'CODE'"),
    "index_documents": f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')) AS term FROM documents)
SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS terms, count(DISTINCT (doc_id, term)) AS postings, count(*) AS tokens FROM t""",
    "hash_embedding_scan": f"WITH src AS (SELECT * FROM {DOCS}), {_HASH} SELECT seq, round(score, 6) AS score FROM s ORDER BY s.score DESC, seq LIMIT 10",
    "hash_embedding_knn": f"WITH src AS (SELECT * FROM {DOCS}), {_HASH} SELECT seq, round(score, 6) AS score FROM s ORDER BY s.score DESC, seq LIMIT 10",
    "hybrid_rrf": f"WITH {_bm25(DOCS)}, {_HASH}, {_RRF} SELECT seq, round(score, 6) AS score, round(rrf, 6) AS rrf_score, rank FROM rk WHERE rank <= 10",
    "hybrid_rerank": f"""
WITH {_bm25(DOCS)}, {_HASH}, {_RRF},
sn AS (SELECT rk.seq, rk.rank AS old, {SNIPPET.replace("text", "coalesce(src.text, '')")} AS snippet FROM rk JOIN src ON src.seq = rk.seq WHERE rk.rank <= 50),
sc AS (SELECT seq, old, len(list_intersect(list_distinct(regexp_extract_all(lower(snippet), '{TOKEN}')), ['queue', 'index', 'filter'])) / 3.0::DOUBLE AS s FROM sn),
ro AS (SELECT *, row_number() OVER (ORDER BY s DESC, old) AS rank FROM sc)
SELECT seq, round(s, 6) AS rerank_score, rank FROM ro WHERE rank <= 10""",
    "snippet_projection": f"SELECT seq, {SNIPPET} AS snippet FROM (SELECT seq, coalesce(text, '') AS text FROM {CURRENT})",
    "content_hash": f"SELECT seq, left(sha256(coalesce(text, '')), 16) AS actual, coalesce(lower(content_hash) = left(sha256(coalesce(text, '')), 16), false) AS fresh FROM {CURRENT}",
    "token_estimate": f"SELECT seq, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)::BIGINT) END AS tokens FROM {CURRENT}",
    "truncate_to_fit": f"""
SELECT seq, CASE WHEN length(t) <= 100 THEN t WHEN strpos(substring(t, 1, 101), ' ') > 0 AND 101 - strpos(reverse(substring(t, 1, 101)), ' ') > 0
 THEN substring(t, 1, 101 - strpos(reverse(substring(t, 1, 101)), ' ')) ELSE substring(t, 1, 100) END AS text
FROM (SELECT seq, coalesce(text, '') AS t FROM {CURRENT})""",
    "slugify_titles": f"SELECT seq, {_SLUG} AS slug FROM {CURRENT}",
    "fqn_simple": f"""
SELECT seq, lower(regexp_replace(regexp_extract(fqn, '([^.#/]*)$', 1), '\\(.*', '')) AS fqn_simple, regexp_replace(regexp_extract(fqn, '([^.#]*)$', 1), '\\(.*', '') AS simple_name
FROM {CURRENT} WHERE fqn IS NOT NULL""",
    "looks_like_bean": """
SELECT dst, count(*) AS n, regexp_matches(regexp_extract(regexp_replace(dst, '<.*', ''), '([^.]*)$', 1), '^[A-Z]')
 AND regexp_extract(regexp_replace(dst, '<.*', ''), '([^.]*)$', 1) NOT IN ('String', 'Integer', 'Long', 'Double', 'Float', 'Boolean', 'Object', 'List', 'Map', 'Set', 'Collection', 'Optional', 'Path', 'File') AS bean
FROM graph_events WHERE kind = 'E' AND edge_type = 'DEPENDS_ON' AND src IS NOT NULL AND dst IS NOT NULL GROUP BY dst""",
    "current_chunks": f"SELECT seq, repo, branch, id FROM {CURRENT}",
    "upsert_last_wins": "SELECT id, max(seq) AS seq FROM chunks GROUP BY id",
    "delete_by_path": f"WITH c AS (SELECT * FROM {CURRENT}) SELECT seq FROM c WHERE path IS NULL OR path NOT IN (SELECT path FROM c WHERE type = 'OPENAPI_OP' AND path IS NOT NULL)",
    "delete_by_path_branch": f"WITH c AS (SELECT * FROM {CURRENT}) SELECT seq FROM c WHERE NOT coalesce(branch = 'main' AND path IN (SELECT path FROM c WHERE domain = 'CODE' AND path IS NOT NULL), false)",
    "unchanged_by_hash": f"""
SELECT seq FROM (SELECT seq, id, left(sha256(coalesce(text, '')), 16) AS h FROM {CURRENT}) f
WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.id = f.id AND lower(c.content_hash) = f.h)""",
    "dedupe_by_hash": "SELECT left(sha256(coalesce(text, '')), 16) AS hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1",
    "count_by_filter": f"SELECT count(*) AS n FROM {CURRENT} WHERE domain = 'CODE' AND branch = 'main'",
    "index_monitor": f"""
WITH c AS (SELECT repo, branch, count(*) FILTER (domain = 'CODE') AS code, count(*) FILTER (domain = 'KNOWLEDGE') AS knowledge, count(*) AS total FROM {CURRENT} GROUP BY 1, 2),
k AS (SELECT repo, branch, max(sha) AS sha FROM checkpoints GROUP BY 1, 2),
y AS (SELECT repo, max(indexed_at) AS at FROM {CURRENT} GROUP BY 1)
SELECT k.repo, k.branch, coalesce(code, 0) AS code_chunks, coalesce(knowledge, 0) AS knowledge_chunks, coalesce(total, 0) AS total_chunks, k.sha AS last_sha,
 strftime(y.at, '%Y-%m-%dT%H:%M:%SZ') AS last_sync_at, false AS indexing
FROM k LEFT JOIN c ON k.repo = c.repo AND k.branch IS NOT DISTINCT FROM c.branch LEFT JOIN y ON y.repo = k.repo""",
    "index_status": f"""
WITH c AS (SELECT repo, branch, count(*) AS total FROM {CURRENT} GROUP BY 1, 2), k AS (SELECT DISTINCT repo, branch FROM checkpoints)
SELECT coalesce(sum(total), 0)::BIGINT AS total_chunks, count(*) AS branches, false AS any_indexing FROM k LEFT JOIN c ON k.repo = c.repo AND k.branch IS NOT DISTINCT FROM c.branch""",
    "source_classify": """
SELECT file_id, CASE WHEN lower(path) LIKE '%.java' THEN 'JAVA' WHEN lower(path) LIKE '%.md' OR lower(path) LIKE '%.markdown' THEN 'MARKDOWN'
 WHEN lower(path) LIKE '%.yml' OR lower(path) LIKE '%.yaml' OR lower(path) LIKE '%.json' THEN 'API_SPEC'
 WHEN lower(path) LIKE '%.pdf' OR lower(path) LIKE '%.docx' OR lower(path) LIKE '%.html' OR lower(path) LIKE '%.txt' THEN 'DOCUMENT' ELSE 'IGNORE' END AS source_class FROM source_files""",
    "accept_glob": "SELECT file_id FROM source_files WHERE (path GLOB '*/*.java' OR path GLOB '*/*.md') AND NOT regexp_matches(path, '/u5[^/]*/') AND NOT path LIKE 'api/%'",
    "symbol_prefix": f"""
SELECT seq, fqn FROM (SELECT *, lower(regexp_replace(regexp_extract(fqn, '([^.#/]*)$', 1), '\\(.*', '')) AS s FROM {CURRENT})
WHERE type = 'METHOD' AND (s LIKE 'load%seg%' OR fqn = 'load*seg') ORDER BY s, id, seq LIMIT 10""",
    "find_symbol": f"""
SELECT fqn, type, repo, path FROM (SELECT *, lower(regexp_replace(regexp_extract(fqn, '([^.#/]*)$', 1), '\\(.*', '')) AS s FROM {CURRENT})
WHERE s LIKE 'batch%' OR fqn = 'Batch' ORDER BY s, id, seq LIMIT 10""",
    "by_type_and_repo": f"SELECT seq, fqn FROM {CURRENT} WHERE type = 'OPENAPI_OP' AND repo = 'narildex-core'",
    "symbol_filter": f"SELECT seq FROM {CURRENT} WHERE list_contains(symbols, '@Service')",
    "title_or_fqn": f"SELECT seq, coalesce(title, fqn) AS title FROM {CURRENT}",
    "graph_event_fold": f"WITH {NODES} SELECT * FROM nodes",
    "nodes_by_tag": f"WITH {NODES} SELECT id FROM nodes WHERE {_tag('BEAN')}",
    "edge_degrees": f"WITH {NODES} SELECT dst, type, count(*) AS n, min(seq) AS first_seq FROM edges GROUP BY 1, 2",
    "edges_distinct": f"WITH {NODES} SELECT src, dst, type, min(seq) AS seq FROM edges GROUP BY 1, 2, 3",
    "callers_d1": _bfs("SELECT dst AS a, src AS b FROM edges WHERE type = 'CALLS'", "'log.info'", 1),
    "callees_bfs": _bfs("SELECT src AS a, dst AS b FROM edges WHERE type = 'CALLS'", _SEED.format("Method"), 3),
    "expand_context_2hop": _bfs("SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges", _SEED.format("Class"), 2),
    "symbol_view": f"""
WITH {NODES}, s AS (SELECT {_SEED.format("Method")} AS id),
ce AS (SELECT DISTINCT dst AS id FROM edges WHERE type = 'CALLS' AND src = (SELECT id FROM s) AND dst <> src),
cr AS (SELECT DISTINCT src AS id FROM edges WHERE type = 'CALLS' AND dst = (SELECT id FROM s) AND dst <> src)
SELECT nodes.id AS fqn, signature, javadoc,
 coalesce((SELECT string_agg(coalesce(n2.signature, cr.id), '|' ORDER BY coalesce(n2.signature, cr.id)) FROM cr LEFT JOIN nodes n2 ON n2.id = cr.id), '') AS callers,
 coalesce((SELECT string_agg(coalesce(n2.signature, ce.id), '|' ORDER BY coalesce(n2.signature, ce.id)) FROM ce LEFT JOIN nodes n2 ON n2.id = ce.id), '') AS callees
FROM nodes JOIN s ON s.id = nodes.id""",
    "topic_flow": f"""
WITH {NODES} SELECT CASE WHEN type = 'DEPENDS_ON' THEN 'producer' ELSE 'consumer' END AS role, coalesce(nodes.signature, src) AS signature, seq
FROM edges LEFT JOIN nodes ON nodes.id = src WHERE dst = 'log.info' AND type IN ('CALLS', 'DEPENDS_ON')""",
    "endpoint_lookup": f"""
WITH {NODES}, s AS (SELECT {_SEED.format("Endpoint")} AS id)
SELECT regexp_extract(nodes.id, '^([^ ]+) (.*)$', 1) AS method, regexp_extract(nodes.id, '^([^ ]+) (.*)$', 2) AS path, javadoc AS operation_id,
 (SELECT arg_min(src, seq) FROM edges WHERE type = 'EXPOSES' AND dst = (SELECT id FROM s)) AS handler FROM nodes JOIN s ON s.id = nodes.id""",
    "endpoint_keys": f"WITH {NODES} {_KEYS}",
    "bean_graph_depth2": f"""
WITH RECURSIVE {NODES}, beans AS (SELECT id FROM nodes WHERE {_tag('BEAN')}), root AS (SELECT min(id) AS id FROM beans),
steps AS (SELECT e.src AS a, CASE WHEN n.id IS NOT NULL THEN e.dst ELSE coalesce((SELECT min(b.id) FROM beans b WHERE b.id = e.dst OR ends_with(b.id, '.' || e.dst)), e.dst) END AS b
          FROM edges e LEFT JOIN nodes n ON n.id = e.dst WHERE e.type = 'DEPENDS_ON'),
walk AS (SELECT id, 0 AS depth FROM root UNION SELECT s.b, w.depth + 1 FROM walk w JOIN steps s ON s.a = w.id WHERE w.depth < 2)
SELECT (SELECT id FROM root) AS root, f.id AS fqn, coalesce(nodes.signature, f.id) AS signature, f.depth FROM (SELECT id, min(depth)::BIGINT AS depth FROM walk GROUP BY id) f
LEFT JOIN nodes ON nodes.id = f.id WHERE f.depth > 0""",
    "spec_vs_impl": f"""
WITH {NODES}, spec AS ({_SPEC}), impl AS ({_KEYS})
SELECT coalesce(spec.id, impl.id) AS key, CASE WHEN impl.id IS NULL THEN 'unimplemented' WHEN spec.id IS NULL THEN 'undocumented' ELSE 'matched' END AS state
FROM spec FULL JOIN impl ON spec.id = impl.id""",
    "stream_upsert": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "windowed_activity": "SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
