"""The same results in DuckDB's SQL, keyed as in scriptorium.plans.queries. Queries without an entry are tested in tests/."""

from __future__ import annotations


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def exact_mean(x: str, places: int = 4) -> str:
    """A mean over whole millionths, rounded half away from zero."""
    total, n = f"sum(round(({x}) * 1000000)::BIGINT)::BIGINT", f"count({x}) * {10 ** (6 - places)}"
    return f"(sign({total}) * ((2 * abs({total}) + {n}) // (2 * {n})))::DOUBLE / {10**places}::DOUBLE"


BLANKED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN x || chr(10) ELSE x END), chr(10))"
DIRTY = "CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(9) || text || '  ' || chr(10) || '-----' || repeat(chr(10), 4) || 'end ' || chr(10) || ' ' || chr(10) ELSE text END"

PAGES = f"pages_ AS (SELECT source, doc_id::VARCHAR AS page, {BLANKED} AS text FROM documents)"
HEADS = f"""
lines AS (SELECT source, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth_ FROM pages_),
placed AS (SELECT source, page, coalesce(sum(length(line) + 1) OVER (PARTITION BY source, page ORDER BY nth_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place,
  lead(line) OVER (PARTITION BY source, page ORDER BY nth_) AS following, {strip('line')} AS heading FROM lines),
heads AS (SELECT source, page, place, heading FROM placed WHERE length(heading) BETWEEN 1 AND 80 AND NOT regexp_matches(heading, '^\\d+$') AND {strip('following')} = '')"""


def cut(text: str, size: int = 500, step: int = 400) -> str:
    return f"list_transform(range(0, greatest(0, ceil((length({text}) - {size - step}) / {float(step)})::BIGINT - 1) + 1), lambda i: substr({text}, i * {step} + 1, {size}))"


CHUNKED = f"""
parts AS (SELECT source, page, list_transform({cut('text')}, lambda c: {strip('c')}) AS p FROM pages_),
numbered AS (SELECT source, page, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS chunk_index, len(p) AS total_chunks FROM parts),
chunked AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source, page ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cursor_ FROM numbered)"""
SECTIONED = "sectioned AS (SELECT c.*, coalesce(h.heading, 'Unknown') AS section FROM chunked c ASOF LEFT JOIN heads h ON c.source = h.source AND c.page = h.page AND c.cursor_ >= h.place)"
CHUNK_ID = "md5({source} || '__' || {page} || '__' || {index} || '__' || substr({text}, 1, 80))"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: length(s) > 10)"


TOKENS = r"regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+')"
PLACE = "('0x' || substr(md5(tok), 1, 8))::BIGINT % 384"


def hashed(name: str, table: str, key: str, text: str = "text") -> str:
    """name(key, place, n) and name_norm(key, norm)."""
    return f"""
{name} AS (SELECT {key} AS id, place, count(*)::DOUBLE AS n FROM (SELECT {key}, {PLACE} AS place FROM (SELECT {key}, unnest({TOKENS.format(text=text)}) AS tok FROM {table}) WHERE tok <> '') GROUP BY 1, 2),
{name}_norm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM {name} GROUP BY 1)"""


CONFIDENCE = "CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END"


def text_hits(k: int) -> str:
    return f"""
{hashed('dv', '(SELECT doc_id::VARCHAR AS doc_key, text FROM documents)', 'doc_key')},
{hashed('qv', 'benchmark', 'item_id')},
dots AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.n * d.n) AS dot FROM qv q JOIN dv d ON q.place = d.place GROUP BY 1, 2),
scored AS (SELECT b.item_id AS query_id, d.doc_id::VARCHAR AS chunk_id, coalesce(round(dot / (qn.norm * dn.norm), 4), 0.0) AS score
  FROM benchmark b CROSS JOIN documents d LEFT JOIN dots x ON x.query_id = b.item_id AND x.chunk_id = d.doc_id::VARCHAR LEFT JOIN qv_norm qn ON qn.id = b.item_id LEFT JOIN dv_norm dn ON dn.id = d.doc_id::VARCHAR),
hits AS (SELECT s.query_id, s.chunk_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.chunk_id) AS rank, d.source, d.doc_id::VARCHAR AS page, 'Unknown' AS section, 'pdf' AS doc_type, d.text, {CONFIDENCE} AS confidence
  FROM scored s JOIN documents d ON s.chunk_id = d.doc_id::VARCHAR QUALIFY rank <= {k})"""


def dense_hits(k: int) -> str:
    return f"""
asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, ((vec_id // 50) % 13)::VARCHAR AS wanted FROM embeddings WHERE vec_id % 50 = 0),
scored AS (SELECT query_id, wanted, vec_id AS chunk_id, label::VARCHAR AS source, round(list_cosine_similarity(q, embedding::DOUBLE[]), 4) AS score FROM asked, embeddings),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= {k})"""


SPOKEN = "spoken AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant'))"
HISTORY = "hist AS (SELECT conv_id, 'CONVERSATION HISTORY:' || chr(10) || string_agg((CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END) || text, chr(10) ORDER BY turn) AS history FROM spoken WHERE back <= 6 GROUP BY 1)"
ROUTED = """routed AS (SELECT doc_id AS query_id, text || CASE WHEN doc_id % 8 = 0 THEN ' tvs summary' WHEN doc_id % 4 = 0 THEN ' Overview' WHEN doc_id % 4 = 1 THEN ' vs ' WHEN doc_id % 4 = 2 THEN ' LIST ALL ' ELSE '' END AS question FROM documents),
tooled AS (SELECT *, CASE
  WHEN regexp_matches(lower(question), 'summarize|summary|overview|zusammenfassung|résumé') THEN 'summarizer'
  WHEN regexp_matches(lower(question), 'compare|difference|versus|vs|vergleich|comparer') THEN 'comparator'
  WHEN regexp_matches(lower(question), 'extract|list all|find all|enumerate|aufzählen') THEN 'extractor' ELSE 'retriever' END AS tool FROM routed)"""


def rewritten(question: str, tool: str) -> str:
    return f"""CASE {tool} WHEN 'summarizer' THEN 'Please provide a concise summary based on the context. Original request: ' || {question}
  WHEN 'comparator' THEN 'Please compare and contrast the relevant information across documents. Original request: ' || {question}
  WHEN 'extractor' THEN 'Please extract and list the relevant structured information. Original request: ' || {question} ELSE {question} END"""


def normalised(x: str) -> str:
    flat = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return rf"trim(regexp_replace({flat}, '^(?i)(the|a|an|der|die|das|den|dem)( |$)', ''))"


def found(chunks: str) -> str:
    """mentions_ from (chunk_id, source, page, text)."""
    return rf"""
sents AS (SELECT chunk_id, source, page, text, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_idx FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM {chunks})),
spans AS (SELECT chunk_id, source, page, text, sent_idx, unnest(m) AS surface, generate_subscripts(m, 1) AS nth_ FROM (SELECT *, regexp_extract_all(sentence, '\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)*') AS m FROM sents)),
mentions_ AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY sent_idx, nth_) - 1 AS pos, {normalised('surface')} AS name FROM spans)"""


MENTIONS = found("(SELECT doc_id::VARCHAR AS chunk_id, source, doc_id::VARCHAR AS page, text FROM documents)")
PAIRS = """
pairs AS (SELECT a.chunk_id, a.source, a.page, a.text, a.pos AS a_pos, b.pos AS b_pos, a.name AS src, b.name AS dst,
  CASE WHEN a.name = '' OR b.name = '' THEN 'garbage' WHEN lower(a.name) = lower(b.name) THEN 'self_loop' WHEN a.name LIKE '%-' OR b.name LIKE '%-' THEN 'garbage' ELSE 'kept' END AS reason
  FROM mentions_ a JOIN mentions_ b ON a.chunk_id = b.chunk_id AND a.sent_idx = b.sent_idx AND a.pos < b.pos)"""


def node_of(source: str) -> str:
    return rf"trim(replace(regexp_replace({source}, '(?i)\.pdf$', ''), '_', ' '))"


LINKS = f"""
links AS (SELECT chunk_id, source, page, text, {node_of('source')} AS src, name AS dst, pos FROM mentions_
  WHERE name <> '' AND name NOT LIKE '%-' AND lower(name) <> lower({node_of('source')}) QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(name) ORDER BY pos) = 1)"""
EDGES = f"""{MENTIONS}, {PAIRS}, {LINKS},
edges_ AS (SELECT chunk_id, src, dst, 'related_to' AS relation, source, page, substr(text, 1, 200) AS chunk_text, (chunk_id::BIGINT << 36) + (a_pos << 17) + b_pos AS seq FROM pairs WHERE reason = 'kept'
  UNION ALL SELECT chunk_id, src, dst, 'appears_in', source, page, substr(text, 1, 200), (chunk_id::BIGINT << 36) + (1::BIGINT << 35) + (pos << 17) FROM links)"""
INDEX = """
ends AS (SELECT src AS node, seq, 0 AS e FROM edges_ UNION ALL SELECT dst, seq, 1 FROM edges_),
firsts AS (SELECT node, min(seq * 2 + e) AS f FROM ends GROUP BY 1),
index_ AS (SELECT lower(node) AS node_key, arg_max(node, f) AS node FROM firsts GROUP BY 1)"""
TRADE = """
rn AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
trade AS (SELECT src, dst, relation, seq, src || ' ' || relation || ' ' || dst AS chunk_text FROM (
  SELECT r_name AS src, n_name AS dst, 'has' AS relation, n_nationkey::BIGINT AS seq FROM rn
  UNION ALL SELECT n_name, r_name, 'in', n_nationkey + 100 FROM rn WHERE n_nationkey % 3 = 0
  UNION ALL SELECT r_name, n_name, 'also', n_nationkey + 200 FROM rn WHERE n_nationkey % 5 = 0
  UNION ALL SELECT n_name, s_name, 'home_of', s_suppkey + 1000 FROM supplier JOIN nation ON s_nationkey = n_nationkey)),
starts AS (SELECT r_regionkey::BIGINT AS query_id, r_name AS node, 1 AS start_rank FROM region UNION ALL SELECT n_regionkey, n_name, n_nationkey + 2 FROM nation WHERE n_nationkey % 4 = 0)"""


def walked(edges: str) -> str:
    """walk from `edges` and starts, two hops."""
    return f"""succ AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY min(seq)) AS sr FROM {edges} GROUP BY src, dst),
one AS (SELECT query_id, start_rank, src, dst, src || ' -> ' || dst AS path, sr AS k1, 0 AS k2, 1 AS level, node AS start FROM starts JOIN succ ON node = src),
two AS (SELECT o.query_id, o.start_rank, s.src, s.dst, o.path || ' -> ' || s.dst AS path, o.k1, s.sr AS k2, 2 AS level, o.start FROM one o JOIN succ s ON o.dst = s.src WHERE o.dst <> o.start),
walk AS (SELECT w.*, t.* EXCLUDE (src, dst) FROM (SELECT * FROM one UNION ALL SELECT * FROM two) w JOIN {edges} t ON w.src = t.src AND w.dst = t.dst)"""


WALK = f"{TRADE}, {walked('trade')}"
MATCHED = f"""asked AS (SELECT query_id, pos, {normalised('surface')} AS name FROM (
  SELECT item_id AS query_id, surface, row_number() OVER (PARTITION BY item_id ORDER BY sent_idx, nth_) - 1 AS pos FROM (
    SELECT item_id, sent_idx, unnest(m) AS surface, generate_subscripts(m, 1) AS nth_ FROM (SELECT item_id, sent_idx, regexp_extract_all(sentence, '\\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+)*') AS m FROM (
      SELECT item_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_idx FROM (SELECT item_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM benchmark)))))),
matched AS (SELECT a.query_id, i.node, min(a.pos) AS pos FROM asked a JOIN index_ i ON lower(a.name) = i.node_key GROUP BY 1, 2),
starts AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY pos, node) AS start_rank FROM matched)"""
DOCUMENT_WALK = f"{EDGES}, {INDEX}, {MATCHED}, {walked('edges_')}"


def best_of_walk(key: str) -> str:
    return f"""once AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY query_id, {key}, substr(chunk_text, 1, 50) ORDER BY start_rank, level, k1, k2, seq) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY start_rank, level, k1, k2, seq) AS nth FROM once QUALIFY nth <= 5)"""


def by_method() -> str:
    """Faithfulness and precision of both methods, each question's texts told apart by method and kind."""
    return f"""{text_hits(5)}, {DOCUMENT_WALK}, {best_of_walk("source, page")},
found AS (SELECT 'vector' AS method, query_id AS qa_id, rank, text FROM hits UNION ALL SELECT 'graph', query_id, nth, chunk_text FROM best),
answers AS (SELECT method, qa_id, array_to_string(({sentences('text')})[1:2], ' ') AS answer FROM found WHERE rank = 1),
pieces AS (
  SELECT 'q' AS kind, method, qa_id, 0::BIGINT AS nth_, b.text FROM answers JOIN benchmark b ON qa_id = item_id
  UNION ALL SELECT 'c', method, qa_id, rank, text FROM found
  UNION ALL SELECT 'as', method, qa_id, generate_subscripts(s, 1), unnest(s) FROM (SELECT method, qa_id, {sentences('answer')} AS s FROM answers)),
keyed AS (SELECT kind || ':' || method || ':' || qa_id || ':' || nth_ AS piece, * FROM pieces),
{hashed('pv', 'keyed', 'piece')},
met AS (SELECT p.piece, c.piece AS other, sum(a.n * b.n) AS dot FROM keyed p JOIN keyed c ON p.qa_id = c.qa_id AND p.method = c.method AND p.kind <> 'c' AND c.kind = 'c' JOIN pv a ON a.id = p.piece JOIN pv b ON b.id = c.piece AND b.place = a.place GROUP BY 1, 2),
sims AS (SELECT p.kind, p.method, p.qa_id, p.nth_, coalesce(round(m.dot / (pn.norm * dn.norm), 6), 0.0) AS sim
  FROM keyed p JOIN keyed c ON p.qa_id = c.qa_id AND p.method = c.method AND p.kind <> 'c' AND c.kind = 'c' LEFT JOIN met m ON m.piece = p.piece AND m.other = c.piece LEFT JOIN pv_norm pn ON pn.id = p.piece LEFT JOIN pv_norm dn ON dn.id = c.piece),
faith AS (SELECT method, qa_id, avg(CASE WHEN best >= 0.40 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT method, qa_id, nth_, max(sim) AS best FROM sims WHERE kind = 'as' GROUP BY 1, 2, 3) GROUP BY 1, 2),
prec AS (SELECT method, qa_id, avg(CASE WHEN sim >= 0.45 THEN 1.0 ELSE 0.0 END) AS share FROM sims WHERE kind = 'q' GROUP BY 1, 2),
per AS (SELECT a.method, a.qa_id, coalesce(f.share, 0.0) AS faithfulness, coalesce(p.share, 0.0) AS context_precision FROM answers a LEFT JOIN faith f USING (method, qa_id) LEFT JOIN prec p USING (method, qa_id))"""


def judged() -> str:
    """Per-question metrics as in evaluation.evaluate, from hashed vectors of texts told apart by kind."""
    return f"""{text_hits(5)},
answers AS (SELECT query_id, coalesce(array_to_string(({sentences('text')})[1:2], ' '), '') AS answer FROM hits WHERE rank = 1),
qa AS (SELECT item_id AS qa_id, text AS question, coalesce(answer, '') AS answer FROM benchmark LEFT JOIN answers ON query_id = item_id),
ctx AS (SELECT query_id AS qa_id, rank, chunk_id FROM hits WHERE query_id % 5 <> 0),
pieces AS (
  SELECT 'q' AS kind, qa_id, 0::BIGINT AS nth_, question AS text FROM qa UNION ALL SELECT 'a', qa_id, 0, answer FROM qa
  UNION ALL SELECT 'as', qa_id, generate_subscripts(s, 1), unnest(s) FROM (SELECT qa_id, {sentences('answer')} AS s FROM qa)
  UNION ALL SELECT 'gs', qa_id, generate_subscripts(s, 1), unnest(s) FROM (SELECT qa_id, {sentences('question')} AS s FROM qa)),
keyed AS (SELECT kind || ':' || qa_id || ':' || nth_ AS piece, * FROM pieces),
{hashed('pv', 'keyed', 'piece')},
met AS (SELECT p.piece, c.rank, sum(a.n * b.n) AS dot FROM keyed p JOIN ctx c ON p.qa_id = c.qa_id JOIN pv a ON a.id = p.piece JOIN dv b ON b.id = c.chunk_id AND b.place = a.place GROUP BY 1, 2),
sims AS (SELECT p.kind, p.qa_id, p.nth_, c.rank, coalesce(round(m.dot / (pn.norm * dn.norm), 6), 0.0) AS sim
  FROM keyed p JOIN ctx c ON p.qa_id = c.qa_id LEFT JOIN met m ON m.piece = p.piece AND m.rank = c.rank LEFT JOIN pv_norm pn ON pn.id = p.piece LEFT JOIN dv_norm dn ON dn.id = c.chunk_id),
shares AS (SELECT kind, qa_id, avg(CASE WHEN best >= CASE kind WHEN 'as' THEN 0.40 ELSE 0.45 END THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT kind, qa_id, nth_, max(sim) AS best FROM sims WHERE kind IN ('as', 'gs') GROUP BY 1, 2, 3) GROUP BY 1, 2),
prec AS (SELECT qa_id, avg(CASE WHEN sim >= 0.45 THEN 1.0 ELSE 0.0 END) AS share FROM sims WHERE kind = 'q' GROUP BY 1),
qadot AS (SELECT q.qa_id, sum(x.n * y.n) AS dot FROM keyed q JOIN keyed a ON q.qa_id = a.qa_id AND q.kind = 'q' AND a.kind = 'a' JOIN pv x ON x.id = q.piece JOIN pv y ON y.id = a.piece AND y.place = x.place GROUP BY 1),
rel AS (SELECT qa.qa_id, coalesce(dot / (qn.norm * an.norm), 0.0) AS relevancy FROM qa LEFT JOIN qadot USING (qa_id) LEFT JOIN pv_norm qn ON qn.id = 'q:' || qa.qa_id || ':0' LEFT JOIN pv_norm an ON an.id = 'a:' || qa.qa_id || ':0'),
per AS (SELECT qa_id, CASE WHEN ok THEN relevancy END AS answer_relevancy, CASE WHEN ok THEN coalesce(f.share, 0.0) END AS faithfulness, CASE WHEN ok THEN coalesce(p.share, 0.0) END AS context_precision, CASE WHEN ok THEN coalesce(g.share, 0.0) END AS context_recall
  FROM rel LEFT JOIN (SELECT DISTINCT qa_id, TRUE AS ok FROM ctx) USING (qa_id) LEFT JOIN (FROM shares WHERE kind = 'as') f USING (qa_id) LEFT JOIN prec p USING (qa_id) LEFT JOIN (FROM shares WHERE kind = 'gs') g USING (qa_id))"""


def sweep() -> str:
    rows = []
    for size, overlap in ((200, 50), (500, 100), (800, 150), (1200, 200)):
        rows.append(f"SELECT {size}::BIGINT AS chunk_size, {overlap}::BIGINT AS chunk_overlap, count(*) AS chunks, floor(avg(length(c)))::BIGINT AS mean_length, min(length(c))::BIGINT AS min_length, max(length(c))::BIGINT AS max_length FROM (SELECT unnest({cut('text', size, size - overlap)}) AS c FROM documents)")
    return " UNION ALL ".join(rows)


def tool_texts() -> str:
    from scriptorium.operators.answering import TOOLS

    n = " ".join(f"WHEN '{t}' THEN {c}" for t, (c, _) in TOOLS.items())
    request = " ".join(f"WHEN '{t}' THEN '{i}' || chr(10) || chr(10) || 'Original request: ' || question" for t, (_, i) in TOOLS.items() if i)
    return f"WITH {ROUTED} SELECT query_id, tool, (CASE tool {n} END)::BIGINT AS n_results, md5(CASE tool {request} ELSE question END) AS request_md5 FROM tooled"


HIST_BINS = "SELECT *, least(24, floor((score - low) / ((high - low) / 25))::BIGINT) AS bin FROM (SELECT *, min(score) OVER () AS low, max(score) OVER () AS high FROM hits)"

ORACLES: dict[str, str] = {
    "s2_physical_pages": f"SELECT doc_id::VARCHAR AS source, nth_::VARCHAR AS page, nth_::INTEGER AS page_num, length(p)::INTEGER AS n_chars FROM (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS nth_ FROM (SELECT doc_id, string_split({DIRTY}, chr(10)) AS s FROM documents)) WHERE {strip('p')} <> ''",
    "s5_base64": "SELECT doc_id, md5(base64(encode(text))) AS b64_md5 FROM documents",
    "s11_graph_tables": f"WITH {TRADE} SELECT relation, count(*) AS n_edges, count(DISTINCT src) AS n_sources FROM trade GROUP BY 1",
    "t1_clean_text": rf"""SELECT doc_id, length(c)::INTEGER AS n_chars, md5(c) AS text_md5 FROM (SELECT doc_id, {strip(rf"regexp_replace(regexp_replace(regexp_replace({DIRTY}, '(?m)^[-_=]{{3,}}\s*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[^\S\n]+$', '', 'g')")} AS c FROM documents)""",
    "t3_headings": f"WITH {PAGES}, {HEADS} SELECT page, place, heading FROM heads",
    "t4_nearest_section": f'WITH {PAGES}, {HEADS}, {CHUNKED}, {SECTIONED} SELECT page, chunk_index::BIGINT AS chunk_index, cursor_ AS "cursor", section FROM sectioned',
    "t6_process_pages": f"WITH {PAGES}, {HEADS}, {CHUNKED}, {SECTIONED} SELECT {CHUNK_ID.format(source='source', page='page', index='chunk_index', text='text')} AS chunk_id, source, page, section, chunk_index::BIGINT AS chunk_index, total_chunks::BIGINT AS total_chunks, 'pdf' AS doc_type, md5(text) AS text_md5 FROM sectioned WHERE length(text) >= 50",
    "t7_image_chunks": f"WITH pages_ AS (SELECT doc_id::VARCHAR || '.png' AS source, 'image' AS page, {strip('text')} AS text FROM documents WHERE {strip('text')} <> ''), {CHUNKED} SELECT {CHUNK_ID.format(source='source', page='page', index='chunk_index', text='text')} AS chunk_id, source, page, 'image_ocr' AS section, chunk_index::BIGINT AS chunk_index, 'image' AS doc_type FROM chunked WHERE length(text) >= 50",
    "t8_chunk_size_sweep": sweep(),
    "t9_overlap": f'WITH {PAGES}, {CHUNKED} SELECT page, chunk_index::BIGINT AS chunk_index, "right"(text, 100) AS tail, "left"(following, 100) AS head FROM (SELECT *, lead(text) OVER (PARTITION BY source, page ORDER BY chunk_index) AS following FROM chunked) WHERE following IS NOT NULL',
    "t10_sentences": f"SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::BIGINT AS at FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
    "t11_truncate": "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || '...' END AS short FROM documents",
    "t12_source_line": "SELECT doc_id, coalesce(source, 'Unknown') || ' — Page ' || coalesce(CASE WHEN doc_id % 7 > 0 THEN doc_id::VARCHAR END, '?') || ' — Section: ' || coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, 'Unknown') AS line FROM documents",
    "t13_selection_preview": f"SELECT doc_id, CASE WHEN length(t) >= 3 THEN CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 80) || '...' END END AS preview FROM (SELECT doc_id, {strip('''CASE WHEN doc_id % 6 = 0 THEN '  ab ' ELSE text END''')} AS t FROM documents)",
    "v1_hashed_embedding": f"WITH {hashed('dv', 'documents', 'doc_id')} SELECT id AS doc_id, place, n::BIGINT AS n FROM dv",
    "v3_chunk_ids": f"SELECT doc_id, {CHUNK_ID.format(source='source', page='doc_id', index='(doc_id % 64)', text='text')} AS chunk_id FROM documents",
    "v4_upsert": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS version, n_chars FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "v5_similarity_search": f"WITH {dense_hits(5)} SELECT query_id, rank, chunk_id, score FROM hits",
    "v6_cosine": "WITH z AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END AS v FROM embeddings) SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 0 OR b.vec_id % 7 = 0 THEN 0.0 ELSE round(list_cosine_similarity(a.v, b.v), 6) END AS cos FROM z a JOIN z b ON b.vec_id = a.vec_id + 1",
    "v7_retrieve": f"WITH {text_hits(5)} SELECT query_id, rank, chunk_id, source, page, section, score, confidence, doc_type FROM hits",
    "v8_confidence": f"SELECT event_id, score, {CONFIDENCE} AS confidence FROM (SELECT event_id, round(value % 1, 4) AS score FROM events)",
    "v9_selection_retrieval": f"WITH {dense_hits(15)}, marked AS (SELECT *, max(source = wanted) OVER (PARTITION BY query_id) AS any_match FROM hits) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, source, score FROM marked WHERE source = wanted OR NOT any_match QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5",
    "v10_delete_source": "SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN source = 'src3' THEN 'deleted' ELSE 'kept' END AS state FROM documents",
    "v11_list_sources": "SELECT DISTINCT source FROM documents",
    "v13_stats": "SELECT count(*) AS total_chunks, count(DISTINCT source) AS total_documents, (SELECT string_agg(source, chr(10) ORDER BY source) FROM (SELECT DISTINCT source FROM documents)) AS documents FROM documents",
    "v14_retrieval_probe": f"WITH {text_hits(3)} SELECT query_id, rank, chunk_id, score FROM hits",
    "v15_score_histogram": f"WITH {dense_hits(5)}, binned AS ({HIST_BINS}) SELECT bin, left_edge, count(*) AS n, CASE WHEN left_edge >= 0.75 THEN 'High' WHEN left_edge >= 0.5 THEN 'Medium' ELSE 'Low' END AS label FROM (SELECT bin, round(low + bin * (high - low) / 25, 6) AS left_edge FROM binned) GROUP BY 1, 2",
    "v15_score_summary": f"WITH {dense_hits(5)} SELECT count(*) AS n, min(score) AS least, max(score) AS most, {exact_mean('score', 6)} AS mean FROM hits",
    "g1_mentions": f"WITH {MENTIONS} SELECT chunk_id, sent_idx, pos, surface FROM mentions_",
    "g2_normalise": f"SELECT doc_id, {normalised('''(['the ', 'DER  ', '', 'an' || chr(10), 'Theory '])[doc_id % 5 + 1] || text''')} AS name FROM documents",
    "g3_document_nodes": f"SELECT doc_id, {node_of('''source || CASE WHEN doc_id % 2 = 0 THEN '_Report.PDF' ELSE '_x.pdf.txt' END''')} AS node FROM documents",
    "g4_sentence_pairs": f"WITH {MENTIONS}, {PAIRS} SELECT chunk_id, a_pos, b_pos, src, dst, reason FROM pairs",
    "g6_rejections": f"WITH {MENTIONS}, {PAIRS} SELECT reason, count(*) AS n FROM pairs GROUP BY 1",
    "g7_document_links": f"WITH {MENTIONS}, {LINKS} SELECT chunk_id, src, dst, pos FROM links",
    "g8_edges": f"WITH {EDGES} SELECT seq, src, dst, relation, source, page, md5(chunk_text) AS text_md5 FROM edges_",
    "g9_append_edges": f"WITH {EDGES} SELECT 'parity' AS mode, relation, sum(CASE WHEN chunk_id::BIGINT % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM edges_ GROUP BY 2 UNION ALL SELECT 'dedupe', relation, count(*) FROM edges_ GROUP BY 2",
    "g10_graph_stats": f"WITH {EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM edges_ UNION SELECT dst FROM edges_ UNION SELECT {node_of('source')} FROM documents)) AS n_nodes, (SELECT count(*) FROM edges_) AS n_edges",
    "g11_membership": f"WITH {EDGES}, names AS (SELECT DISTINCT source AS name FROM documents UNION ALL SELECT n_name FROM nation) SELECT name, name IN (SELECT src FROM edges_ UNION SELECT dst FROM edges_) AS present FROM names",
    "r1_node_index": f"WITH {EDGES}, {INDEX} SELECT node_key, node FROM index_",
    "r2_match_entities": f"WITH {EDGES}, {INDEX}, {MATCHED} SELECT query_id, node, start_rank FROM starts",
    "r3_traverse": f"WITH {WALK} SELECT query_id, start_rank::BIGINT AS start_rank, level::BIGINT AS level, path, relation, seq FROM walk",
    "r4_graph_retrieve": f"WITH {WALK}, {best_of_walk('seq::VARCHAR')} SELECT query_id, nth AS rank, chunk_text, path AS entity_path, relation FROM best",
    "r3_document_graph": f"WITH {DOCUMENT_WALK} SELECT query_id, start_rank::BIGINT AS start_rank, level::BIGINT AS level, path, relation, seq FROM walk",
    "r4_document_graph": f"WITH {DOCUMENT_WALK}, {best_of_walk('source, page')} SELECT query_id, nth AS rank, md5(chunk_text) AS text_md5, source, page, path AS entity_path, relation FROM best",
    "r3_reached": f"""WITH RECURSIVE {TRADE}, ways AS (SELECT DISTINCT src AS a, dst AS b FROM trade UNION SELECT dst, src FROM trade),
      steps AS (SELECT query_id, start_rank, node, 0 AS level FROM starts UNION SELECT query_id, start_rank, b, level + 1 FROM steps JOIN ways ON node = a WHERE level < 6)
      SELECT query_id, start_rank::BIGINT AS start_rank, node, min(level)::BIGINT AS level FROM steps GROUP BY 1, 2, 3""",
    "q1_route": f"WITH {ROUTED} SELECT query_id, tool FROM tooled",
    "q2_enrich": f"WITH {SPOKEN}, recent AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS r FROM spoken WHERE back <= 4 AND role = 'user' GROUP BY 1), asked AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'and then?' ELSE 'this question has a few words more' END AS question FROM conversations) SELECT conv_id, question, CASE WHEN conv_id % 2 = 0 AND r IS NOT NULL THEN r || ' ' || question ELSE question END AS enriched FROM asked LEFT JOIN recent USING (conv_id)",
    "q3_rewrite": f"WITH {ROUTED} SELECT query_id, {rewritten('question', 'tool')} AS request FROM tooled",
    "q4_answer": f"""WITH {text_hits(5)}, first_ AS (SELECT query_id, array_to_string(({sentences('text')})[1:2], ' ') AS answer, confidence FROM hits WHERE rank = 1), places AS (SELECT query_id, count(DISTINCT (source, page)) AS n FROM hits GROUP BY 1)
      SELECT item_id AS query_id, 'retriever' AS tool_used, b.text AS request, coalesce(answer, 'No relevant context found in the loaded documents.') AS answer, coalesce(confidence, 'Low') AS confidence, coalesce(n, 0) AS n_sources, CASE WHEN answer IS NULL THEN 'no_context' ELSE 'ok' END AS status
      FROM benchmark b LEFT JOIN first_ f ON f.query_id = item_id LEFT JOIN places p ON p.query_id = item_id""",
    "q6_selection_prompt": """SELECT doc_id, 'The user selected this text from the document:' || chr(10) || '"' || text || '"' || chr(10) || chr(10) || 'Their question: what is ' || lang AS prompt FROM documents""",
    "q7_context": f"WITH {text_hits(3)}, c AS (SELECT query_id, 'DOCUMENT CONTEXT:' || chr(10) || chr(10) || string_agg('[' || rank || '] Source: ' || source || ' | Page: ' || page || ' | Section: ' || section || ' | Confidence: ' || confidence || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context FROM hits GROUP BY 1) SELECT query_id, length(context)::INTEGER AS n_chars, md5(context) AS context_md5 FROM c",
    "q8_history": f"WITH {SPOKEN}, {HISTORY} SELECT conv_id, history FROM hist",
    "q9_user_message": f"WITH {SPOKEN}, {HISTORY} SELECT conv_id, md5(CASE WHEN history IS NOT NULL THEN history || chr(10) || chr(10) ELSE '' END || coalesce(b.text, 'No relevant context found in the loaded documents.') || chr(10) || chr(10) || 'USER QUESTION: question ' || conv_id) AS message_md5 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (FROM hist WHERE conv_id % 2 = 0) USING (conv_id) LEFT JOIN benchmark b ON item_id = conv_id",
    "q10_sources": f"WITH {text_hits(8)}, once AS (SELECT *, (chunk_id::BIGINT % 3)::VARCHAR AS third FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, source, third ORDER BY rank) = 1) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position, source AS document, third AS page, section, confidence, score FROM once",
    "q11_confidence": f"WITH {text_hits(5)} SELECT item_id AS query_id, coalesce(confidence, 'Low') AS confidence FROM benchmark LEFT JOIN (FROM hits WHERE rank = 1 AND query_id % 4 <> 0) ON query_id = item_id",
    "q14_memory": f"WITH {SPOKEN} SELECT conv_id, count(*) + 2 AS n, max(turn) + 2 AS last_turn, 'an answer' AS last_text FROM spoken WHERE conv_id <> 3 GROUP BY 1",
    "q15_tools": tool_texts(),
    "e1_evaluate_questions": f"WITH {judged()} SELECT qa_id, round(answer_relevancy, 6) AS answer_relevancy, round(faithfulness, 6) AS faithfulness, round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall FROM per",
    "e5_report": f"WITH {judged()} SELECT {', '.join(exact_mean(m) + ' AS ' + m for m in ('answer_relevancy', 'faithfulness', 'context_precision', 'context_recall'))}, count(*) AS num_evaluated FROM per WHERE faithfulness IS NOT NULL",
    "e7_comparison": f"""WITH {by_method()}, typed AS (SELECT item_id AS qa_id, CASE WHEN item_id % 2 = 0 THEN 'single_fact' ELSE 'multi_hop' END AS question_type, unnest(['vector', 'graph']) AS method FROM benchmark)
      SELECT question_type, t.method, {exact_mean('coalesce(faithfulness, 0.0)')} AS faithfulness, {exact_mean('coalesce(context_precision, 0.0)')} AS context_precision, {exact_mean('CASE WHEN faithfulness IS NULL THEN 1.0 ELSE 0.0 END')} AS zero_result_rate, count(*) AS num_questions
      FROM typed t LEFT JOIN per p ON p.qa_id = t.qa_id AND p.method = t.method GROUP BY 1, 2""",
    "e10_score_bars": f"WITH {dense_hits(3)} SELECT query_id, chunk_id, rpad(repeat('#', floor(score * 30)::INTEGER), 30, '-') AS bar FROM hits WHERE score >= 0",
    "m4_panels": f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, (2000000 * count(*) FILTER (event_type = 'error') + count(*)) // (2 * count(*)) / 1000000.0::DOUBLE AS error_rate, {exact_mean('value', 6)} AS mean_latency, max(value) AS max_latency FROM events GROUP BY 1, time_bucket(INTERVAL 1 HOUR, ts)",
    "m4_latency_p95": "SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, round(p, 6) AS p95 FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, quantile_cont(value, 0.95) AS p FROM events GROUP BY 1)",
    "m5_busiest_first_per_user": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
}
ORACLES["v4_bucketed_upsert"] = ORACLES["v4_upsert"]
ORACLES["v5_inverted_lists"] = ORACLES["v5_similarity_search"]

_MINUTES = "minutes_ AS (SELECT epoch(time_bucket(INTERVAL 1 MINUTE, ts))::BIGINT // 60 AS m, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)"
_CLOCK = "strftime(make_timestamp((({}) * 60000000)::BIGINT), '%Y-%m-%d %H:%M:%S')"
BORDERS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, None]
ORACLES |= {
    "m4_latency_histogram": f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, le, (count(*) FILTER (value <= le OR (le IS NULL AND value IS NOT NULL)))::BIGINT AS requests
      FROM events, (SELECT unnest([{", ".join("NULL" if b is None else f"{b}::DOUBLE" for b in BORDERS)}]) AS le) GROUP BY 1, 2""",
    "m4_merged_panels": "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, (2000000 * count(*) FILTER (event_type = 'error') + count(*)) // (2 * count(*)) / 1000000.0::DOUBLE AS error_rate FROM events GROUP BY 1",
    "m4_uptime": f"""WITH {_MINUTES}, span AS (SELECT min(m) AS low, max(m) AS high FROM minutes_),
      days AS (SELECT m // 1440 AS d, count(*) FILTER (requests > errors) AS up_minutes FROM minutes_ GROUP BY 1),
      sized AS (SELECT d, up_minutes, least(high, d * 1440 + 1439) - greatest(low, d * 1440) + 1 AS seen_minutes FROM days, span)
      SELECT strftime(make_timestamp((d * 86400000000)::BIGINT), '%Y-%m-%d') AS day, up_minutes, seen_minutes, (2000000 * up_minutes + seen_minutes) // (2 * seen_minutes) / 1000000.0::DOUBLE AS uptime FROM sized""",
    "m4_uptime_islands": f"""WITH {_MINUTES}, up AS (SELECT m, lag(m) OVER (ORDER BY m) AS b FROM minutes_ WHERE requests > errors),
      marked AS (SELECT *, sum((b IS NULL OR m - b > 3)::INT) OVER (ORDER BY m) AS island FROM up)
      SELECT {_CLOCK.format("min(m)")} AS up_from, {_CLOCK.format("max(m) + 1")} AS up_to, count(*) AS minutes, min(m) - arg_min(coalesce(b, -1), m) - 1 + CASE WHEN arg_min(coalesce(b, -1), m) < 0 THEN NULL ELSE 0 END AS down_before FROM marked GROUP BY island""",
    "m5_sessions": """WITH marked AS (SELECT *, sum((before IS NULL OR ts > before + INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM marked GROUP BY user_id, nth""",
    "m5_sliding": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors
      FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1""",
}

_LABELS = ["PERSON", "ORG", "GPE", "LOC", "EVENT", "CARDINAL", "DATE"]
LABELLED = f"""
sents AS (SELECT chunk_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_idx FROM (SELECT doc_id::VARCHAR AS chunk_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)),
toks AS (SELECT chunk_id, sent_idx, unnest(t) AS surface, generate_subscripts(t, 1) AS nth_ FROM (SELECT *, regexp_split_to_array(sentence, '[^\\p{{L}}\\p{{N}}]+') AS t FROM sents)),
named AS (SELECT *, ({_LABELS})[('0x' || substr(md5(surface), 1, 8))::BIGINT % 7 + 1] AS label FROM toks WHERE regexp_full_match(surface, '\\p{{Lu}}\\p{{Ll}}{{2,}}'))"""
ORACLES |= {
    "g1_labelled_mentions": f"WITH {LABELLED} SELECT chunk_id, sent_idx, row_number() OVER (PARTITION BY chunk_id ORDER BY sent_idx, nth_) - 1 AS pos, surface, label FROM named",
    "g1_relevant_labels": f"WITH {LABELLED} SELECT label, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT surface) AS n_names FROM named WHERE label NOT IN ('CARDINAL', 'DATE') GROUP BY 1",
}
