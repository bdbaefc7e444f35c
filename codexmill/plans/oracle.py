"""The same rows as `plans.queries` gives, in DuckDB's SQL over the same tables."""

from __future__ import annotations

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_WORDS = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


def words_of(x: str) -> str:
    return _WORDS.format(x=x)


_KEPT = f"SELECT doc_id, lang, {_strip('text')} AS t FROM documents WHERE length({_strip('text')}) >= 50"


def _pieces(source: str, keys: str, made: str, measure: str) -> str:
    """Rows of `made`, a list over the columns of `source`, without blank ones, numbered."""
    p = f"SELECT {keys}, list_filter({made}, lambda x: {_strip('x')} <> '') AS p FROM ({source})"
    e = f"SELECT {keys}, unnest(p) AS chunk_text, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS chunk_order FROM ({p})"
    return f"SELECT {keys}, chunk_order, chunk_text{measure} FROM ({e})"


def _windows(units: str, size: int, step: int, join: str) -> str:
    return f"[array_to_string({units}[i + 1 : i + {size}], {join}) for i in range(0, len({units}), {step})]"


_WORD_UNITS = f"SELECT doc_id, lang, {words_of('t')} AS u FROM ({_KEPT})"
_WORD_CHUNKS = _pieces(_WORD_UNITS, "doc_id, lang", _windows("u", 1000, 750, "' '"), f", CAST(len({words_of('chunk_text')}) AS INTEGER) AS chunk_size")
_CHARS = ", CAST(length(chunk_text) AS INTEGER) AS chunk_size"

_EDGES = "SELECT DISTINCT l_partkey AS src, dst FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND l_partkey <> dst"
_TRADES = """SELECT DISTINCT 'c' || o_custkey AS caller, 'p' || l_partkey AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem"""
_TRADERS = "SELECT 'c' || c_custkey AS name FROM customer UNION ALL SELECT 'p' || p_partkey FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier"
_NAMED = "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"

CODE = f"""
WITH f AS (
  SELECT s_suppkey AS seq, r_name AS path, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE r_name || '.' || n_name END AS class,
    CASE WHEN s_suppkey % 10 = 1 THEN 'u' || s_suppkey ELSE 'm' || (s_suppkey % 4) END AS short
  FROM supplier JOIN ({_NAMED}) n ON s_nationkey = n_nationkey),
fn AS (SELECT *, class || '.' || short AS name, 'Function:' || path || ':' || class || '.' || short || ':' || seq AS id FROM f),
total AS (SELECT count(*) AS total FROM supplier),
calls AS (
  SELECT c_custkey AS call_id, c_custkey % total AS src,
    CASE c_custkey % 6 WHEN 0 THEN 'self.m' || ((c_custkey // 6) % 4) WHEN 1 THEN n_name || '.m' || ((c_custkey // 6) % 4) WHEN 2 THEN 'm' || ((c_custkey // 7) % 4)
      WHEN 3 THEN fn.name WHEN 4 THEN 'ext' || (c_custkey % 4) ELSE 'u' || ((c_custkey * 10) % total + 1) END AS call
  FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN total JOIN fn ON fn.seq = (c_custkey * 7) % total),
ent AS (SELECT class, short, id, seq * 2 AS o FROM fn UNION ALL SELECT regexp_replace(name, '\\.[^.]*$', ''), short, id, seq * 2 + 1 FROM fn),
c AS (SELECT class, short, arg_max(id, o) AS id, min(o) AS o FROM ent GROUP BY class, short),
tails AS (SELECT regexp_extract(class, '[^.]*$') AS tail, short, arg_min(id, o) AS id FROM c GROUP BY 1, 2),
nm AS (SELECT name, arg_max(id, seq) AS id FROM fn GROUP BY name),
fl AS (SELECT path, short, arg_max(id, seq) AS id FROM fn GROUP BY path, short),
one AS (SELECT short, max(id) AS id FROM fn GROUP BY short HAVING count(*) = 1),
k AS (
  SELECT calls.*, fn.path, fn.class, regexp_extract(fn.class, '[^.]*$') AS ctail, fn.id AS caller_id, string_split(call, '.') AS parts, regexp_extract(call, '[^.]*$') AS cshort
  FROM calls JOIN fn ON fn.seq = calls.src),
solved AS (
  SELECT k.*, a.id AS t1, b.id AS t2a, d.id AS t2b, e.id AS t3a, g.id AS t3b, h.id AS t4, i.id AS t5, j.id AS t6
  FROM k LEFT JOIN nm a ON a.name = call
  LEFT JOIN c b ON call LIKE 'self.%' AND b.class = k.class AND b.short = substr(call, 6)
  LEFT JOIN tails d ON call LIKE 'self.%' AND d.tail = ctail AND d.short = substr(call, 6)
  LEFT JOIN c e ON len(parts) = 2 AND e.class = parts[1] AND e.short = parts[2]
  LEFT JOIN tails g ON len(parts) = 2 AND g.tail = parts[1] AND g.short = parts[2]
  LEFT JOIN c h ON h.class = k.class AND h.short = cshort LEFT JOIN fl i ON i.path = k.path AND i.short = cshort LEFT JOIN one j ON j.short = cshort),
r AS (
  SELECT call_id, src, caller_id, coalesce(t1, t2a, t2b, t3a, t3b, t4, t5, t6, 'External:' || call) AS target_id,
    CASE WHEN t1 IS NOT NULL THEN '1' WHEN t2a IS NOT NULL THEN '2a' WHEN t2b IS NOT NULL THEN '2b' WHEN t3a IS NOT NULL THEN '3a' WHEN t3b IS NOT NULL THEN '3b'
      WHEN t4 IS NOT NULL THEN '4' WHEN t5 IS NOT NULL THEN '5' WHEN t6 IS NOT NULL THEN '6' END AS strategy FROM solved),
placed AS (SELECT *, src * 1048576 + row_number() OVER (PARTITION BY src ORDER BY call_id) - 1 AS o FROM r),
edge AS (SELECT caller_id AS src, target_id AS dst, min(o) AS o FROM placed WHERE caller_id <> target_id GROUP BY 1, 2),
outs AS (SELECT edge.src AS node_id, string_agg(coalesce(fn.name, substr(dst, 10)), '|' ORDER BY o) AS names FROM edge LEFT JOIN fn ON fn.id = dst GROUP BY 1),
ins AS (SELECT dst AS node_id, string_agg(fn.name, '|' ORDER BY o) AS names FROM edge JOIN fn ON fn.id = edge.src GROUP BY 1),
en AS (SELECT fn.id AS node_id, path, name, class AS defined_in, coalesce(outs.names, '') AS calls, coalesce(ins.names, '') AS called_by, 'body of ' || short AS code
  FROM fn LEFT JOIN outs ON outs.node_id = fn.id LEFT JOIN ins ON ins.node_id = fn.id),
node AS (
  SELECT DISTINCT 'File:' || path AS node_id, 'File' AS type, path AS name, path, CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS INTEGER) AS line_number, CAST(NULL AS VARCHAR) AS content FROM fn
  UNION ALL SELECT DISTINCT 'Contract:' || path || ':' || class, 'Class/Contract', class, NULL, path, NULL, NULL FROM fn
  UNION ALL SELECT id, 'Function', name, NULL, path, CAST(seq AS INTEGER), 'body of ' || short FROM fn
  UNION ALL SELECT DISTINCT dst, 'External', substr(dst, 10), NULL, NULL, NULL, NULL FROM edge WHERE dst LIKE 'External:%'),
link AS (
  SELECT DISTINCT 'File:' || path AS src, 'Contract:' || path || ':' || class AS dst, 'DEFINES' AS relation FROM fn
  UNION ALL SELECT 'Contract:' || path || ':' || class, id, 'DEFINES' FROM fn UNION ALL SELECT src, dst, 'CALLS' FROM edge)
"""

_SEEDS = "(VALUES (0, 0), (7, 1), (42, 2)) s(k, o)"


def _expanded(seeds: str) -> str:
    """k, relationship, place of the neighbours of seeds (k, o)."""
    return f"""SELECT k, arg_min(rel, place) AS relationship, min(place) AS place FROM (
      SELECT e.dst AS k, 'CALLS' AS rel, {{'o': s.o, 'd': 0, 'q': e.dst}} AS place FROM ({_EDGES}) e JOIN {seeds} ON e.src = s.k
      UNION ALL SELECT e.src, 'CALLED_BY', {{'o': s.o, 'd': 1, 'q': e.src}} FROM ({_EDGES}) e JOIN {seeds} ON e.dst = s.k)
    WHERE k NOT IN (SELECT k FROM {seeds}) GROUP BY k"""


_CONTENT = "CASE WHEN p_partkey % 3 = 0 THEN 'chunk ' || p_name WHEN p_partkey % 3 = 1 THEN 'function ' || p_name WHEN p_partkey % 9 <> 2 THEN 'node ' || p_name END"


def _bfs(seeds: str, depth: int) -> str:
    return f"""WITH RECURSIVE both_ AS (SELECT src, dst FROM ({_EDGES}) UNION SELECT dst, src FROM ({_EDGES})),
    walk(k, depth) AS (SELECT k, 0 FROM (VALUES {seeds}) v(k) UNION SELECT dst, depth + 1 FROM walk JOIN both_ ON src = k WHERE depth < {depth})
    SELECT CAST(k AS VARCHAR) AS node_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY k HAVING min(depth) > 0"""


_CLEAN = r"""
WITH t AS (SELECT doc_id, text, replace(replace(text, chr(10), chr(13) || chr(10) || ' ' || chr(13) || chr(10) || chr(9) || chr(10)), '. ', '.' || chr(10) || '# ') AS x FROM documents),
l AS (SELECT doc_id, text, [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in string_split(regexp_replace(x, '\r\n|\r', chr(10), 'g'), chr(10))] AS l FROM t),
p AS (SELECT doc_id, text, array_to_string([l[i] for i in range(1, len(l) + 1) if l[i] <> '' OR i = 1 OR l[i - 1] <> ''], chr(10)) AS p FROM l)
SELECT doc_id, CASE WHEN regexp_matches(p, '第[一二三四五六七八九十\d]+章') OR regexp_matches(p, 'Chapter\s+\d+') OR regexp_matches(p, '(?m)^#{1,3}\s+') OR regexp_matches(p, '(?m)^\d+\.\s+[A-Z]')
  THEN regexp_replace(regexp_replace(regexp_replace(p, '(第[一二三四五六七八九十\d]+章)', chr(10) || chr(10) || '\1', 'g'), '(Chapter\s+\d+)', chr(10) || chr(10) || '\1', 'g'), '(?m)(^#{1,3}\s+)', chr(10) || chr(10) || '\1', 'g') ELSE p END AS cleaned,
  regexp_matches(text, '第[一二三四五六七八九十\d]+章') OR regexp_matches(text, 'Chapter\s+\d+') OR regexp_matches(text, '(?m)^#{1,3}\s+') OR regexp_matches(text, '(?m)^\d+\.\s+[A-Z]') AS chapters FROM p
"""

_PROMPT_HEAD = "You are a coding assistant. Answer the question based on the following context."


def _section(role: str, tag: str, none: str) -> str:
    return f"""coalesce((SELECT string_agg('[{tag} ' || n || ']' || chr(10) || x || chr(10), chr(10) ORDER BY n)
      FROM (SELECT coalesce(text, '') AS x, row_number() OVER (ORDER BY turn, text) AS n FROM conversations t WHERE t.conv_id = c.conv_id AND role = '{role}')), '{none}' || chr(10))"""


_DISTANCE = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE))))"
_QUERY_VECTOR = "(SELECT embedding AS e FROM embeddings WHERE vec_id = 0) q"

SQL: dict[str, str] = {
    "file_filter": """
SELECT page_id, url || (['.sol', '.rs', '.move', '.c', '.CPP', '.go', '.py', '.t.sol', '.md', '.C'])[page_id % 10 + 1] AS path,
  (['solidity', 'rust', 'move', 'cpp', 'cpp', 'go', 'python', 'solidity', NULL, 'cpp'])[page_id % 10 + 1] AS language,
  ([true, true, true, true, false, true, true, false, false, true])[page_id % 10 + 1] AS kept FROM pages""",
    "file_eligible": f"""
SELECT doc_id, coalesce(n_chars <= 4194 AND lang <> 'de' AND NOT contains(source || '/' || doc_id || '.' || lang, 'src1') AND lower(lang) IN ('en', 'fr', 'de'), false)
  AND coalesce(length({_strip("text")}) >= 50, false) AS eligible FROM documents""",
    "doc_word_chunks": f"SELECT doc_id, chunk_order, chunk_text, chunk_size FROM ({_WORD_CHUNKS})",
    "doc_sentence_chunks": _pieces(f"SELECT doc_id, string_split(t, '.') AS u FROM ({_KEPT})", "doc_id", _windows("u", 3, 2, "'.'"), _CHARS),
    "doc_char_chunks": _pieces(_KEPT, "doc_id", "[substring(t, i + 1, 800) for i in range(0, length(t), 600)]", _CHARS),
    "doc_passage_chunks": _pieces(
        rf"SELECT doc_id, list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: {_strip('x')} <> '') AS u FROM documents", "doc_id", _windows("u", 5, 3, "chr(10) || chr(10)"), ""
    ),
    "code_split_overlap": f"""
WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS node_id, text, {words_of("text")} AS u FROM documents),
p AS (SELECT node_id, text, CASE WHEN len(u) > 1000 THEN [array_to_string(u[i + 1 : i + 1000], ' ') for i in range(0, len(u) - 100, 900)] ELSE [text] END AS p FROM w),
e AS (SELECT node_id, len(p) > 1 AS several, node_id || ':' || substr(sha256(node_id || text), 1, 8) AS parent, unnest(p) AS code, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS n FROM p)
SELECT node_id, CASE WHEN several THEN parent ELSE '' END AS parent_doc_id, CASE WHEN several THEN parent || '_chunk_' || n ELSE '' END AS chunk_id, n AS chunk_order, code FROM e""",
    "long_text_clean": _CLEAN,
    "paragraph_counts": _CLEAN.split("SELECT doc_id, CASE")[0].replace("WITH t AS (SELECT doc_id, text, replace(replace(text, chr(10), chr(13) || chr(10) || ' ' || chr(13) || chr(10) || chr(9) || chr(10)), '. ', '.' || chr(10) || '# ') AS x",
      "WITH t AS (SELECT doc_id, text, replace(text, chr(10), chr(13) || chr(10) || ' ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10)) AS x")
    + r"""SELECT t.doc_id, CAST(len(string_split(regexp_replace(x, '\r\n|\r', chr(10), 'g'), chr(10) || chr(10))) AS INTEGER) AS before, CAST(len(string_split(p, chr(10) || chr(10))) AS INTEGER) AS after FROM t JOIN p USING (doc_id)""",
    "doc_page_chunks": _pieces("SELECT doc_id, string_split(text, chr(10)) AS u FROM documents WHERE text IS NOT NULL", "doc_id", _windows("u", 3, 2, "chr(12)"), ""),
    "doc_token_chunks": _pieces(rf"SELECT doc_id, regexp_extract_all(t, '\w+|[^\w\s]') AS u FROM ({_KEPT})", "doc_id", _windows("u", 512, 462, "' '"), _CHARS),
    "chunk_files": f"""
SELECT substr(sha256(path), 1, 16) || '_chunk_' || chunk_order AS chunk_id, path AS original_file, chunk_text, substr(sha256(path), 1, 16) AS parent_doc_id, chunk_order, chunk_size, doc_id || '.' || c.lang AS file_name, n_chars AS file_size, '.' || c.lang AS file_extension
FROM ({_WORD_CHUNKS}) c JOIN (SELECT doc_id, n_chars, source || '/' || doc_id || '.' || lang AS path FROM documents) USING (doc_id)""",
    "chunks_of_file": f"""
SELECT substr(sha256(path), 1, 16) || '_chunk_' || chunk_order AS chunk_id, chunk_order, chunk_text FROM ({_WORD_CHUNKS}) JOIN (SELECT doc_id, source || '/' || doc_id || '.' || lang AS path FROM documents WHERE doc_id = 3) USING (doc_id)""",
    "chunk_samples": f"""
SELECT substr(sha256(path), 1, 16) || '_chunk_' || chunk_order AS chunk_id, path AS original_file, chunk_order, chunk_size, substr(chunk_text, 1, 200) AS preview
FROM ({_WORD_CHUNKS}) JOIN (SELECT doc_id, source || '/' || doc_id || '.' || lang AS path FROM documents) USING (doc_id) ORDER BY path, chunk_order LIMIT 3""",
    "presets": """
SELECT *, CASE WHEN n_included > 0 THEN 0 ELSE (SELECT count(*) FROM documents WHERE strlen(text) <= max_mb * 1048576) END AS n_files FROM (VALUES ('default', 'word', 800, 200, 1000, 10.0::DOUBLE, 0, 6, false), ('code_project', 'word', 1000, 250, 1000, 20.0, 0, 36, false), ('long_text', 'passage', 8, 3, 500, 200.0, 12, 3, true), ('academic', 'passage', 6, 2, 1000, 100.0, 6, 6, true),
 ('tech_docs', 'passage', 5, 2, 1000, 50.0, 5, 3, true), ('precise', 'sentence', 3, 1, 1000, 10.0, 0, 5, false), ('large_context', 'passage', 12, 4, 1000, 500.0, 0, 3, true), ('token_based', 'token', 512, 50, 1000, 100.0, 0, 5, false))
 v(name, split_by, chunk_size, chunk_overlap, batch_size, max_mb, n_included, n_excluded, long_text)""",
    "path_columns": r"""
SELECT page_id, url AS unix, regexp_extract(url, '[^/]*$') AS base, regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS stem, regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1) AS ext,
  regexp_extract(url, '[^/]*/[^/]*$') AS suffix, regexp_replace(url, '[^a-zA-Z0-9_.:-]', '_', 'g') AS sanitized, CASE WHEN page_id % 3 = 0 THEN 'none' ELSE url END AS given, regexp_extract(url, '[^.]*$') AS short,
  CASE WHEN contains(url, '.') THEN regexp_replace(url, '\.[^.]*$', '') END AS prefix FROM pages""",
    "parse_functions": """
WITH d AS (SELECT source || '/' || doc_id || '.' || lang || '.py' AS path, doc_id || '.' || lang AS stem FROM documents)
SELECT path AS file_path, stem || '.K.f' AS name, CAST(2 AS INTEGER) AS start_line, CAST(3 AS INTEGER) AS end_line, stem || '.K' AS contract_name, 'public' AS visibility, 'self.g|len' AS calls FROM d
UNION ALL SELECT path, stem || '.K.g', 5, 6, stem || '.K', 'public', '' FROM d""",
    "embed_udf": r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents),
b AS (SELECT doc_id, md5_number_upper(w) % 64 AS b, sum(CASE WHEN md5_number_upper(w) >= 9223372036854775808 THEN 1 ELSE -1 END) AS s FROM w GROUP BY ALL),
h AS (SELECT doc_id, count(*) FILTER (s <> 0) AS n FROM b GROUP BY doc_id)
SELECT d.doc_id, CAST(64 AS INTEGER) AS dimension, CAST(coalesce(n, 0) AS INTEGER) AS n_held, CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents d LEFT JOIN h USING (doc_id)""",
    "generate_answer": f"""
WITH t AS (SELECT conv_id, role, regexp_replace({_strip("string_split(coalesce(text, ''), chr(10))[1]")}, '\\s+', ' ', 'g') AS x, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS n FROM conversations WHERE role IN ('user', 'assistant')),
a AS (SELECT conv_id, string_agg('[' || CASE role WHEN 'user' THEN 'Chunk ' ELSE 'Dep ' END || n || ']' || CASE WHEN x = '' THEN '' ELSE ' ' || x END || chr(10), '' ORDER BY role DESC, n) AS x FROM t GROUP BY conv_id)
SELECT conv_id, 'Question: ' || conv_id || chr(10) || coalesce(x, '') AS answer FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN a USING (conv_id)""",
    "chunk_stats": f"SELECT count(*) AS total_chunks, CAST(coalesce(sum(chunk_size), 0) AS BIGINT) AS total_size, coalesce(avg(chunk_size), 0.0) AS avg_chunk_size FROM ({_WORD_CHUNKS})",
    "chunk_ext_counts": f"SELECT lang AS ext, count(*) AS n FROM ({_WORD_CHUNKS}) GROUP BY lang ORDER BY lang",
    "top_chunk_files": f"SELECT doc_id AS original_file, count(*) AS n FROM ({_WORD_CHUNKS}) GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 10",
    "get_by_id": rf"SELECT 'it''s\' || doc_id || ':' || chunk_order AS node_id, chunk_text FROM ({_WORD_CHUNKS}) WHERE doc_id = 0 AND chunk_order = 0",
    "graph_nodes": CODE + "SELECT * FROM node",
    "graph_edges": CODE + "SELECT * FROM link",
    "graph_counts": CODE + "SELECT (SELECT count(*) FROM node) AS node_count, (SELECT count(*) FROM link) AS edge_count",
    "call_graph_edges": CODE
    + """SELECT c.name AS caller, coalesce(d.name, substr(dst, 10)) AS callee, CASE WHEN dst LIKE 'External:%' THEN 'external' ELSE 'internal' END AS call_type,
  CASE c.path[1] WHEN 'A' THEN 'rust' WHEN 'E' THEN 'solidity' ELSE 'python' END AS language FROM edge JOIN fn c ON c.id = edge.src LEFT JOIN fn d ON d.id = edge.dst""",
    "expand_external": CODE
    + """, s AS (SELECT id AS k, seq AS o FROM fn WHERE seq < 20)
SELECT k AS node_id, arg_min(rel, place) AS relationship FROM (SELECT dst AS k, 'CALLS' AS rel, [s.o, 0, edge.o] AS place FROM edge JOIN s ON edge.src = s.k UNION ALL SELECT src, 'CALLED_BY', [s.o, 1, edge.o] FROM edge JOIN s ON edge.dst = s.k)
WHERE k NOT LIKE 'External:%' AND k NOT IN (SELECT k FROM s) GROUP BY k""",
    "expand_levels": f"""
WITH one AS (SELECT x.k, relationship, place, {_CONTENT} AS content FROM ({_expanded("(VALUES (0, 0), (7, 1), (42, 2)) s(k, o)")}) x JOIN part ON p_partkey = x.k WHERE {_CONTENT} IS NOT NULL),
ranked AS (SELECT k, row_number() OVER (ORDER BY place) AS o FROM one),
two AS (SELECT x.k, relationship, {_CONTENT} AS content FROM ({_expanded("ranked s")}) x JOIN part ON p_partkey = x.k WHERE {_CONTENT} IS NOT NULL AND x.k NOT IN (0, 7, 42))
SELECT CAST(k AS VARCHAR) AS node_id, relationship, content, CAST(1 AS INTEGER) AS depth FROM one UNION ALL SELECT CAST(k AS VARCHAR), relationship, content, CAST(2 AS INTEGER) FROM two""",
    "call_resolution": CODE + "SELECT call_id, target_id, strategy FROM r",
    "node_match": CODE
    + r"""
, nodes AS (SELECT seq, 'root/src/' || path AS n_path, name AS n_name, seq AS n_line,
    CASE WHEN seq % 6 = 5 THEN 'x:' || seq ELSE 'Function:root/src/' || path || ':' || CASE WHEN seq % 6 = 1 THEN short ELSE name END || ':' || seq END AS node_id FROM fn),
rec AS (SELECT seq AS func_id, name, short, seq AS line, CASE seq % 6 WHEN 2 THEN 'home/me/root/src/' || path WHEN 5 THEN 'other/src/' || path WHEN 4 THEN 'elsewhere/' || path ELSE 'root/src/' || path END AS path FROM fn),
ends AS (SELECT *, array_to_string(string_split(path, '/')[i:], '/') AS e FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM rec)),
tries AS (SELECT func_id, 1 AS s, 'Function:' || path || ':' || name || ':' || line AS id FROM rec UNION ALL SELECT func_id, 2, 'Function:' || path || ':' || short || ':' || line FROM rec
  UNION ALL SELECT func_id, 5, 'Function:' || e || ':' || name || ':' || line FROM ends UNION ALL SELECT func_id, 5, 'Function:' || e || ':' || short || ':' || line FROM ends),
found AS (SELECT func_id, s, seq, node_id FROM tries JOIN nodes ON id = node_id
  UNION ALL SELECT func_id, CASE WHEN path = n_path AND name = n_name THEN 3 WHEN path = n_path AND short = regexp_extract(n_name, '[^.]*$') THEN 4
    WHEN string_split(path, '/')[-2:] = string_split(n_path, '/')[-2:] AND (n_name = name OR regexp_extract(n_name, '[^.]*$') = short) THEN 6 END AS s, seq, node_id FROM rec JOIN nodes ON line = n_line)
SELECT func_id, arg_min(node_id, CAST(s AS BIGINT) * 1000000000 + seq) AS node_id, CAST(min(s) AS INTEGER) AS strategy FROM found WHERE s IS NOT NULL GROUP BY func_id""",
    "parent_scope": CODE + "SELECT node_id, defined_in FROM en",
    "callees": CODE + "SELECT node_id, names FROM outs",
    "callers": CODE + "SELECT node_id, names FROM ins",
    "enriched_chunks": CODE
    + r"""SELECT node_id, defined_in, calls, called_by, array_to_string(['[METADATA]', 'File: ' || path, 'Function: ' || name, 'Type: Function', 'Node_ID: ' || node_id, '', '[CONTEXT]', 'Defined_In: ' || defined_in,
  'Calls: ' || replace(calls, '|', ', '), 'Called_By: ' || replace(called_by, '|', ', '), '', '[CODE]', code], chr(10)) AS text FROM en""",
    "text_roundtrip": CODE + "SELECT path AS file_path, name AS function_name, 'Function' AS node_type, node_id, '' AS chunk_id, '' AS parent_doc_id, CAST(0 AS INTEGER) AS chunk_order, defined_in, calls, called_by, code FROM en",
    "neighbors_1hop": f"SELECT CAST(k AS VARCHAR) AS node_id, relationship FROM ({_expanded(_SEEDS)})",
    "expand_content": f"SELECT CAST(k AS VARCHAR) AS node_id, relationship, {_CONTENT} AS content FROM ({_expanded(_SEEDS)}) JOIN part ON p_partkey = k WHERE {_CONTENT} IS NOT NULL",
    "bfs_depth_2": _bfs("(0), (7), (42)", 2),
    "bfs_depth_3": _bfs("(0), (7), (42)", 3),
    "degrees": f"""
SELECT CAST(k AS VARCHAR) AS node_id, CAST(sum(u) AS BIGINT) AS up, CAST(sum(d) AS BIGINT) AS down
FROM (SELECT src AS k, 0 AS u, 1 AS d FROM ({_EDGES}) UNION ALL SELECT dst, 1, 0 FROM ({_EDGES})) GROUP BY k""",
    "call_tree_counts": f"""
WITH t AS ({_TRADES}) SELECT name, (SELECT count(*) FROM t WHERE callee = name) AS upstream_count, (SELECT count(*) FROM t WHERE caller = name) AS downstream_count FROM ({_TRADERS})""",
    "call_tree_stats": f"""
WITH t AS ({_TRADES}), c AS (SELECT name, (SELECT count(*) FROM t WHERE callee = name) AS up, (SELECT count(*) FROM t WHERE caller = name) AS down FROM ({_TRADERS}))
SELECT count(*) AS total_functions, count(*) FILTER (up > 0) AS functions_with_upstream, count(*) FILTER (down > 0) AS functions_with_downstream,
  max(up) AS max_upstream_count, max(down) AS max_downstream_count, count(*) FILTER (up = 0 AND down = 0) AS isolated_functions FROM c""",
    "entry_points": f"SELECT name FROM ({_TRADERS}) WHERE name NOT IN (SELECT callee FROM ({_TRADES}))",
    "leaf_functions": f"SELECT name FROM ({_TRADERS}) WHERE name NOT IN (SELECT caller FROM ({_TRADES}))",
    "call_text_search": rf"""
WITH f AS (SELECT doc_id, regexp_split_to_array({_strip("text")}, '\s+')[1] AS name, lower(replace(text, '. ', '(. ')) AS content FROM documents)
SELECT DISTINCT a.doc_id AS caller, b.name AS callee FROM f a JOIN (SELECT DISTINCT name FROM f WHERE name <> '') b ON a.name <> '' AND a.name <> b.name AND contains(a.content, lower(b.name))
  AND regexp_matches(a.content, regexp_escape(lower(b.name)) || '\s*\(')""",
    "call_relationships": CODE
    + r""", called AS (SELECT fn.short AS name, cshort, lower(call) || ' (x)' AS content FROM k JOIN fn ON fn.seq = k.src)
SELECT DISTINCT a.name AS caller, b.short AS callee FROM called a JOIN (SELECT DISTINCT short FROM fn) b ON a.name <> b.short AND (a.cshort = b.short OR regexp_matches(a.content, regexp_escape(lower(b.short)) || '\s*\('))""",
    "call_list_lookup": CODE + "SELECT DISTINCT fn.short AS caller, cshort AS callee FROM k JOIN fn ON fn.seq = k.src WHERE cshort IN (SELECT short FROM fn) AND fn.short <> cshort",
    "call_cycles": CODE.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, p AS (SELECT DISTINCT fn.short AS caller, cshort AS callee FROM k JOIN fn ON fn.seq = k.src WHERE cshort IN (SELECT short FROM fn) AND fn.short <> cshort),
reached(a, b) AS (SELECT caller, callee FROM p UNION SELECT reached.a, p.callee FROM reached JOIN p ON p.caller = reached.b)
SELECT x.a AS name, min(x.b) AS component FROM reached x JOIN reached y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
    "call_tree_paths": f"""
WITH RECURSIVE e AS ({_TRADES}), t(root, depth, node, path) AS (
  SELECT name, 0, name, [name] FROM ({_TRADERS}) UNION ALL SELECT root, depth + 1, callee, list_append(path, callee) FROM t JOIN e ON caller = node WHERE NOT list_contains(path, callee))
SELECT root, CAST(depth AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM t""",
    "call_tree_paths_up": f"""
WITH RECURSIVE e AS ({_TRADES}), t(root, depth, node, path) AS (
  SELECT name, 0, name, [name] FROM ({_TRADERS}) UNION ALL SELECT root, depth + 1, caller, list_append(path, caller) FROM t JOIN e ON callee = node WHERE NOT list_contains(path, caller))
SELECT root, CAST(depth AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM t""",
    "dependency_graph": f"""
WITH RECURSIVE e AS ({_TRADES}),
d(node, depth) AS (SELECT 'p0', 0 UNION SELECT callee, depth + 1 FROM d JOIN e ON caller = node WHERE depth < 2), u(node, depth) AS (SELECT 'p0', 0 UNION SELECT caller, depth + 1 FROM u JOIN e ON callee = node WHERE depth < 2)
SELECT 'downstream' AS direction, node AS name, CAST(min(depth) AS INTEGER) AS depth FROM d WHERE depth > 0 GROUP BY node
UNION ALL SELECT 'upstream', node, CAST(min(depth) AS INTEGER) FROM u WHERE depth > 0 GROUP BY node""",
    "function_names": CODE + "SELECT DISTINCT name FROM fn",
    "functions_of_contract": CODE + "SELECT seq, name FROM fn WHERE class = (SELECT min(class) FROM fn)",
    "function_by_name": CODE + "SELECT min(seq) AS seq, name FROM fn WHERE name = (SELECT name FROM fn WHERE seq = 2) GROUP BY name",
    "call_graph_stats": f"""
WITH e AS (SELECT src, dst, p_type, CASE WHEN length(CAST(src AS VARCHAR)) = length(CAST(dst AS VARCHAR)) THEN 'same' ELSE 'other' END AS ct FROM ({_EDGES}) JOIN part ON p_partkey = src)
SELECT 'total_edges' AS key, count(*) AS n FROM e UNION ALL SELECT 'language:' || p_type, count(*) FROM e GROUP BY p_type UNION ALL SELECT 'call_type:' || ct, count(*) FROM e GROUP BY ct
UNION ALL SELECT 'unique_functions_count', count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e) HAVING count(*) > 0""",
    "call_graph_overview": CODE
    + """, e AS (SELECT c.name AS caller, coalesce(d.name, substr(dst, 10)) AS callee, CASE WHEN dst LIKE 'External:%' THEN 'external' ELSE 'internal' END AS t,
  CASE c.path[1] WHEN 'A' THEN 'rust' WHEN 'E' THEN 'solidity' ELSE 'python' END AS l FROM edge JOIN fn c ON c.id = edge.src LEFT JOIN fn d ON d.id = edge.dst),
ranked AS (SELECT *, row_number() OVER (ORDER BY caller, callee, t, l) AS n FROM e), overall AS (SELECT count(*) AS total FROM e)
SELECT CAST(0 AS INTEGER) AS n, 'Call graph (' || total || ' calls)' AS line FROM overall
UNION ALL SELECT CAST(n AS INTEGER), regexp_extract(caller, '[^.]*$') || ' -> ' || regexp_extract(callee, '[^.]*$') || ' [' || t || '] (' || l || ')' FROM ranked WHERE n <= 50
UNION ALL SELECT CAST(51 AS INTEGER), '... and ' || (total - 50) || ' more' FROM overall WHERE total > 50""",
    "rendered_tree": f"""
WITH e AS ({_TRADES}), t AS (SELECT 'c1' AS path, 'c1' AS line UNION ALL SELECT 'c1>' || callee, '  ' || callee FROM e WHERE caller = 'c1'
  UNION ALL SELECT 'c1>' || a.callee || '>' || b.callee, '    ' || b.callee FROM e a JOIN e b ON a.caller = 'c1' AND b.caller = a.callee)
SELECT CAST(row_number() OVER (ORDER BY string_split(path, '>')) - 1 AS INTEGER) AS n, line FROM t""",
    "functions_csv": CODE
    + """SELECT name, class AS contract, CASE WHEN seq % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, CAST(seq AS INTEGER) AS line_number, path AS file_path, 'view, virtual' AS modifiers,
  CAST((SELECT count(*) FROM calls WHERE calls.src = fn.seq) AS INTEGER) AS calls_count FROM fn""",
    "kept_functions": CODE
    + """SELECT seq, (['constructor', 'receive', 'public', 'fallback'])[seq % 4 + 1] AS visibility, path || (['.sol', '.rs', '.go'])[seq % 3 + 1] AS file_path FROM fn WHERE seq % 3 = 1 OR seq % 4 = 2""",
    "knn_l2": f"SELECT vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings, {_QUERY_VECTOR} ORDER BY {_DISTANCE}, vec_id LIMIT 10",
    "rerank_overlap": rf"""
SELECT doc_id, round(len(list_intersect(list_distinct({words_of("lower(text)")}), ['the', 'of', 'and'])) / 3, 6) AS score FROM documents
ORDER BY len(list_intersect(list_distinct({words_of("lower(text)")}), ['the', 'of', 'and'])) DESC, doc_id LIMIT 10""",
    "prompt_assembly": f"""
SELECT conv_id, array_to_string(['{_PROMPT_HEAD}', '', '--- PRIMARY MATCHES ---', {_section("user", "Chunk", "No primary matches found.")}, '--- RELATED CODE (Dependencies) ---',
  {_section("assistant", "Dep", "No related code found.")}, 'Question: ' || conv_id], chr(10)) AS prompt FROM (SELECT DISTINCT conv_id FROM conversations) c""",
    "retrieve_expand_prompt": f"""
WITH hits AS (SELECT vec_id AS k, row_number() OVER (ORDER BY d, vec_id) AS o FROM (SELECT vec_id, {_DISTANCE} AS d FROM embeddings, {_QUERY_VECTOR} ORDER BY d, vec_id LIMIT 5)),
x AS ({_expanded("hits s")})
SELECT 'Chunk' AS section, CAST(o AS INTEGER) AS number, CAST(k AS VARCHAR) AS node_id, '' AS relationship, coalesce(p_name, '') AS content FROM hits LEFT JOIN part ON p_partkey = k
UNION ALL SELECT 'Dep', CAST(row_number() OVER (ORDER BY place, CAST(k AS VARCHAR)) AS INTEGER), CAST(k AS VARCHAR), relationship, {_CONTENT} FROM x JOIN part ON p_partkey = k WHERE {_CONTENT} IS NOT NULL""",
}
SQL["streamed_answer"] = f"""
SELECT conv_id, CAST(place AS INTEGER) AS place, piece || chr(10) AS piece
FROM (SELECT conv_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS place FROM (SELECT conv_id, string_split(left(answer, length(answer) - 1), chr(10)) AS pieces FROM ({SQL["generate_answer"]})))"""
