"""Queries over what is read, parsed and stored: each writes to the shared folder what it reads back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import calltree, graph, retrieval
from codexmill.plans import frames
from codexmill.plans.index import Engine, report
from codexmill.plans.oracle import CODE, words_of
from codexmill.plans.oracle import SQL as CORE_SQL
from codexmill.services import HashEmbedder, embed_column
from codexmill.sources import store
from codexmill.sources.scratch import scratch, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    functions = scratch(frames.functions_with_calls(spark, sf_dir), "functions")
    return functions, *graph.build(functions)


@query
def file_texts(spark, sf_dir):
    """Documents as files in three encodings, read back; what isn't valid is left out."""
    d = frames.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spoilt = d.select("doc_id", "text", F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("ff"))).alias("utf8"), F.encode("text", "utf-16").alias("utf16"))
    return spoilt.select("doc_id", T.decode_lenient(F.col("utf8")).alias("a"), T.decode_lenient(F.col("utf16"), "utf-16").alias("b"), F.length(T.decode_lenient(F.encode("text", "utf-8"), "latin1")).alias("n"))


@query
def node_link_roundtrip(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    path = scratch_path(spark, "node-link")
    store.write_node_link(nodes, edges, path)
    back, links = store.read_node_link(spark, path)
    return back.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("type").alias("b"), "name").unionByName(links.select(F.lit("link").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("name")))


@query
def chunks_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "chunks-json")
    store.write_json(graph.enrich(*_graph(spark, sf_dir)), path)
    back = store.read_json(spark, path, "chunks")
    return back.select("file_path", "function_name", "node_id", "defined_in", F.array_join("calls", "|").alias("calls"), F.array_join("called_by", "|").alias("called_by"), "code", "chunk_id", "chunk_order")


@query
def node_link_document(spark, sf_dir):
    """The same by one JSON document, which the tasks write and the commit joins."""
    _, nodes, edges = _graph(spark, sf_dir)
    path = scratch_path(spark, "node-link-document")
    store.write_node_link_document(scratch(nodes, "nodes"), scratch(edges, "edges"), path)
    back, links = store.read_node_link(spark, path)
    return back.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("type").alias("b"), "name").unionByName(links.select(F.lit("link").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("name")))


@query
def functions_json_list(spark, sf_dir):
    """Functions as one JSON list, written by the tasks of several partitions."""
    path = scratch_path(spark, "functions-list")
    store.write_json_list(frames.functions_with_calls(spark, sf_dir).repartition(5, "seq"), path)
    return store.read_json(spark, path, "functions").select("seq", "name", "content", "file_path", "line_number", F.array_join("modifiers", "|").alias("modifiers"), F.size("calls").alias("n_calls"), "signature")


@query
def functions_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "functions-json")
    store.write_json(frames.functions_with_calls(spark, sf_dir), path)
    return store.read_json(spark, path, "functions").select("seq", "name", "content", "file_path", "line_number", F.array_join("modifiers", "|").alias("modifiers"), F.size("calls").alias("n_calls"), "signature")


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "functions-csv")
    store.write_csv(calltree.functions_csv(frames.functions_with_calls(spark, sf_dir)), path)
    return spark.read.csv(path, header=True, schema="name string, contract string, visibility string, line_number int, file_path string, modifiers string, calls_count int")


@query
def vectors_roundtrip(spark, sf_dir):
    """Vectors of all documents, stored and loaded; then nothing is stored, which changes nothing."""
    kept = store.IndexStore(spark, scratch_path(spark, "index"))
    d = frames.table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("string").alias("node_id"), F.col("source").alias("filename"))
    kept.save_vectors(embed_column(d, HashEmbedder(16)))
    kept.save_vectors(kept.load("vectors").where("false"))
    return kept.load("vectors").select("node_id", "filename", F.length("text").alias("n_chars"), F.size("vector").alias("dimension"))


@query
def index_counts(spark, sf_dir):
    """An index of suppliers as functions, before and after it is cleared."""
    engine = Engine(spark, scratch_path(spark, "index"), embedder=HashEmbedder(16))
    result = engine.index_functions(frames.functions_with_calls(spark, sf_dir))
    indexed, cleared = engine.is_indexed(), engine.clear()
    row = (result.functions, result.nodes, result.edges, result.chunks, result.embeddings, indexed, len(cleared), engine.is_indexed(), engine.functions().count(), engine.vectors().count())
    return spark.createDataFrame([row], "functions long, nodes long, edges long, chunks long, embeddings long, indexed boolean, cleared int, indexed_after boolean, functions_after long, vectors_after long")


@query
def index_expand(spark, sf_dir):
    """Two levels around the first two functions of an index; one id is a split chunk's."""
    engine = Engine(spark, scratch_path(spark, "index"), embedder=HashEmbedder(16))
    functions = frames.functions_with_calls(spark, sf_dir)
    engine.index_functions(functions)
    ids = [r.node_id for r in graph.with_ids(functions).where("seq < 2").orderBy("seq").select("node_id").collect()]
    return engine.expand([ids[0], f"{ids[1]}:0123abcd_chunk_1"], 2).select("node_id", "relationship", F.element_at(F.split("content", r"\[CODE\]\n"), -1).alias("code"))


@query
def index_query(spark, sf_dir):
    """What must hold of a question's answer: the stages' sizes, and how their results hang together."""
    engine = Engine(spark, scratch_path(spark, "index"), embedder=HashEmbedder(64))
    engine.index_functions(frames.functions_with_calls(spark, sf_dir))
    question = "which body of m1 calls FRANCE"
    found = engine.query(question, rerank_top_k=3, search_limit=10)
    hits, best = [h["node_id"] for h in found.retrieved], [b["node_id"] for b in found.reranked]
    distances, related = [h["distance"] for h in found.retrieved], {r["node_id"] for r in found.expanded}
    shown = report(found)
    row = (
        found.success, len(hits), len(best), set(best) <= set(hits), distances == sorted(distances), not related & set(best), found.prompt.endswith(f"Question: {question}"),
        all(b["text"] in found.prompt for b in found.reranked), all(r["content"] in found.prompt for r in found.expanded), found.answer.startswith(f"Question: {question}"), all(b in shown for b in best),
    )
    names = "success n_hits n_best best_are_hits nearest_first related_are_new prompt_asks prompt_has_best prompt_has_related answered reported".split()
    return spark.createDataFrame([row], ", ".join(f"{n} {'int' if n.startswith('n_') else 'boolean'}" for n in names))


class LetterEmbedder:
    """How often each of some letters stands in a text: whole numbers, so that SQL gives the same distances."""

    def __init__(self, letters: str = "aeimnrst"):
        self.letters, self.dimension = letters, len(letters)

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        return [[float(x.count(letter)) for letter in self.letters] for x in texts]


_QUESTION = "which function of this contract calls m1 and is called by m3 in another file and where is it defined"


@query
def index_search(spark, sf_dir):
    """The ten chunks of an index that are nearest to a question, with their texts."""
    engine = Engine(spark, scratch_path(spark, "index"), embedder=LetterEmbedder())
    engine.index_functions(frames.functions_with_calls(spark, sf_dir))
    hits = engine.search(_QUESTION, 10)
    return retrieval.numbered(hits, "rank", "distance", "node_id").select(F.col("rank").cast("int").alias("rank"), "node_id", F.round("distance", 6).alias("distance"), "text")


@query
def index_context(spark, sf_dir):
    """What of an index goes into the answer of a question: the best three of the ten nearest chunks, and what they call and are called by."""
    engine = Engine(spark, scratch_path(spark, "index"), embedder=LetterEmbedder())
    engine.index_functions(frames.functions_with_calls(spark, sf_dir))
    found = engine.query(_QUESTION, rerank_top_k=3, search_limit=10)
    rows = [("match", i, x["node_id"], "", x["text"]) for i, x in enumerate(found.reranked, 1)] + [("related", 0, x["node_id"], x["relationship"], x["content"].split("[CODE]\n")[-1]) for x in found.expanded]
    return spark.createDataFrame(rows, "section string, number int, node_id string, relationship string, content string")


@query
def builder_info(spark, sf_dir):
    """What the call-tree builder offers, and for how many functions and calls here."""
    info, functions = calltree.builder_info(), frames.functions_with_calls(spark, sf_dir)
    offers = spark.createDataFrame([(info["type"], k, v) for k, v in info["features"].items()], "type string, feature string, offered boolean")
    return offers.join(F.broadcast(functions.agg(F.count("*").alias("n_functions"), F.sum(F.size("calls")).alias("n_calls"))))


_LEVELS = """
, named AS (SELECT edge.src, edge.dst, edge.o FROM edge WHERE dst NOT LIKE 'External:%'),
s AS (SELECT id AS k, seq AS o FROM fn WHERE seq < 2),
x1 AS (SELECT k, arg_min(rel, place) AS rel, min(place) AS place FROM (SELECT dst AS k, 'CALLS' AS rel, [s.o, 0, e.o] AS place FROM named e JOIN s ON e.src = s.k UNION ALL SELECT src, 'CALLED_BY', [s.o, 1, e.o] FROM named e JOIN s ON e.dst = s.k) WHERE k NOT IN (SELECT k FROM s) GROUP BY k),
x2 AS (SELECT k, arg_min(rel, place) AS rel FROM (SELECT e.dst AS k, 'CALLS' AS rel, list_concat(x1.place, [0, e.o]) AS place FROM named e JOIN x1 ON e.src = x1.k UNION ALL SELECT e.src, 'CALLED_BY', list_concat(x1.place, [1, e.o]) FROM named e JOIN x1 ON e.dst = x1.k)
  WHERE k NOT IN (SELECT k FROM s) AND k NOT IN (SELECT k FROM x1) GROUP BY k)
SELECT x.k AS node_id, rel AS relationship, 'body of ' || short AS code FROM (SELECT k, rel FROM x1 UNION ALL SELECT k, rel FROM x2) x JOIN fn ON fn.id = x.k"""

SQL: dict[str, str] = {
    "file_texts": "SELECT doc_id, coalesce(text, '') AS a, coalesce(text, '') AS b, CAST(strlen(coalesce(text, '')) AS INTEGER) AS n FROM documents",
    "node_link_roundtrip": CODE + """SELECT 'node' AS kind, node_id AS a, type AS b, name FROM node UNION ALL SELECT 'link', src, dst, relation FROM link""",
    "chunks_json_roundtrip": CODE + "SELECT path AS file_path, name AS function_name, node_id, defined_in, calls, called_by, code, '' AS chunk_id, CAST(0 AS INTEGER) AS chunk_order FROM en",
    "functions_json_roundtrip": CODE + "SELECT seq, name, 'body of ' || short AS content, path AS file_path, CAST(seq AS INTEGER) AS line_number, 'view|virtual' AS modifiers, CAST((SELECT count(*) FROM calls WHERE calls.src = fn.seq) AS INTEGER) AS n_calls, CAST(NULL AS VARCHAR) AS signature FROM fn",
    "vectors_roundtrip": "SELECT CAST(doc_id AS VARCHAR) AS node_id, source AS filename, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars, CAST(16 AS INTEGER) AS dimension FROM documents",
    "csv_roundtrip": CODE
    + """SELECT name, class AS contract, CASE WHEN seq % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, CAST(seq AS INTEGER) AS line_number, path AS file_path, 'view, virtual' AS modifiers,
  CAST((SELECT count(*) FROM calls WHERE calls.src = fn.seq) AS INTEGER) AS calls_count FROM fn""",
    "index_counts": CODE
    + """SELECT (SELECT count(*) FROM fn) AS functions, (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM link) AS edges, (SELECT count(*) FROM fn) AS chunks, (SELECT count(*) FROM fn) AS embeddings, true AS indexed,
  CAST(4 AS INTEGER) AS cleared, false AS indexed_after, CAST(0 AS BIGINT) AS functions_after, (SELECT count(*) FROM fn) AS vectors_after""",
    "index_expand": CODE + _LEVELS,
    "index_query": "SELECT true AS success, CAST(10 AS INTEGER) AS n_hits, CAST(3 AS INTEGER) AS n_best, true AS best_are_hits, true AS nearest_first, true AS related_are_new, true AS prompt_asks, true AS prompt_has_best, true AS prompt_has_related, true AS answered, true AS reported",
    "builder_info": CODE + "SELECT v.*, (SELECT count(*) FROM fn) AS n_functions, (SELECT count(*) FROM calls) AS n_calls FROM (VALUES ('relational', 'basic_call_trees', true), ('relational', 'dependency_graph', true), ('relational', 'visualization', false), ('relational', 'mermaid_export', false)) v(type, feature, offered)",
}

_LETTERS = "[" + ", ".join(f"length(x) - length(replace(x, '{letter}', ''))" for letter in LetterEmbedder().letters) + "]"
SQL["index_search"] = f"""
WITH t AS ({CORE_SQL["enriched_chunks"]}),
v AS (SELECT node_id, text, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(a, b)]) AS d FROM (SELECT node_id, x AS text, {_LETTERS} AS a FROM (SELECT node_id, text AS x FROM t)), (SELECT {_LETTERS} AS b FROM (SELECT '{_QUESTION}' AS x)))
SELECT CAST(row_number() OVER (ORDER BY d, node_id) AS INTEGER) AS rank, node_id, round(CAST(d AS DOUBLE), 6) AS distance, text FROM v ORDER BY d, node_id LIMIT 10"""
_NEAR, _FAR = _LEVELS.split("s AS (")[0], _LEVELS[_LEVELS.index("x1 AS") : _LEVELS.index("x2 AS")].rstrip().rstrip(",")
SQL["index_context"] = CODE + f"""{_NEAR}
t AS ({CORE_SQL["enriched_chunks"][len(CODE) :]}),
v AS (SELECT node_id, text, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(a, b)]) AS d FROM (SELECT node_id, x AS text, {_LETTERS} AS a FROM (SELECT node_id, text AS x FROM t)), (SELECT {_LETTERS} AS b FROM (SELECT '{_QUESTION}' AS x))),
hits AS (SELECT * FROM v ORDER BY d, node_id LIMIT 10),
scored AS (SELECT *, len(list_intersect(list_distinct({words_of("lower(text)")}), list_distinct({words_of(f"lower('{_QUESTION}')")}))) AS score FROM hits),
best AS (SELECT node_id AS k, text, row_number() OVER (ORDER BY score DESC, node_id) AS o FROM scored ORDER BY score DESC, node_id LIMIT 3),
s AS (SELECT k, o FROM best),
{_FAR}
SELECT 'match' AS section, CAST(o AS INTEGER) AS number, k AS node_id, '' AS relationship, text AS content FROM best
UNION ALL SELECT 'related', CAST(0 AS INTEGER), k, rel, 'body of ' || short FROM x1 JOIN fn ON fn.id = x1.k"""
SQL["node_link_document"], SQL["functions_json_list"] = SQL["node_link_roundtrip"], SQL["functions_json_roundtrip"]
