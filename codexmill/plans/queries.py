"""Every relational operator as a query over the driver's tables; `plans.oracle` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.config import ChunkConfig, list_presets, preset
from codexmill.functions import text as T
from codexmill.operators import calltree, chunking, graph, retrieval
from codexmill.plans import frames
from codexmill.services import ExtractiveGenerator, HashEmbedder, embed_column, generate_column, stream_answer
from codexmill.sources.parser import RECORDS, parse_batches
from codexmill.sources.project import PARSED_BYTES
from codexmill.sources.scratch import scratch, small_splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUESTION = "the of and"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ------------------------------------------------------------------ files and chunks


@query
def file_filter(spark, sf_dir):
    """Pages as files whose suffix goes round the known ones and two others."""
    suffixes = F.array(*(F.lit(x) for x in (".sol", ".rs", ".move", ".c", ".CPP", ".go", ".py", ".t.sol", ".md", ".C")))
    path = F.concat("url", F.element_at(suffixes, (F.col("page_id") % 10 + 1).cast("int")))
    return frames.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), T.language_of(path).alias("language"), T.is_parsed(path).alias("kept"))


@query
def file_eligible(spark, sf_dir):
    config = ChunkConfig(max_file_size_mb=0.004, include_extensions=(".EN", ".fr", ".de"), exclude_patterns=(".de", "src1"))
    return frames.files(spark, sf_dir).select("doc_id", (chunking.eligible(F.col("path"), F.col("size"), config) & chunking.long_enough(F.col("text"))).alias("eligible"))


def _chunks(spark, sf_dir, config: ChunkConfig, measure: Callable[[Column], Column]) -> DataFrame:
    kept = frames.files(spark, sf_dir).where(chunking.long_enough(F.col("text")))
    return kept.select("doc_id", "lang", F.posexplode(T.bound(T.strip(F.col("text")), lambda t: chunking.pieces(t, config))).alias("chunk_order", "chunk_text")).withColumn("chunk_size", measure(F.col("chunk_text")).cast("int"))


def _word_chunks(spark, sf_dir) -> DataFrame:
    return _chunks(spark, sf_dir, preset("code_project"), T.word_count)


@query
def doc_word_chunks(spark, sf_dir):
    return _word_chunks(spark, sf_dir).drop("lang")


@query
def doc_sentence_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, preset("precise"), F.length).drop("lang")


@query
def doc_char_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, ChunkConfig("char", 800, 200), F.length).drop("lang")


@query
def doc_passage_chunks(spark, sf_dir):
    """Lines stand for passages here, as the documents have no blank lines."""
    doubled = frames.files(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return doubled.select("doc_id", F.posexplode(chunking.pieces(F.col("text"), preset("tech_docs").floored())).alias("chunk_order", "chunk_text"))


@query
def code_split_overlap(spark, sf_dir):
    code = frames.files(spark, sf_dir).select(
        F.col("path").alias("file_path"), F.lit("f").alias("function_name"), F.lit("Function").alias("node_type"), F.col("doc_id").cast("string").alias("node_id"), F.lit("").alias("defined_in"),
        F.array().cast("array<string>").alias("calls"), F.array().cast("array<string>").alias("called_by"), F.col("text").alias("code"), F.lit("").alias("chunk_id"), F.lit("").alias("parent_doc_id"), F.lit(0).alias("chunk_order"),
    )
    return chunking.split_chunks(code, 1000, 100).select("node_id", "parent_doc_id", "chunk_id", "chunk_order", "code")


@query
def long_text_clean(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n \r\n\t\n")), F.lit(". "), F.lit(".\n# "))
    return frames.files(spark, sf_dir).select("doc_id", T.clean_long_text(text).alias("cleaned"), T.has_chapters(F.col("text")).alias("chapters"))


@query
def paragraph_counts(spark, sf_dir):
    """Paragraphs before and after the cleaning, of documents whose lines are parted by several line ends."""
    text = F.replace("text", F.lit("\n"), F.lit("\r\n \r\n\r\n\n"))
    return frames.files(spark, sf_dir).select("doc_id", T.paragraph_count(text).alias("before"), T.paragraph_count(T.clean_long_text(text)).alias("after"))


@query
def doc_page_chunks(spark, sf_dir):
    """Lines stand for pages."""
    pages = frames.files(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return pages.select("doc_id", F.posexplode(chunking.pieces(F.col("text"), ChunkConfig("page", 3, 1))).alias("chunk_order", "chunk_text"))


@query
def doc_token_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, preset("token_based"), F.length).drop("lang")


def _file_chunks(spark, sf_dir) -> DataFrame:
    return chunking.chunk_files(frames.files(spark, sf_dir).select("path", "size", "text"), preset("code_project"))


@query
def chunk_files(spark, sf_dir):
    return _file_chunks(spark, sf_dir).select("chunk_id", "original_file", "chunk_text", "parent_doc_id", "chunk_order", "chunk_size", "metadata.file_name", "metadata.file_size", "metadata.file_extension")


@query
def chunks_of_file(spark, sf_dir):
    """The chunks of document 3's file."""
    path = frames.files(spark, sf_dir).where("doc_id = 3").first()["path"]
    return chunking.of_file(_file_chunks(spark, sf_dir), path).select("chunk_id", "chunk_order", "chunk_text")


@query
def chunk_samples(spark, sf_dir):
    return chunking.samples(_file_chunks(spark, sf_dir), 3, 200)


@query
def presets(spark, sf_dir):
    """The presets, and how many of the documents, as files, each takes."""
    rows = [(n, c.split_by, c.chunk_size, c.chunk_overlap, c.batch_size, float(c.max_file_size_mb), len(c.include_extensions or ()), len(c.exclude_patterns or ()), c.long_text_mode) for n, c in list_presets()]
    table = spark.createDataFrame(rows, "name string, split_by string, chunk_size int, chunk_overlap int, batch_size int, max_mb double, n_included int, n_excluded int, long_text boolean")
    files = frames.files(spark, sf_dir)
    taken = files.agg(*(F.count_if(chunking.eligible(F.col("path"), F.octet_length("text"), c)).alias(n) for n, c in list_presets()))
    return table.join(taken.unpivot([], [n for n, _ in list_presets()], "name", "n_files"), "name")


@query
def path_columns(spark, sf_dir):
    """Parts of the pages' urls as paths; of even pages with backslashes."""
    url, even = F.col("url"), F.col("page_id") % 2 == 0
    path = F.when(even, F.replace(url, F.lit("/"), F.lit("\\"))).otherwise(url)
    empty = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(url)
    return frames.table(spark, sf_dir, "pages").select(
        "page_id", T.unix_path(path).alias("unix"), T.base_name(path).alias("base"), T.stem(path).alias("stem"), T.extension(path).alias("ext"), T.path_suffix(path).alias("suffix"),
        T.sanitized(url).alias("sanitized"), T.or_else(empty, F.lit("none")).alias("given"), T.short_name(url).alias("short"), T.prefix(url).alias("prefix"),
    )


def _as_chunks(spark, sf_dir) -> DataFrame:
    c = _word_chunks(spark, sf_dir)
    return c.select(F.col("doc_id").alias("original_file"), "chunk_size", F.struct(F.col("lang").alias("file_extension")).alias("metadata"))


@query
def chunk_stats(spark, sf_dir):
    return chunking.statistics(_as_chunks(spark, sf_dir))


@query
def chunk_ext_counts(spark, sf_dir):
    return chunking.per_extension(_as_chunks(spark, sf_dir))


@query
def top_chunk_files(spark, sf_dir):
    return chunking.top_files(_as_chunks(spark, sf_dir), 10)


@query
def get_by_id(spark, sf_dir):
    """A row by an id that holds a quote and a backslash."""
    rows = _word_chunks(spark, sf_dir).select(F.concat(F.lit("it's\\"), "doc_id", F.lit(":"), "chunk_order").alias("node_id"), "chunk_text")
    return retrieval.by_id(rows, "it's\\0:0")


# ------------------------------------------------------------------ the graph


def _graph_of_functions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions, and the graph built from them as the engine does it: written, then read by what follows."""
    functions = scratch(frames.functions_with_calls(spark, sf_dir), "functions")
    nodes, edges = graph.build(functions)
    return functions, scratch(nodes, "nodes"), scratch(edges, "edges")


@query
def graph_nodes(spark, sf_dir):
    """The graph that is built from suppliers as functions with their calls."""
    nodes, _ = graph.build(frames.functions_with_calls(spark, sf_dir))
    return nodes.select("node_id", "type", "name", "path", "file_path", "line_number", "content")


@query
def graph_edges(spark, sf_dir):
    _, edges = graph.build(frames.functions_with_calls(spark, sf_dir))
    return edges.select("src", "dst", "relation")


@query
def graph_counts(spark, sf_dir):
    _, nodes, edges = _graph_of_functions(spark, sf_dir)
    return graph.counts(nodes, edges)


@query
def call_graph_edges(spark, sf_dir):
    """The calls by caller's language; a region's files get the suffix of a language."""
    suffix = F.when(F.startswith("file_path", F.lit("A")), ".rs").when(F.startswith("file_path", F.lit("E")), ".sol").otherwise(".py")
    return graph.call_graph(frames.functions_with_calls(spark, sf_dir).withColumn("file_path", F.concat("file_path", suffix)))


def _known(spark, sf_dir) -> DataFrame:
    return graph.with_ids(frames.functions(spark, sf_dir))


@query
def call_resolution(spark, sf_dir):
    f = _known(spark, sf_dir)
    callers = f.select(F.col("seq").alias("src"), F.col("path").alias("caller_file"), F.col("class").alias("caller_class"))
    return graph.resolve_calls(f, frames.calls(spark, sf_dir).join(callers, "src").select("call_id", "caller_file", "caller_class", "call"))


@query
def node_match(spark, sf_dir):
    """Records whose paths and names differ from the nodes' in ways that each strategy mends."""
    f = _known(spark, sf_dir)
    nodes = f.select("node_id", F.concat(F.lit("root/src/"), F.col("path")).alias("file_path"), "name", "line_number", "seq")
    nodes = nodes.withColumn("node_id", F.when(F.col("seq") % 6 == 5, F.concat(F.lit("x:"), F.col("seq"))).otherwise(graph.function_id(F.col("file_path"), F.when(F.col("seq") % 6 == 1, T.short_name(F.col("name"))).otherwise(F.col("name")), F.col("line_number"))))
    path = F.when(F.col("seq") % 6 == 2, F.concat(F.lit("home\\me\\root\\src\\"), F.col("path"))).when(F.col("seq") % 6 == 5, F.concat(F.lit("other/src/"), F.col("path"))).when(F.col("seq") % 6 == 4, F.concat(F.lit("elsewhere/"), F.col("path"))).otherwise(F.concat(F.lit("root/src/"), F.col("path")))
    records = f.select(F.col("seq").alias("func_id"), path.alias("path"), "name", F.col("line_number").alias("line"))
    return graph.match_nodes(records, nodes)


@query
def parent_scope(spark, sf_dir):
    _, nodes, edges = _graph_of_functions(spark, sf_dir)
    scopes = graph.parent_scopes(nodes, edges)
    return scopes.join(nodes.where("type = 'Function'").select("node_id"), "node_id", "left_semi")


@query
def callees(spark, sf_dir):
    _, nodes, edges = _graph_of_functions(spark, sf_dir)
    return graph.callees(nodes, edges).select("node_id", F.array_join("names", "|").alias("names"))


@query
def callers(spark, sf_dir):
    _, nodes, edges = _graph_of_functions(spark, sf_dir)
    return graph.callers(nodes, edges).select("node_id", F.array_join("names", "|").alias("names"))


def _enriched(spark, sf_dir) -> DataFrame:
    return graph.to_text(graph.enrich(*_graph_of_functions(spark, sf_dir)))


@query
def enriched_chunks(spark, sf_dir):
    return _enriched(spark, sf_dir).select("node_id", "defined_in", F.array_join("calls", "|").alias("calls"), F.array_join("called_by", "|").alias("called_by"), "text")


@query
def text_roundtrip(spark, sf_dir):
    parsed = graph.from_text(_enriched(spark, sf_dir).select("text"))
    return parsed.select("file_path", "function_name", "node_type", "node_id", "chunk_id", "parent_doc_id", "chunk_order", "defined_in", F.array_join("calls", "|").alias("calls"), F.array_join("called_by", "|").alias("called_by"), "code")


def _seeds(spark) -> DataFrame:
    return spark.createDataFrame([("0", 0), ("7", 1), ("42", 2)], "node_id string, seed_seq int")


def _stored_calls(spark, sf_dir) -> DataFrame:
    """The calls of parts as a table, which each level of an expansion reads."""
    return scratch(frames.part_calls(spark, sf_dir), "calls")


@query
def neighbors_1hop(spark, sf_dir):
    return graph.expand(frames.part_calls(spark, sf_dir), _seeds(spark)).select("node_id", "relationship")


def _part_contents(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contents of parts: a chunk for keys of 0 mod 3, a function for 1, the node's own for 2 unless the key is 2 mod 9."""
    p = frames.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("node_id"), F.col("p_name").alias("name"))
    chunks = p.where("k % 3 = 0").select("node_id", F.lit(0).alias("chunk_order"), F.concat(F.lit("chunk "), "name").alias("text"))
    functions = p.where("k % 3 = 1").select("node_id", F.concat(F.lit("function "), "name").alias("content"), F.col("k").alias("seq"))
    nodes = p.select("node_id", F.when(F.col("k") % 9 == 2, "").otherwise(F.concat(F.lit("node "), "name")).alias("content"))
    return chunks, functions, nodes


def _part_content(spark, sf_dir, found: DataFrame) -> DataFrame:
    return graph.with_content(found, *_part_contents(spark, sf_dir))


@query
def expand_content(spark, sf_dir):
    found = graph.expand(frames.part_calls(spark, sf_dir), _seeds(spark))
    return _part_content(spark, sf_dir, found).select("node_id", "relationship", "content")


@query
def expand_external(spark, sf_dir):
    """One step from the first 20 suppliers as functions; what they call outside of the graph stays out."""
    functions, _, edges = _graph_of_functions(spark, sf_dir)
    seeds = graph.with_ids(functions).where("seq < 20").select("node_id", F.col("seq").alias("seed_seq"))
    return graph.expand(edges, seeds).select("node_id", "relationship")


@query
def expand_levels(spark, sf_dir):
    """Two levels with content; parts without content are neither returned nor passed through."""
    found = graph.expand_levels(_stored_calls(spark, sf_dir), _seeds(spark), 2, *_part_contents(spark, sf_dir))
    return found.select("node_id", "relationship", "content", "depth")


@query
def bfs_depth_2(spark, sf_dir):
    return graph.expand_to_depth(_stored_calls(spark, sf_dir), _seeds(spark), 2)


@query
def bfs_depth_3(spark, sf_dir):
    return graph.expand_to_depth(_stored_calls(spark, sf_dir), _seeds(spark), 3)


@query
def degrees(spark, sf_dir):
    return graph.degrees(frames.part_calls(spark, sf_dir))


# ------------------------------------------------------------------ call trees and audits


def _pairs(spark, sf_dir) -> DataFrame:
    return frames.part_edges(spark, sf_dir).select(F.col("src").cast("string").alias("caller"), F.col("dst").cast("string").alias("callee"))


def _parts(spark, sf_dir) -> DataFrame:
    return frames.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), "p_type")


@query
def call_tree_stats(spark, sf_dir):
    """Customers, parts and suppliers as functions: a customer calls the parts of its orders, a part its suppliers."""
    return calltree.statistics(calltree.counts(frames.traders(spark, sf_dir), frames.trades(spark, sf_dir)))


@query
def call_tree_counts(spark, sf_dir):
    return calltree.counts(frames.traders(spark, sf_dir), frames.trades(spark, sf_dir))


@query
def entry_points(spark, sf_dir):
    return calltree.entry_points(frames.traders(spark, sf_dir), frames.trades(spark, sf_dir)).select("name")


@query
def leaf_functions(spark, sf_dir):
    return calltree.leaves(frames.traders(spark, sf_dir), frames.trades(spark, sf_dir)).select("name")


@query
def call_text_search(spark, sf_dir):
    """Each document is a function of its own, known by its doc_id and named by its first word, however short."""
    d = frames.table(spark, sf_dir, "documents")
    f = d.select("doc_id", F.regexp_extract("text", r"\S+", 0).alias("name"), F.replace(F.col("text"), F.lit(". "), F.lit("(. ")).alias("content"))
    return calltree.called_by_text(f, "doc_id")


@query
def call_list_lookup(spark, sf_dir):
    """Suppliers under their short names, with the calls of the call table."""
    f = frames.functions_with_calls(spark, sf_dir)
    return calltree.called_by_list(f.select(T.short_name(F.col("name")).alias("name"), "calls"))


@query
def call_relationships(spark, sf_dir):
    """Suppliers under their short names, whose contents hold their calls: pairs by list and by text."""
    f = frames.functions_with_calls(spark, sf_dir)
    spelled = F.array_join(F.transform("calls", lambda c: F.concat(c, F.lit(" (x)"))), "; ")
    return calltree.relationships(f.select(T.short_name(F.col("name")).alias("name"), "calls", spelled.alias("content")))


@query
def call_tree_paths(spark, sf_dir):
    """All simple paths from every customer, part and supplier, however long."""
    paths = calltree.call_trees(frames.traders(spark, sf_dir), frames.trades(spark, sf_dir))
    return paths.select("root", "depth", F.array_join("path", ">").alias("path"))


@query
def call_tree_paths_up(spark, sf_dir):
    """The same against the calls, from every customer, part and supplier."""
    paths = calltree.call_trees(frames.traders(spark, sf_dir), frames.trades(spark, sf_dir), direction="upstream")
    return paths.select("root", "depth", F.array_join("path", ">").alias("path"))


@query
def call_cycles(spark, sf_dir):
    """Suppliers under their short names that call one another in a circle, by the calls of the call table."""
    f = frames.functions_with_calls(spark, sf_dir)
    return calltree.cycles(calltree.called_by_list(f.select(T.short_name(F.col("name")).alias("name"), "calls")))


@query
def dependency_graph(spark, sf_dir):
    return calltree.dependency_graph("p0", frames.traders(spark, sf_dir), frames.trades(spark, sf_dir), 2)


@query
def function_names(spark, sf_dir):
    return calltree.names(frames.functions(spark, sf_dir))


@query
def functions_of_contract(spark, sf_dir):
    """Those of the contract whose name comes first."""
    f = frames.functions(spark, sf_dir)
    return calltree.of_contract(f, f.agg(F.min(F.nullif("contract_name", F.lit("")))).first()[0]).select("seq", "name")


@query
def function_by_name(spark, sf_dir):
    """The first of the functions with the name that supplier 2 has."""
    f = frames.functions(spark, sf_dir)
    return calltree.by_name(f, f.where("seq = 2").first()["name"]).select("seq", "name")


@query
def call_graph_stats(spark, sf_dir):
    typed = _parts(spark, sf_dir).select(F.col("name").alias("caller"), F.col("p_type").alias("language"))
    edges = _pairs(spark, sf_dir).join(typed, "caller").withColumn("call_type", F.when(F.length("caller") == F.length("callee"), "same").otherwise("other"))
    return calltree.graph_statistics(edges)


@query
def call_graph_overview(spark, sf_dir):
    """The lines of the printed overview of the first 50 calls."""
    text = calltree.print_call_graph(scratch(call_graph_edges(spark, sf_dir), "call-graph"), 50)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


@query
def rendered_tree(spark, sf_dir):
    """The printed call tree of customer 1."""
    rows = calltree.call_trees(frames.traders(spark, sf_dir).where("name = 'c1'"), frames.trades(spark, sf_dir)).collect()
    return spark.createDataFrame(list(enumerate(calltree.render(calltree.nested(rows, "c1")).split("\n"))), "n int, line string")


@query
def functions_csv(spark, sf_dir):
    return calltree.functions_csv(frames.functions_with_calls(spark, sf_dir))


@query
def kept_functions(spark, sf_dir):
    kinds = F.element_at(F.array(F.lit("constructor"), F.lit("receive"), F.lit("public"), F.lit("fallback")), (F.col("seq") % 4 + 1).cast("int"))
    path = F.concat("file_path", F.when(F.col("seq") % 3 == 0, ".sol").when(F.col("seq") % 3 == 1, ".rs").otherwise(".go"))
    return calltree.kept_functions(_known(spark, sf_dir).withColumn("visibility", kinds).withColumn("file_path", path)).select("seq", "visibility", "file_path")


# ------------------------------------------------------------------ retrieval


def _vector(spark, sf_dir, vec_id: int) -> list[float]:
    row = frames.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


def _nearest(spark, sf_dir, k: int = 10) -> DataFrame:
    return retrieval.nearest(frames.table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), k, "vec_id", "embedding")


@query
def knn_l2(spark, sf_dir):
    return _nearest(spark, sf_dir).select("vec_id", F.round("distance", 6).alias("distance"))


@query
def rerank_overlap(spark, sf_dir):
    best = retrieval.rerank(frames.table(spark, sf_dir, "documents"), QUESTION, 10, "text", "doc_id")
    return best.select("doc_id", F.round("relevance_score", 6).alias("score"))


@query
def prompt_assembly(spark, sf_dir):
    turns = frames.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    of = lambda role: F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: F.coalesce(x["text"], F.lit("")))
    return turns.select("conv_id", retrieval.assembled(of("user"), of("assistant"), F.col("conv_id").cast("string")).alias("prompt"))


@query
def retrieve_expand_prompt(spark, sf_dir):
    """The flagship: nearest vectors are seeds, their parts' neighbours the related code, both numbered."""
    hits = _nearest(spark, sf_dir, 5).select("vec_id", "distance")
    place = F.row_number().over(_by("distance", "vec_id"))
    seeds = hits.select(F.col("vec_id").cast("string").alias("node_id"), place.alias("seed_seq"))
    names = frames.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("node_id"), "p_name")
    primary = seeds.join(names, "node_id", "left").select(F.lit("Chunk").alias("section"), F.col("seed_seq").cast("int").alias("number"), "node_id", F.lit("").alias("relationship"), F.coalesce("p_name", F.lit("")).alias("content"))
    found = _part_content(spark, sf_dir, graph.expand(frames.part_calls(spark, sf_dir), seeds))
    secondary = retrieval.numbered(found, "number", "place", "node_id").select(F.lit("Dep").alias("section"), F.col("number").cast("int").alias("number"), "node_id", "relationship", "content")
    return primary.unionByName(secondary)


def _by(*columns):
    # the rows that are numbered are a handful of seeds
    from pyspark.sql import Window

    return Window.orderBy(*columns)


# ------------------------------------------------------------------ services


@query
def parse_functions(spark, sf_dir):
    """Documents, whole, as strings in Python files."""
    d = frames.files(spark, sf_dir).select(F.concat("path", F.lit(".py")).alias("path"), F.concat(F.lit("class K:\n    def f(self, x):\n        return self.g(len("), F.to_json(F.array("text")), F.lit("))\n\n    def g(self, n):\n        return n\n")).alias("text"))
    found = d.mapInArrow(parse_batches, RECORDS).select("file_path", "name", "start_line", "end_line", "contract_name", "visibility", F.array_join("calls", "|").alias("calls"))
    with small_splits(spark, PARSED_BYTES):  # written here, as it takes batches as the session has them when it runs
        return scratch(found, "parsed")


@query
def embed_udf(spark, sf_dir):
    """Of every document's vector the places that aren't zero and the sum of its squares."""
    embedded = embed_column(frames.table(spark, sf_dir, "documents").select("doc_id", "text"), HashEmbedder(64))
    held = F.filter("vector", lambda x: x != 0)
    return embedded.select("doc_id", F.size("vector").alias("dimension"), F.size(held).alias("n_held"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


@query
def streamed_answer(spark, sf_dir):
    """The pieces of each prompt's answer, as they are streamed."""

    def run(parts):
        for part in parts:
            rows = [(c, i, x) for c, p in zip(part["conv_id"], part["prompt"], strict=True) for i, x in enumerate(stream_answer(ExtractiveGenerator(), p), 1)]
            yield pd.DataFrame(rows, columns=["conv_id", "place", "piece"])

    return prompt_assembly(spark, sf_dir).select("conv_id", "prompt").mapInPandas(run, "conv_id long, place int, piece string")


@query
def generate_answer(spark, sf_dir):
    prompts = prompt_assembly(spark, sf_dir)
    return prompts.select("conv_id", generate_column(F.col("prompt"), ExtractiveGenerator()).alias("answer"))
