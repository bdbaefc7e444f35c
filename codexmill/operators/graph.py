"""The typed graph of files, classes, functions and external names, built from function records by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.sources.scratch import scratch


def file_id(path: Column) -> Column:
    return F.concat_ws(":", F.lit("File"), path)


def class_id(path: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("Contract"), path, name)


def function_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", F.lit("Function"), path, name, line.cast("string"))


def external_id(call: Column) -> Column:
    return F.concat(F.lit("External:"), call)


def with_ids(functions: DataFrame) -> DataFrame:
    """Function records with path (forward slashes), node_id, short and class (null if empty).

    An empty file_path gives way to absolute_file_path, and a line_number of zero to start_line.
    """
    given = F.col("file_path")
    path = T.unix_path(T.or_else(given, F.coalesce("absolute_file_path", given)) if "absolute_file_path" in functions.columns else given)
    line = F.coalesce(F.nullif("line_number", F.lit(0)), "start_line", F.lit(0))
    return functions.withColumns({"path": path, "node_id": function_id(path, F.col("name"), line), "short": T.short_name(F.col("name")), "class": F.nullif("contract_name", F.lit(""))})


def resolve_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """call_id, target_id, strategy for calls (call_id, caller_file, caller_class, call).

    functions: seq, name, node_id, path, class, short. The first strategy that finds a function decides:
    1 the full name; for `self.` calls of a class 2a its method, 2b that of the first class of the same last
    name; for calls of two parts 3a the class's method, 3b the first class of that last name; 4 the method of
    the caller's class; 5 the function of the caller's file; 6 the only function of that short name. Where
    several define the same thing, the last by seq counts. What none finds is External, strategy null.
    """
    latest = F.max_by("node_id", "seq").alias("id")
    by_name = functions.groupBy("name").agg(latest)
    classed = functions.where("class IS NOT NULL")
    entries = classed.select("class", "short", "node_id", "seq", F.lit(0).alias("place")).unionByName(
        classed.where(F.contains("name", F.lit("."))).select(T.prefix(F.col("name")).alias("class"), "short", "node_id", "seq", F.lit(1).alias("place"))
    )
    order = F.struct("seq", "place")
    by_class = entries.groupBy("class", "short").agg(F.max_by("node_id", order).alias("id"), F.min(order).alias("inserted"))
    by_last = by_class.groupBy(T.short_name(F.col("class")).alias("tail"), "short").agg(F.min_by("id", "inserted").alias("id"))
    by_file = functions.groupBy("path", "short").agg(latest)
    alone = functions.groupBy("short").agg(F.count("*").alias("n"), F.max("node_id").alias("id")).where("n = 1")

    parts = F.split("call", r"\.")
    is_self = F.startswith("call", F.lit("self.")) & F.col("caller_class").isNotNull()
    two = F.size(parts) == 2
    keyed = calls.withColumns(
        {
            "s_class": F.when(is_self, F.col("caller_class")), "s_tail": F.when(is_self, T.short_name(F.col("caller_class"))), "rest": F.when(is_self, F.substring("call", 6, 1 << 30)),
            "p0": F.when(two, parts[0]), "p1": F.when(two, parts[1]), "c_short": T.short_name(F.col("call")),
        }
    )

    def look(rows: DataFrame, table: DataFrame, out: str, /, **on: str) -> DataFrame:
        side = table.select(*(F.col(k).alias(f"k_{k}") for k in on), F.col("id").alias(out))
        cond = [F.col(v) == F.col(f"k_{k}") for k, v in on.items()]
        return rows.join(side, cond, "left").drop(*(f"k_{k}" for k in on))

    out = look(keyed, by_name, "t1", name="call")
    out = look(out, by_class, "t2a", **{"class": "s_class", "short": "rest"})
    out = look(out, by_last, "t2b", tail="s_tail", short="rest")
    out = look(out, by_class, "t3a", **{"class": "p0", "short": "p1"})
    out = look(out, by_last, "t3b", tail="p0", short="p1")
    out = look(out, by_class, "t4", **{"class": "caller_class", "short": "c_short"})
    out = look(out, by_file, "t5", path="caller_file", short="c_short")
    out = look(out, alone, "t6", short="c_short")
    steps = ("1", "2a", "2b", "3a", "3b", "4", "5", "6")
    which = F.coalesce(*(F.when(F.col(f"t{s}").isNotNull(), F.lit(s)) for s in steps))
    return out.select("call_id", F.coalesce(*(F.col(f"t{s}") for s in steps), external_id(F.col("call"))).alias("target_id"), which.alias("strategy"))


def definitions(functions: DataFrame) -> DataFrame:
    """DEFINES edges file->class, class->function and file->function, each once with its first seq."""
    f = functions
    found = (
        f.where("class IS NOT NULL").select(file_id(F.col("path")).alias("src"), class_id(F.col("path"), F.col("class")).alias("dst"), "seq")
        .unionByName(f.where("class IS NOT NULL").select(class_id(F.col("path"), F.col("class")).alias("src"), F.col("node_id").alias("dst"), "seq"))
        .unionByName(f.where("class IS NULL").select(file_id(F.col("path")).alias("src"), F.col("node_id").alias("dst"), "seq"))
    )
    return found.groupBy("src", "dst").agg(F.min("seq").alias("seq")).select("src", "dst", F.lit("DEFINES").alias("relation"), "seq", F.lit(0).alias("pos"))


def call_edges(functions: DataFrame) -> DataFrame:
    """CALLS edges of functions with a column `calls`, resolved; no self-loops, repeated calls once.

    seq is the caller's and pos the call's place in it, of the first call.
    """
    sites = functions.select(F.col("node_id").alias("src"), F.col("path").alias("caller_file"), F.col("class").alias("caller_class"), "seq", F.posexplode("calls").alias("pos", "call")).withColumn("call_id", F.struct("src", "pos"))
    solved = resolve_calls(functions.select("seq", "name", "node_id", "path", "class", "short"), sites.select("call_id", "caller_file", "caller_class", "call"))
    edges = solved.join(sites.select("call_id", "seq"), "call_id").select(F.col("call_id.src").alias("src"), F.col("target_id").alias("dst"), F.struct("seq", "call_id.pos").alias("place"))
    first = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("place").alias("place"))
    return first.select("src", "dst", F.lit("CALLS").alias("relation"), "place.seq", "place.pos")


def call_graph(functions: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """caller, callee, call_type, language of all resolved calls: names, `external` or `internal`, the caller's file's language."""
    f = with_ids(functions)
    calls = (call_edges(f) if edges is None else edges).where("relation = 'CALLS'")
    latest = f.groupBy("node_id").agg(F.max_by("name", "seq").alias("name"), F.max("path").alias("path"))
    callers = latest.select(F.col("node_id").alias("src"), F.col("name").alias("caller"), F.coalesce(T.language_of(F.col("path")), F.lit("")).alias("language"))
    callees = latest.select(F.col("node_id").alias("dst"), F.col("name").alias("callee"))
    named = calls.join(callers, "src").join(callees, "dst", "left")
    return named.select("caller", F.coalesce("callee", F.regexp_replace("dst", "^External:", "")).alias("callee"), F.when(F.startswith("dst", F.lit("External:")), "external").otherwise("internal").alias("call_type"), "language")


def build(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of function records; calls are resolved once, and written, as both hold them."""
    f = with_ids(functions)
    none = F.lit(None).cast("string")
    files = f.groupBy("path").agg(F.min("seq").alias("seq")).select(file_id(F.col("path")).alias("node_id"), F.lit("File").alias("type"), T.base_name(F.col("path")).alias("name"), "path", none.alias("file_path"), none.alias("label"), F.lit(None).cast("int").alias("line_number"), none.alias("content"), "seq")
    classes = f.where("class IS NOT NULL").groupBy("path", "class").agg(F.min("seq").alias("seq")).select(class_id(F.col("path"), F.col("class")).alias("node_id"), F.lit("Class/Contract").alias("type"), F.col("class").alias("name"), none.alias("path"), F.col("path").alias("file_path"), none.alias("label"), F.lit(None).cast("int").alias("line_number"), none.alias("content"), "seq")
    # contents are gathered of ids alone that several functions share
    shared = scratch(f.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select("node_id"), "shared")
    record = F.struct("name", "path", "line_number", "content")
    last = f.join(shared, "node_id", "left_semi").groupBy("node_id").agg(F.max_by(record, "seq").alias("x"), F.min("seq").alias("seq"))
    latest = f.join(shared, "node_id", "left_anti").select("node_id", record.alias("x"), "seq").unionByName(last)
    functions_ = latest.select("node_id", F.lit("Function").alias("type"), F.col("x.name").alias("name"), none.alias("path"), F.col("x.path").alias("file_path"), F.col("x.name").alias("label"), F.col("x.line_number").cast("int").alias("line_number"), F.col("x.content").alias("content"), "seq")
    calls = scratch(call_edges(f), "calls")
    externals = calls.where(F.startswith("dst", F.lit("External:"))).groupBy("dst").agg(F.min("seq").alias("seq")).select(F.col("dst").alias("node_id"), F.lit("External").alias("type"), F.substring("dst", 10, 1 << 30).alias("name"), none.alias("path"), none.alias("file_path"), none.alias("label"), F.lit(None).cast("int").alias("line_number"), none.alias("content"), "seq")
    return files.unionByName(classes).unionByName(functions_).unionByName(externals), definitions(f).unionByName(calls)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count."""
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))


def _ends_of_paths(rows: DataFrame, path: str, name: str, short: str | Column, line: str, found: bool) -> DataFrame:
    """kind, line, key by which records meet nodes: 3 path and name, 4 path and short name, 5 the file in its folder and short name, 6 the file and
    short name where a node has no folder, 7 the same where a record has none.

    Nodes (`found`) are gathered to the first of each key, as m, so a record meets at most one node of each kind and none
    that shares only its line.
    """
    at, short = F.col(path), F.col(short) if isinstance(short, str) else short
    folder, named = F.instr(at, "/") > 0, at != ""
    key = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.to_json(F.array(*parts)).alias("key"))
    keys = [
        key(3, at, F.col(name)), key(4, at, short), F.when(named & folder, key(5, T.path_suffix(at), short)),
        F.when(named & (~folder if found else folder), key(6, T.base_name(at), short)), F.when(named if found else named & ~folder, key(7, T.base_name(at), short)),
    ]
    out = rows.where(at.isNotNull() & F.col(name).isNotNull()).select(*(["node_id", "n_seq"] if found else ["func_id"]), F.col(line).alias("line"), F.explode(F.array_compact(F.array(*keys))).alias("k")).select("*", "k.kind", "k.key").drop("k")
    return out.groupBy("kind", "line", "key").agg(F.min(F.struct("n_seq", "node_id")).alias("m")) if found else out


def match_nodes(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """func_id, node_id, strategy for records (func_id, path, name, line) against function nodes (node_id, file_path, name, line_number, seq).

    1 the id made of the full name, 2 of the short name; 3 path, name and line; 4 path, short name and line;
    5 any end of the record's path as the path of 1 and 2; 6 the first node of that line whose path ends
    alike and whose name is the full or short one. Records that none matches are left out.
    """
    r = records.withColumn("path", T.unix_path(F.col("path"))).withColumn("short", T.short_name(F.col("name")))
    n = nodes.select("node_id", T.unix_path(F.col("file_path")).alias("n_path"), F.col("name").alias("n_name"), F.col("line_number").alias("n_line"), F.col("seq").alias("n_seq"))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tries = r.select(
        "func_id", "line", "path", "name", "short",
        F.explode(F.concat(
            F.array(F.struct(F.lit(1).alias("s"), function_id(F.col("path"), F.col("name"), F.col("line")).alias("id")), F.struct(F.lit(2).alias("s"), function_id(F.col("path"), F.col("short"), F.col("line")).alias("id"))),
            F.flatten(F.transform(ends, lambda e: F.array(F.struct(F.lit(5).alias("s"), function_id(e, F.col("name"), F.col("line")).alias("id")), F.struct(F.lit(5).alias("s"), function_id(e, F.col("short"), F.col("line")).alias("id"))))),
        )).alias("t"),
    )
    by_id = tries.join(n, tries["t.id"] == n["node_id"]).select("func_id", F.col("t.s").alias("s"), "node_id", "n_seq")
    by_line = _ends_of_paths(r, "path", "name", "short", "line", found=False).join(
        _ends_of_paths(n, "n_path", "n_name", T.short_name(F.col("n_name")), "n_line", found=True), ["kind", "line", "key"]
    ).select("func_id", F.when(F.col("kind") < 5, F.col("kind")).otherwise(6).alias("s"), "m.node_id", F.col("m.n_seq").alias("n_seq"))
    best = by_id.unionByName(by_line).groupBy("func_id").agg(F.min(F.struct("s", "n_seq", "node_id")).alias("b"))
    return best.select("func_id", "b.node_id", F.col("b.s").alias("strategy"))


def parent_scopes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, defined_in: the name of what defines a node first."""
    named = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("parent"))
    return edges.where("relation = 'DEFINES'").join(named, "src").groupBy(F.col("dst").alias("node_id")).agg(F.min_by("parent", F.struct("seq", "src")).alias("defined_in"))


def _ordered_names(rows: DataFrame, key: str) -> DataFrame:
    gathered = F.array_sort(F.collect_list(F.struct("seq", "pos", "name")))
    return _with_pos(rows).groupBy(F.col(key).alias("node_id")).agg(F.transform(gathered, lambda x: x["name"]).alias("names"))


def callees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, names: the labels of what a function calls, in order of the calls."""
    named = nodes.select(F.col("node_id").alias("dst"), F.coalesce("label", "name").alias("name"))
    calls = edges.where("relation = 'CALLS'").join(named, "dst", "left").withColumn("name", F.coalesce("name", F.regexp_replace("dst", "^[^:]*:", "")))
    return _ordered_names(calls, "src")


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, names: the labels of the functions that call a node, in order of the calls."""
    named = nodes.where("type = 'Function'").select(F.col("node_id").alias("src"), F.coalesce("label", "name").alias("name"))
    return _ordered_names(edges.where("relation = 'CALLS'").join(named, "src"), "dst")


def enrich(functions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The chunks of functions: each record with what defines it, what it calls and what calls it.

    Records whose node isn't in the graph keep their own calls and class, and have no callers.
    """
    f = with_ids(functions)
    known = nodes.select("node_id", F.lit(True).alias("known"))
    # only callers of what is enriched are gathered, so not those of external names
    inner = edges.where(~F.startswith("dst", F.lit("External:"))).join(f.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi")
    out = (
        f.join(known, "node_id", "left").join(parent_scopes(nodes, edges), "node_id", "left")
        .join(callees(nodes, edges).withColumnRenamed("names", "out"), "node_id", "left").join(callers(nodes, inner).withColumnRenamed("names", "inn"), "node_id", "left")
    )
    none = F.array().cast("array<string>")
    return out.select(
        "file_path", F.col("name").alias("function_name"), F.lit("Function").alias("node_type"), "node_id",
        F.when(F.col("known"), F.coalesce("defined_in", F.lit(""))).otherwise(F.coalesce("class", F.lit(""))).alias("defined_in"),
        F.when(F.col("known"), F.coalesce("out", none)).otherwise(F.coalesce("calls", none)).alias("calls"), F.coalesce("inn", none).alias("called_by"),
        F.coalesce("content", F.lit("")).alias("code"), F.lit("").alias("chunk_id"), F.lit("").alias("parent_doc_id"), F.lit(0).alias("chunk_order"),
    )


def to_text(chunks: DataFrame) -> DataFrame:
    """Chunks with a column `text`: sections for metadata, context and code."""
    line = lambda tag, value: F.concat(F.lit(tag + ": "), value)
    held = (F.col("chunk_order") > 0) | (F.col("parent_doc_id") != "")
    parts = F.array_compact(
        F.array(
            F.lit("[METADATA]"), line("File", F.col("file_path")), line("Function", F.col("function_name")), line("Type", F.col("node_type")), line("Node_ID", F.col("node_id")),
            F.when(F.col("chunk_id") != "", line("Chunk_ID", F.col("chunk_id"))), F.when(F.col("parent_doc_id") != "", line("Parent_Doc_ID", F.col("parent_doc_id"))), F.when(held, line("Chunk_Order", F.col("chunk_order").cast("string"))),
            F.lit(""), F.lit("[CONTEXT]"), line("Defined_In", F.col("defined_in")), line("Calls", F.array_join("calls", ", ")), line("Called_By", F.array_join("called_by", ", ")), F.lit(""), F.lit("[CODE]"), F.col("code"),
        )
    )
    return chunks.withColumn("text", F.array_join(parts, "\n"))


def from_text(texts: DataFrame) -> DataFrame:
    """The fields of chunk texts: of each tag the first occurrence, lists split at commas, the code as it stands."""
    text = F.col("text")
    meta, context, code = (F.instr(text, tag) for tag in ("[METADATA]", "[CONTEXT]", "[CODE]"))
    head = F.substring(text, meta, F.when(context > 0, context - meta).otherwise(F.length(text)))
    middle = F.when(context > 0, F.substring(text, context, F.when(code > 0, code - context).otherwise(F.length(text)))).otherwise("")
    field = lambda part, tag: F.trim(F.regexp_extract(part, f"(?m)^{tag}:(.*)$", 1))
    items = lambda part, tag: F.filter(F.transform(F.split(field(part, tag), ","), lambda x: F.trim(x)), lambda x: x != "")
    order = field(head, "Chunk_Order")
    return texts.select(
        *(field(head, t).alias(n) for t, n in (("File", "file_path"), ("Function", "function_name"), ("Type", "node_type"), ("Node_ID", "node_id"), ("Chunk_ID", "chunk_id"), ("Parent_Doc_ID", "parent_doc_id"))),
        F.coalesce(order.try_cast("int"), F.lit(0)).alias("chunk_order"), field(middle, "Defined_In").alias("defined_in"), items(middle, "Calls").alias("calls"), items(middle, "Called_By").alias("called_by"),
        F.when(code > 0, F.regexp_replace(F.substring(text, code + 6, F.length(text)), "^\n", "")).otherwise("").alias("code"),
    )


def _with_pos(edges: DataFrame) -> DataFrame:
    """Edges of an index that has no places of calls: 0."""
    return edges if "pos" in edges.columns else edges.withColumn("pos", F.lit(0))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node_id, relationship, place of what seeds (node_id, place) call and are called by: the seed's place, then direction and order."""
    calls = _with_pos(edges).where("relation = 'CALLS' AND src <> dst")

    def side(near: str, far: str, relationship: str, direction: int) -> DataFrame:
        at = F.concat("place", F.array(F.lit(direction).cast("long"), F.coalesce("seq", F.lit(0)).cast("long"), F.coalesce("pos", F.lit(0)).cast("long")))
        return calls.join(seeds.withColumnRenamed("node_id", near), near).select(F.col(far).alias("node_id"), F.lit(relationship).alias("relationship"), at.alias("place"))

    return side("src", "dst", "CALLS", 0).unionByName(side("dst", "src", "CALLED_BY", 1))


def _placed(seeds: DataFrame) -> DataFrame:
    return seeds.select("node_id", F.array(F.col("seed_seq").cast("long")).alias("place")) if "place" not in seeds.columns else seeds


def expand(edges: DataFrame, seeds: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """node_id, relationship, place: neighbours of seeds (node_id, seed_seq) once each, in order of seeds, calls before callers.

    Seeds, excluded nodes and external names are left out. place is an array of numbers by which results are ordered.
    """
    near = neighbours(edges, _placed(seeds)).where(~F.startswith("node_id", F.lit("External:")))
    first = near.groupBy("node_id").agg(F.min(F.struct("place", "relationship")).alias("m")).select("node_id", "m.relationship", "m.place")
    gone = seeds.select("node_id") if exclude is None else seeds.select("node_id").union(exclude.select("node_id"))
    return first.join(gone, "node_id", "left_anti")


def with_content(found: DataFrame, chunks: DataFrame, functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Found nodes with content: of their chunks in order, else the function's, else the node's own if not empty; the rest go.

    Contents meet the found nodes before anything is gathered, so only those of found nodes are.
    """
    none = F.lit(None).cast("string")
    chunk, last = F.struct("chunk_order", "text"), F.struct("seq", "content")
    contents = (
        chunks.select("node_id", chunk.alias("chunk"), F.lit(None).cast("struct<seq: bigint, content: string>").alias("last"), none.alias("own"))
        .unionByName(functions.select("node_id", F.lit(None).cast("struct<chunk_order: int, text: string>").alias("chunk"), last.alias("last"), none.alias("own")))
        .unionByName(nodes.select("node_id", F.lit(None).cast("struct<chunk_order: int, text: string>").alias("chunk"), F.lit(None).cast("struct<seq: bigint, content: string>").alias("last"), F.col("content").alias("own")))
    )
    parts = F.transform(F.array_sort(F.collect_list("chunk")), lambda x: x["text"])
    joined = found.join(contents, "node_id").groupBy(*found.columns).agg(F.when(F.count("chunk") > 0, F.array_join(parts, "\n")).alias("c1"), F.max_by("last.content", "last.seq").alias("c2"), F.max("own").alias("c3"))
    return joined.withColumn("content", F.coalesce("c1", "c2", F.nullif("c3", F.lit("")))).drop("c1", "c2", "c3").where("content IS NOT NULL")


def expand_levels(edges: DataFrame, seeds: DataFrame, depth: int, chunks: DataFrame, functions: DataFrame, nodes: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """node_id, relationship, content, depth, place of nodes within `depth` steps, level by level.

    A level's nodes are reached from the level before; each has its relation to the node that reached it. Nodes
    without content are neither returned nor passed through. Levels are checkpointed; an empty one ends it.
    """
    spark = edges.sparkSession
    result = spark.createDataFrame([], "node_id string, relationship string, content string, depth int, place array<bigint>")
    front = _placed(seeds)
    seen = front.select("node_id") if exclude is None else front.select("node_id").union(exclude.select("node_id"))
    for level in range(1, depth + 1):
        found = _cut(with_content(expand(edges, front, seen), chunks, functions, nodes))
        if found.isEmpty():
            break
        result = result.unionByName(found.select("node_id", "relationship", "content", F.lit(level).alias("depth"), "place"))
        front, seen = found.select("node_id", "place"), seen.union(found.select("node_id"))
    return result


def reach(steps: DataFrame, seeds: DataFrame, depth: int, exclude: DataFrame | None = None) -> DataFrame:
    """node_id, depth of all nodes that `depth` steps (src, dst) or fewer lead to from seeds (node_id), the least each.

    Each level is one join and one anti-join with what was seen; levels are checkpointed, an empty one ends it.
    """
    result = steps.sparkSession.createDataFrame([], "node_id string, depth int")
    front = seeds.select("node_id").distinct()
    seen = front if exclude is None else front.union(exclude.select("node_id")).distinct()
    for level in range(1, depth + 1):
        reached = steps.join(front.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id")).distinct()
        front = _cut(reached.join(seen, "node_id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
        result = result.union(front.select("node_id", F.lit(level).alias("depth")))
    return result


def expand_to_depth(edges: DataFrame, seeds: DataFrame, depth: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """node_id, depth of all nodes within `depth` calls in either direction."""
    calls = edges.where("relation = 'CALLS' AND src <> dst")
    both = calls.select("src", "dst").union(calls.select("dst", "src")).where(~F.startswith("src", F.lit("External:")) & ~F.startswith("dst", F.lit("External:")))
    return reach(both, seeds, depth, exclude)


def _cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that plans don't grow with the levels; deleted with the session."""
    return scratch(df, "level")


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, up (different callers), down (different callees), zero where none."""
    down = edges.groupBy(F.col("src").alias("node_id")).agg(F.count_distinct("dst").alias("down"))
    up = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count_distinct("src").alias("up"))
    return down.join(up, "node_id", "full").select("node_id", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"))

