"""Who calls whom by names and texts, call trees, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators.graph import reach
from codexmill.sources.scratch import scratch


def called_by_text(functions: DataFrame, key: str = "name") -> DataFrame:
    """caller, callee: whose content holds another's full name before a parenthesis, in any case.

    A match ends in a run without white space or parenthesis, right before the parenthesis, so a content is
    cut into these runs and names are found among the runs' ends by an equi-join: no pair of functions that
    don't share one is formed. Each different run of all contents is looked up once, however often it is called, and of its
    ends only those as long as some name of the same last letter. A name that holds
    white space or a parenthesis itself is joined by its own last run, and the content is looked through only
    for what that join gives; names of such marks alone match nothing. Callers are given by `key`, which tells
    functions of one name apart; a function doesn't call its own name.
    """
    f = functions.select(F.col(key).alias("caller"), "name", F.lower("content").alias("content")).where("name IS NOT NULL AND name <> ''")
    last = F.regexp_extract(F.lower("name"), r"([^\s(]+)[\s(]*$", 1)
    names = f.select(F.col("name").alias("callee"), last.alias("low"), (F.lower("name") != last).alias("odd")).distinct().where("low <> ''")
    by_letter = names.groupBy(F.right("low", F.lit(1)).alias("letter")).agg(F.array_sort(F.collect_set(F.length("low"))).alias("lengths"))
    lengths = by_letter.agg(F.map_from_entries(F.collect_list(F.struct("letter", "lengths"))).alias("lengths"))
    cut = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([^\s(]+)\s*\("), 1))
    runs = f.select("caller", "name", F.explode(cut).alias("run"))
    run, size = F.col("run"), F.length("run")
    own = F.filter(F.element_at("lengths", F.right(run, F.lit(1))), lambda n: n <= size)
    ends = runs.select("run").distinct().crossJoin(F.broadcast(lengths)).select("run", F.explode(F.transform(own, lambda n: F.substring(run, size - n + 1, n))).alias("low"))
    found = runs.join(ends.join(names.where("NOT odd"), "low").select("run", "callee"), "run").select("caller", "name", "callee")
    if not names.where("odd").isEmpty():
        likely = runs.join(ends.join(names.where("odd"), "low").select("run", "callee"), "run").select("caller", "name", "callee").distinct()
        held = likely.join(f.select("caller", "content"), "caller").where(T.called_in(F.col("callee"), F.col("content")))
        found = found.union(held.select("caller", "name", "callee"))
    return found.where("name <> callee").select("caller", "callee").distinct()


def called_by_list(functions: DataFrame) -> DataFrame:
    """caller, callee: listed calls whose short name is another's full name."""
    calls = functions.select(F.col("name").alias("caller"), F.explode("calls").alias("call")).select("caller", T.short_name(F.col("call")).alias("callee"))
    return calls.join(functions.select(F.col("name").alias("callee")).distinct(), "callee").where("caller <> callee").select("caller", "callee").distinct()


def relationships(functions: DataFrame) -> DataFrame:
    return called_by_list(functions).union(called_by_text(functions)).distinct()


def counts(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """name, upstream_count, downstream_count of every function."""
    down = pairs.groupBy(F.col("caller").alias("name")).agg(F.count_distinct("callee").alias("downstream_count"))
    up = pairs.groupBy(F.col("callee").alias("name")).agg(F.count_distinct("caller").alias("upstream_count"))
    every = names(functions)
    return every.join(up, "name", "left").join(down, "name", "left").na.fill(0, ["upstream_count", "downstream_count"])


def statistics(counted: DataFrame) -> DataFrame:
    """One row of totals over name, upstream_count, downstream_count."""
    up, down = F.col("upstream_count"), F.col("downstream_count")
    return counted.agg(
        F.count("*").alias("total_functions"), F.count_if(up > 0).alias("functions_with_upstream"), F.count_if(down > 0).alias("functions_with_downstream"),
        F.coalesce(F.max(up), F.lit(0)).alias("max_upstream_count"), F.coalesce(F.max(down), F.lit(0)).alias("max_downstream_count"), F.count_if((up == 0) & (down == 0)).alias("isolated_functions"),
    )


def entry_points(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Functions that nothing calls."""
    return functions.join(pairs.select(F.col("callee").alias("name")).distinct(), "name", "left_anti")


def leaves(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Functions that call nothing; the callers alone are made different, before pairs are."""
    return functions.join(pairs.select(F.col("caller").alias("name")).distinct(), "name", "left_anti")


class PathExplosion(Exception):
    """A graph has more simple paths than wanted: `depth` calls long ones would be up to `paths` together with all shorter ones."""

    def __init__(self, depth: int, paths: int):
        super().__init__(f"up to {paths} paths at a depth of {depth}; give a depth, or look at cycles()")
        self.depth, self.paths = depth, paths


def call_trees(roots: DataFrame, pairs: DataFrame, max_depth: int | None = None, direction: str = "downstream", most_paths: int = 1_000_000_000) -> DataFrame:
    """root, depth, path: every simple path from the roots (name), of at most `max_depth` calls if that is given.

    Each level is one join. A graph without cycles has a longest path, so its depth is found from sets of functions first, however many
    paths there are; the levels on the way are written, the last and largest one streams out of its join. A level meets only the steps that
    can stand at its place of a path, and where all callers are roots the steps themselves are the first level. The simple paths of a graph with cycles
    explode: there levels are written until one is empty, the next level's size is known from the ends of this one's paths before it is
    written, and if all levels would have more than `most_paths`, PathExplosion tells so. No path is ever left out.
    """
    a, b = ("caller", "callee") if direction == "downstream" else ("callee", "caller")
    steps = pairs.select(F.col(a).alias("at"), F.col(b).alias("next")).distinct()
    level, end = roots.select(F.array("name").alias("path")), F.element_at("path", -1)
    written, cyclic, whole, places = max_depth is None, False, False, []
    if written:
        steps = scratch(steps, "steps")
        places = _by_place(steps)
        cyclic, whole = not places, bool(places) and _all_roots(roots, steps)
        max_depth = None if cyclic else len(places) if whole else _longest(roots, steps)
    shown = lambda rows, depth: rows.select(F.element_at("path", 1).alias("root"), F.lit(depth).alias("depth"), "path")
    out, depth, total = shown(level, 0), 0, 0
    degree = steps.groupBy("at").agg(F.count("*").alias("n"))
    while max_depth is None or depth < max_depth:
        depth += 1
        if cyclic:
            ends = level.groupBy(end.alias("at")).agg(F.count("*").alias("paths"))
            total += ends.join(degree, "at").agg(F.coalesce(F.sum(F.col("paths") * F.col("n")), F.lit(0))).first()[0]
            if total > most_paths:
                raise PathExplosion(depth, total)
        if whole and depth == 1:
            level = steps.select(F.array("at", "next").alias("path"))
        else:
            here = places[depth - 1] if places else steps
            level = level.join(here, end == F.col("at")).where(~F.array_contains("path", F.col("next"))).select(F.array_append("path", F.col("next")).alias("path"))
            if written and depth != max_depth:
                level = scratch(level, "paths")
                if cyclic and level.isEmpty():
                    break
        out = out.unionByName(shown(level, depth))
    return out


def _by_place(steps: DataFrame) -> list[DataFrame]:
    """The steps (at, next) that can be the first, second and so on of a path, up to the longest path's last; none if there are cycles.

    A step that can stand one place later starts where a step of this place ends. Sets of functions tell whether there are such before steps are dealt out by them.
    """
    places, before = [steps], None
    while True:
        inner = scratch(places[-1].select("at").distinct().join(places[-1].select(F.col("next").alias("at")).distinct(), "at", "left_semi"), "inner")
        n = inner.count()
        if not n:
            return places
        if n == before:
            return []
        before = n
        places.append(scratch(places[-1].join(inner, "at", "left_semi"), "steps"))


def _all_roots(roots: DataFrame, steps: DataFrame) -> bool:
    """Whether every start of a step is a root (name), and once."""
    named = roots.groupBy(F.col("name").alias("at")).agg(F.count("*").alias("n"))
    starts = steps.select("at").distinct().join(named, "at", "left")
    return starts.where("n IS NULL OR n > 1").isEmpty()


def _longest(roots: DataFrame, steps: DataFrame) -> int:
    """How many steps (at, next) the longest path from the roots has, in a graph without cycles."""
    front, depth = roots.select(F.col("name").alias("at")), 0
    while not (front := scratch(steps.join(front, "at", "left_semi").select(F.col("next").alias("at")).distinct(), "front")).isEmpty():
        depth += 1
    return depth


def cycles(pairs: DataFrame) -> DataFrame:
    """name, component: the functions that call each other in a circle, with the least name of those that all reach one another.

    Forward and backward colouring: what no cycle can hold is trimmed off; each function takes the least name that reaches it;
    from the functions that keep their own name, those of their colour that reach them are their component. Components are
    taken out and the rest goes on. Every step is a join of tables in the shared folder; the driver sees only counts.
    """
    steps = scratch(pairs.where("caller <> callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct(), "steps")
    found = pairs.sparkSession.createDataFrame([], "name string, component string")
    while True:
        steps = _trimmed(steps)
        if steps.isEmpty():
            return found
        colours = scratch(steps.select(F.col("src").alias("name")).distinct().withColumn("colour", F.col("name")), "colours")
        while True:
            given = steps.join(colours.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.min("colour").alias("given"))
            next_ = scratch(colours.join(given, "name").select("name", F.least("colour", "given").alias("colour"), (F.col("given") < F.col("colour")).alias("moved")), "colours")
            moved, colours = not next_.where("moved").isEmpty(), next_.drop("moved")
            if not moved:
                break
        ends = steps.join(colours.select(F.col("name").alias("src"), F.col("colour").alias("c")), "src").join(colours.select(F.col("name").alias("dst"), "colour"), "dst").where("c = colour").select("src", "dst", "colour")
        ends = scratch(ends, "coloured")
        front = members = scratch(colours.where("name = colour"), "members")
        while not front.isEmpty():
            back = ends.join(front.select(F.col("name").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("name"), "colour").distinct()
            front = scratch(back.join(members, ["name", "colour"], "left_anti"), "front")
            members = members.union(front)
        members = scratch(members, "members")
        # a function alone in its colour is in no cycle
        large = members.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        found = found.union(members.join(large, "colour").select("name", F.col("colour").alias("component")))
        gone = members.select("name")
        steps = scratch(steps.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti"), "steps")


def _trimmed(steps: DataFrame) -> DataFrame:
    """Steps between functions that call something and are called; the rest goes until none does."""
    n = steps.count()
    while n:
        steps = scratch(steps.join(steps.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(steps.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "steps")
        left = steps.count()
        if left == n:
            break
        n = left
    return steps


def nested(rows: list, root: str) -> dict:
    """One root's paths, collected, as a nested tree of name and children."""
    tree: dict = {"name": root, "children": []}
    at = {(root,): tree}
    for path in sorted((tuple(r["path"]) for r in rows if r["root"] == root and len(r["path"]) > 1), key=lambda p: (len(p), p)):
        at[path] = node = {"name": path[-1], "children": []}
        at[path[:-1]]["children"].append(node)
    return tree


def render(tree: dict, indent: int = 0) -> str:
    """A nested tree as indented lines."""
    return "\n".join(["  " * indent + tree["name"], *(render(x, indent + 1) for x in tree["children"])])


def dependency_graph(target: str, functions: DataFrame, pairs: DataFrame, max_depth: int = 3) -> DataFrame:
    """direction, name, depth: what a function depends on and what depends on it, breadth first."""
    root = functions.where(F.col("name") == F.lit(target)).select(F.col("name").alias("node_id")).distinct()
    down = pairs.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    sides = (("upstream", down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), ("downstream", down))
    parts = [reach(steps, root, max_depth).select(F.lit(direction).alias("direction"), F.col("node_id").alias("name"), "depth") for direction, steps in sides]
    return parts[0].unionByName(parts[1])


def builder_info() -> dict:
    """What the call-tree builder offers."""
    return {"type": "relational", "advanced_available": False, "features": {"basic_call_trees": True, "dependency_graph": True, "visualization": False, "mermaid_export": False}}


def names(functions: DataFrame) -> DataFrame:
    """The different function names."""
    return functions.select("name").distinct()


def of_contract(functions: DataFrame, contract: str) -> DataFrame:
    return functions.where(F.col("contract_name") == F.lit(contract))


def by_name(functions: DataFrame, name: str) -> DataFrame:
    """The first function of a name by seq, if any."""
    return functions.where(F.col("name") == F.lit(name)).orderBy("seq").limit(1)


def print_call_graph(edges: DataFrame, limit: int = 50) -> str:
    """An overview of call-graph edges as lines: short names, call type, language; at most `limit` of them, in order of names."""
    total = edges.count()
    if not total:
        return "No call graph data"
    shown = edges.orderBy("caller", "callee", "call_type", "language").limit(limit)
    rows = shown.select(T.short_name(F.col("caller")).alias("a"), T.short_name(F.col("callee")).alias("b"), "call_type", "language").collect()
    lines = [f"Call graph ({total} calls)", *(f"{r.a} -> {r.b} [{r.call_type}] ({r.language})" for r in rows)]
    return "\n".join([*lines, f"... and {total - limit} more"] if total > limit else lines)


def graph_statistics(edges: DataFrame) -> DataFrame:
    """key, n over call-graph edges: total, each language, each call type, and different functions if there is an edge."""
    kinds = edges.groupBy("language", "call_type").agg(F.count("*").alias("n"))  # the three counts go over edges once, as they share this exchange
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total_edges").alias("key"), "n")
    by = lambda column: kinds.groupBy(column).agg(F.sum("n").alias("n")).select(F.concat(F.lit(column + ":"), F.coalesce(F.col(column), F.lit(""))).alias("key"), "n")
    ends = edges.select(F.col("caller").alias("f")).union(edges.select("callee")).distinct().agg(F.count("*").alias("n")).where("n > 0").select(F.lit("unique_functions_count").alias("key"), "n")
    return total.unionByName(by("language")).unionByName(by("call_type")).unionByName(ends)


def functions_csv(functions: DataFrame) -> DataFrame:
    """The columns of the CSV export: modifiers joined, calls counted."""
    return functions.select(
        "name", F.coalesce("contract_name", F.lit("")).alias("contract"), "visibility", "line_number", "file_path",
        F.array_join(F.coalesce("modifiers", F.array().cast("array<string>")), ", ").alias("modifiers"), F.coalesce(F.size("calls"), F.lit(0)).alias("calls_count"),
    )


def kept_functions(functions: DataFrame) -> DataFrame:
    """Without constructors, receive and fallback functions, except in languages where the words mean nothing."""
    low = F.lower("file_path")
    free = F.endswith(low, F.lit(".rs")) | F.endswith(low, F.lit(".move")) | (T.language_of(F.col("file_path")) == "cpp") | F.endswith(low, F.lit(".py")) | F.rlike("name", F.lit("_rust|_move|_cpp|_python"))
    special = F.coalesce(F.col("visibility").isin("constructor", "receive", "fallback"), F.lit(False))
    return functions.where(~special | F.coalesce(free, F.lit(False)))
