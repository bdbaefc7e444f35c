"""Queries that do their operator's whole job, against brute force over the tables or a small fixture."""

import json
import re

from conftest import DATA

from codexmill.operators import calltree
from codexmill.plans.queries import QUERIES
from codexmill.sources import store


def test_call_trees_of_all_functions(spark):
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).collect()]
    buyer = dict(read("orders", "o_orderkey", "o_custkey"))
    calls = {}
    for order, part, supplier in read("lineitem", "l_orderkey", "l_partkey", "l_suppkey"):
        calls.setdefault(f"c{buyer[order]}", set()).add(f"p{part}")
        calls.setdefault(f"p{part}", set()).add(f"s{supplier}")
    level = [[f"{x}{k}"] for x, name, key in (("c", "customer", "c_custkey"), ("p", "part", "p_partkey"), ("s", "supplier", "s_suppkey")) for (k,) in read(name, key)]
    roots, want = {p[0] for p in level}, []
    while level:
        want += map(tuple, level)
        level = [[*p, x] for p in level for x in calls.get(p[-1], ()) if x not in p]
    got = [(r.root, r.depth, r.path) for r in QUERIES["call_tree_paths"](spark, DATA).collect()]
    assert sorted(got) == sorted((p[0], len(p) - 1, ">".join(p)) for p in want)
    assert {r for r, _, _ in got} == roots and {d for _, d, _ in got} == {0, 1, 2}


def test_call_trees_with_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("c", "a")], "caller string, callee string")
    roots = spark.createDataFrame([("a",), ("d",)], "name string")
    assert sorted(">".join(r.path) for r in calltree.call_trees(roots, pairs).collect()) == ["a", "a>b", "a>b>c", "d"]


def test_many_paths_without_cycles_are_no_explosion(spark):
    # a ladder of nine levels of three functions: 3 + 9 + ... + 3^9 paths from the first level alone
    pairs = spark.createDataFrame([(f"{i}{a}", f"{i + 1}{b}") for i in range(8) for a in "abc" for b in "abc"], "caller string, callee string")
    roots = spark.createDataFrame([("0a",), ("8b",), ("none",)], "name string")
    for direction, first in (("downstream", "0a"), ("upstream", "8b")):
        got = calltree.call_trees(roots, pairs, direction=direction, most_paths=100)
        assert got.count() == 2 + sum(3**i for i in range(9)) and got.distinct().count() == got.count()
        assert got.where(f"depth = 8 AND root = '{first}'").count() == 3**8


def test_leaves_and_entry_points_hold_no_pairs(spark):
    """Only names are grouped, not pairs, though the pairs are different ones."""
    for name, column in (("leaf_functions", "callee"), ("entry_points", "caller")):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        grouped = [line for line in plan.split("\n") if "Aggregate [" in line]
        assert grouped and not any(column in line for line in grouped), plan


def test_graph_statistics_of_nulls_and_nothing(spark):
    edges = spark.createDataFrame([("a", "b", "go", "x"), ("a", "c", None, "x"), ("b", "c", "go", None)], "caller string, callee string, language string, call_type string")
    want = {"total_edges": 3, "language:go": 2, "language:": 1, "call_type:x": 2, "call_type:": 1, "unique_functions_count": 3}
    assert {r.key: r.n for r in calltree.graph_statistics(edges).collect()} == want
    assert [tuple(r) for r in calltree.graph_statistics(edges.where("false")).collect()] == [("total_edges", 0)]
    found = calltree.graph_statistics(edges.repartition(3))._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("Aggregate [language") >= 3  # one plan, which its three readers share


def test_text_search_keeps_every_document(spark):
    rows = [(8, "x go", "x pay ("), (9, "pay (", "pay (  ("), (10, "( ", "x go("), (1, "go", "go now(. "), (2, "go", "go and pay(. "), (3, "pay", "pay or go (x"), (4, "a", "a pay(. "), (5, "pay", "pay a(. "), (6, None, None), (7, "", " ")]
    f = spark.createDataFrame(rows, "doc_id long, name string, content string")
    names = {n for _, n, _ in rows if n}
    names -= {"( "}  # a name of marks alone matches nothing
    want = {(i, n) for i, own, text in rows if own for n in names if n != own and re.search(re.escape(n) + r"\s*\(", text)}
    assert {(2, "pay"), (3, "go"), (4, "pay"), (5, "a"), (10, "x go"), (8, "pay")} <= want
    assert {(r.caller, r.callee) for r in calltree.called_by_text(f, "doc_id").collect()} == want


def test_json_lists_over_lines(spark, tmp_path):
    name = next(k for k, v in store.TABLES.items() if "name" in str(v))
    rows = [{"name": "a"}, {"name": "b"}]
    for i, text in enumerate((json.dumps(rows), json.dumps(rows, indent=2), "[" + ",\n".join(map(json.dumps, rows)) + "]", "\n".join(map(json.dumps, rows)))):
        (tmp_path / f"{i}.json").write_text(text)
        assert sorted(r.name for r in store.read_json(spark, str(tmp_path / f"{i}.json"), name).collect()) == ["a", "b"], text


def test_call_trees_deal_out_few_steps(spark, monkeypatch):
    """Where all callers are roots, no first level and no sets of reached functions are written, in both directions; other roots, also repeated ones, get their paths too."""
    from codexmill.operators import calltree

    pairs = spark.createDataFrame([("c1", "p1"), ("c1", "p2"), ("c2", "p2"), ("p1", "s1"), ("p2", "s1"), ("p2", "s2"), ("x", "y")], "caller string, callee string")
    roots = pairs.select(pairs.caller.alias("name")).union(pairs.select("callee")).distinct()
    paths = lambda roots, **more: sorted(">".join(r.path) for r in calltree.call_trees(roots, pairs, **more).collect())
    labels, write = [], calltree.scratch
    monkeypatch.setattr(calltree, "scratch", lambda table, label: labels.append(label) or write(table, label))
    down = ["c1", "c1>p1", "c1>p1>s1", "c1>p2", "c1>p2>s1", "c1>p2>s2", "c2", "c2>p2", "c2>p2>s1", "c2>p2>s2", "p1", "p1>s1", "p2", "p2>s1", "p2>s2", "s1", "s2", "x", "x>y", "y"]
    assert paths(roots) == down
    assert paths(roots, direction="upstream") == sorted(">".join(reversed(x.split(">"))) for x in down)
    assert labels == ["steps", "inner", "steps", "inner"] * 2
    some = spark.createDataFrame([("p2",), ("x",), ("x",), ("z",)], "name string")
    assert paths(some) == ["p2", "p2>s1", "p2>s2", "x", "x", "x>y", "x>y", "z"]
