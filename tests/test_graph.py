"""Traversals against brute force on random graphs, and edge cases."""

import random

import pytest

from thicket.errors import ValidationError
from thicket.operators import graph

EDGES = "repo_id string, src string, dst string, type string"


def random_graph(seed, n=7, m=12):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)})


def trails(edges, start, depth, upward=False):
    """(end, length) of all paths that use no edge twice."""
    found, todo = set(), [(start, frozenset())]
    for d in range(1, depth + 1):
        grown = []
        for at, used in todo:
            for e in edges:
                a, b = e[::-1] if upward else e
                if a == at and e not in used:
                    found.add((b, d))
                    grown.append((b, used | {e}))
        todo = grown
    return found


@pytest.mark.parametrize("seed", range(4))
def test_hierarchy_is_all_trails(spark, seed):
    pairs = random_graph(seed)
    edges = spark.createDataFrame([("r", a, b, "CALLS") for a, b in pairs] * 2, EDGES)
    seeds = spark.createDataFrame([("n0",), ("n1",), (None,), ("n0",)], "id string")
    for upward in (True, False):
        got = {(r["seed"], r["id"], r["depth"]) for r in graph.hierarchy(edges, seeds, ["CALLS"], 4, upward).collect()}
        assert got == {(s, *x) for s in ("n0", "n1") for x in trails(pairs, s, 4, upward)}


@pytest.mark.parametrize("seed", range(3))
def test_subgraph_is_edges_of_undirected_trails(spark, seed):
    pairs = [p for p in random_graph(seed, 9, 11) if p[0] != p[1]]
    edges = spark.createDataFrame([("r", a, b, "CALLS") for a, b in pairs], EDGES)
    expected, todo = set(), [("n0", frozenset())]
    for _ in range(2):
        grown = []
        for at, used in todo:
            for e in pairs:
                if at in e and e not in used:
                    expected.add(e)
                    grown.append((e[1] if e[0] == at else e[0], used | {e}))
        todo = grown
    got = {(r["src"], r["dst"]) for r in graph.subgraph(edges, spark.createDataFrame([("n0",)], "id string"), ["CALLS"], 2).collect()}
    assert got == expected


def test_reachability_and_paths(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")]
    edges = spark.createDataFrame([("r", a, b, "CALLS") for a, b in pairs], EDGES)
    root = spark.createDataFrame([("a",), (None,)], "id string")
    assert {r["id"] for r in graph.reachable(edges, root).collect()} == {"a", "b", "c", "d"}
    path = graph.shortest_path(edges, "a", "d").orderBy("step").collect()
    assert [r["id"] for r in path] == ["a", "c", "d"] and [r["edge"] for r in path] == [None, "CALLS", "CALLS"]
    assert graph.shortest_path(edges, "a", "y").isEmpty() and graph.shortest_path(edges, "a", "a").count() == 1


def test_empty_and_guards(spark):
    nodes, edges = graph.empty_graph(spark)
    seeds = spark.createDataFrame([], "id string")
    assert graph.callers(edges, seeds).isEmpty() and graph.reachable(edges, seeds).isEmpty() and graph.subgraph(edges, seeds).isEmpty()
    for depth in (0, 6, 1.5, True):
        with pytest.raises(ValidationError):
            graph.check_depth(depth)
    with pytest.raises(ValidationError):
        graph.check_types(["NOPE"])
    with pytest.raises(ValidationError, match="who_calls"):
        graph.run_template(nodes, edges, "drop_all", {})
    with pytest.raises(ValidationError, match="name"):
        graph.run_template(nodes, edges, "who_calls", {"repo": "r"})


def test_routes_follow_a_rename(spark):
    nodes = spark.createDataFrame([("r:old.ts#GET /a", "r", "Route", "GET /a", "old.ts"), ("r:new.ts#GET /a", "r", "Route", "GET /a", "new.ts"), ("h", "r", "Function", "h", "new.ts")], "id string, repo_id string, label string, name string, path string")
    edges = spark.createDataFrame([("r", "r:new.ts", "r:new.ts#GET /a", "CONTAINS"), ("r", "h", "r:new.ts#GET /a", "HANDLES")], EDGES)
    kept, moved = graph.rekey_routes(nodes, edges, spark.createDataFrame([("old.ts", "new.ts")], "old_path string, new_path string"))
    assert {(r["id"], r["path"]) for r in kept.collect()} == {("r:old.ts#GET /a", "new.ts"), ("h", "new.ts")}
    assert {r["dst"] for r in moved.collect()} == {"r:old.ts#GET /a"}
