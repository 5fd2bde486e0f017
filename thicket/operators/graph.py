"""Traversals over ``nodes(id, repo_id, label, name, path)`` and ``edges(repo_id, src, dst, type)``.

Where an operator takes seeds, all seeds are followed in one job. Bounded path operators keep the edges that a path has used, as a
path may pass a node again but no edge; unbounded ones (reachability, closures, shortest paths) keep a visited set and a frontier,
each round cut by a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.errors import ValidationError
from thicket.session import cut_lineage

# The vocabulary of edges, the edges of a subgraph and of reachability by default.
EDGE_TYPES = """CONTAINS DEFINES DECLARES IMPORTS EXPORTS EXTENDS IMPLEMENTS CALLS WRITES READS USES RETURNS TESTS REFERENCES USES_COMPONENT
    PROVIDES_CONTEXT USES_HOOK CONSUMES_CONTEXT HANDLES DEPENDS_ON""".split()
SUBGRAPH_EDGES = ["CALLS", "USES_COMPONENT", "USES_HOOK", "IMPORTS", "CONTAINS"]
EXPANSION_EDGES = ["CALLS", "USES_COMPONENT", "USES_HOOK", "PROVIDES_CONTEXT", "CONSUMES_CONTEXT", "IMPORTS"]
REACH_EDGES = ["CALLS", "IMPORTS", "USES_COMPONENT", "USES_HOOK"]
MOST_DEPTH, MOST_HOPS = 5, 10


def check_depth(depth: int) -> int:
    """Depths are whole numbers from 1 to 5."""
    if not isinstance(depth, int) or isinstance(depth, bool) or not 1 <= depth <= MOST_DEPTH:
        raise ValidationError(f"depth must be an integer between 1 and {MOST_DEPTH}")
    return depth


def check_types(types: list[str]) -> list[str]:
    unknown = [t for t in types if t not in EDGE_TYPES]
    if unknown:
        raise ValidationError(f"unknown edge types: {', '.join(unknown)}")
    return types


def of_types(edges: DataFrame, types: list[str]) -> DataFrame:
    return edges.filter(F.col("type").isin(check_types(types)))


def hierarchy(edges: DataFrame, seeds: DataFrame, types: list[str], depth: int, upward: bool) -> DataFrame:
    """(seed, id, depth): ends of the paths of 1 to ``depth`` edges from each seed, against the edges if ``upward``.

    A path uses no edge twice, so in a cycle a seed may come to itself. A node is listed once for each length at which it is reached.
    Paths carry the set of edges that they used; paths with one end and the same edges are merged after each step, and the depth
    is at most 5, so what grows is bounded by the neighbourhood, not by the table.
    """
    check_depth(depth)
    step = of_types(edges, types).select(*(("dst", "src") if upward else ("src", "dst"))).toDF("at", "to").filter("at is not null and to is not null").distinct()
    kind = dict(step.dtypes)["at"]
    nothing = F.array().cast(f"array<struct<at:{kind},to:{kind}>>")
    front = seeds.select(F.col("id").alias("seed")).filter("seed is not null").distinct().select("seed", F.col("seed").alias("at"), nothing.alias("used"))
    levels = []
    for d in range(1, depth + 1):
        edge = F.struct(F.col("at"), F.col("to"))
        grown = front.join(step, "at").filter(~F.array_contains("used", edge))
        levels.append(grown.select("seed", F.col("to").alias("id"), F.lit(d).alias("depth")))
        # The order of a path's edges is of no account later on: paths with one end and the same edges are one.
        front = grown.select("seed", F.col("to").alias("at"), F.array_sort(F.concat("used", F.array(edge))).alias("used")).distinct()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.distinct()


def callers(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    return hierarchy(edges, seeds, ["CALLS"], depth, True)


def callees(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    return hierarchy(edges, seeds, ["CALLS"], depth, False)


def component_usage(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Components that use the seeds, directly or through others."""
    components = nodes.filter("label = 'Component'").select("id")
    return hierarchy(edges, seeds, ["USES_COMPONENT"], depth, True).join(components, "id", "left_semi").select("seed", "id", "depth")


def summaries(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``found(id, ...)`` with name, kind and path of each node."""
    return found.join(nodes.select("id", "name", F.col("label").alias("kind"), "path"), "id")


def neighbors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, direction, edge, id, name, kind, path): all edges from and to each seed."""
    ids = seeds.select(F.col("id").alias("seed")).distinct()
    out = edges.join(ids, edges["src"] == ids["seed"]).select("seed", F.lit("outgoing").alias("direction"), F.col("type").alias("edge"), F.col("dst").alias("id"))
    into = edges.join(ids, edges["dst"] == ids["seed"]).select("seed", F.lit("incoming").alias("direction"), F.col("type").alias("edge"), F.col("src").alias("id"))
    return summaries(out.unionByName(into), nodes)


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).filter("at is not null and to is not null")
    return e.unionByName(e.select(F.col("to").alias("at"), F.col("at").alias("to"))).distinct()


class _Seen:
    """A growing set of rows as few written pieces: each round writes only what is new, and pieces of like size are merged.

    So a row is rewritten about log2(rounds) times, not once a round, and an anti-join reads a handful of pieces.
    """

    def __init__(self, first: DataFrame):
        self.pieces: list[tuple[int, DataFrame]] = [(1, first)]

    def add(self, new: DataFrame) -> None:
        self.pieces.append((1, new))
        while len(self.pieces) > 4 and self.pieces[-2][0] <= self.pieces[-1][0]:
            (m, older), (n, newer) = self.pieces[-2:]
            self.pieces[-2:] = [(m + n, cut_lineage(older.unionByName(newer)))]

    def all(self) -> DataFrame:
        out = self.pieces[0][1]
        for _, piece in self.pieces[1:]:
            out = out.unionByName(piece)
        return out


def distances(steps: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(seed, id, distance): breadth-first distances of up to ``most`` hops over ``steps(at, to)`` from each seed."""
    start = seeds.select(F.col("id").alias("seed"), "id").filter("id is not null").distinct()
    front = cut_lineage(start.withColumn("distance", F.lit(0)))
    seen = _Seen(front)
    for d in range(1, most + 1):
        reached = front.select("seed", F.col("id").alias("at")).join(steps, "at").select("seed", F.col("to").alias("id")).distinct()
        front = cut_lineage(reached.join(seen.all().select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen.add(front)
    return seen.all()


def subgraph(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, depth: int = 2) -> DataFrame:
    """(seed, src, dst, type): distinct edges on paths of up to ``depth`` edges from each seed, in either direction.

    An edge lies on such a path just if one of its ends is at most ``depth - 1`` hops away, so distances do for paths.
    """
    used = of_types(edges, types or SUBGRAPH_EDGES).select("src", "dst", "type").distinct()
    near = distances(undirected(used), seeds, check_depth(depth) - 1) if depth > 1 else seeds.select(F.col("id").alias("seed"), "id")
    from_src = used.join(near, used["src"] == near["id"]).select("seed", "src", "dst", "type")
    from_dst = used.join(near, used["dst"] == near["id"]).select("seed", "src", "dst", "type")
    return from_src.unionByName(from_dst).distinct()


def shortest_path(edges: DataFrame, source, target, most: int = MOST_HOPS) -> DataFrame:
    """(step, id, edge) of a shortest undirected path over all edge types, each node with the edge that leads to it; no rows where ``most`` hops don't do.

    Among equally short ones it takes at each node the least parent, and the least type of edge to it. The search goes on from the end
    with the smaller frontier and stops where both meet; each node is written once with its parent, so that the path itself is
    at most ``most`` lookups of one row.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    schema = f"step int, id {kind}, edge string"
    if source == target:
        return spark.createDataFrame([(0, source, None)], schema)
    e = edges.select("src", "dst", "type").filter("src is not null and dst is not null")
    steps = e.toDF("at", "id", "type").unionByName(e.select(F.col("dst").alias("at"), F.col("src").alias("id"), "type"))

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.min(F.struct(F.col("at").alias("parent"), "type")).alias("by"))

    levels = {side: [spark.createDataFrame([(x,)], f"id {kind}")] for side, x in (("source", source), ("target", target))}
    sizes = {"source": 1, "target": 1}
    for _ in range(most):
        side = min(sizes, key=lambda x: (sizes[x], x))
        other = "target" if side == "source" else "source"
        own = levels[side]
        known = own[-1].select("id")
        for level in own[-2:-1]:
            # In an undirected graph a neighbour is at most one level back.
            known = known.unionByName(level.select("id"))
        grown = least(own[-1].select(F.col("id").alias("at")).join(steps, "at")).join(known, "id", "left_anti")
        own.append(cut_lineage(grown))
        sizes[side] = own[-1].count()
        if not sizes[side]:
            return spark.createDataFrame([], schema)
        met = own[-1].select("id").join(levels[other][-1].select("id"), "id", "left_semi")
        if not met.isEmpty():
            break
    else:
        return spark.createDataFrame([], schema)
    # From where they met on to the target: the nodes of shortest paths only, with the least of their parents among these.
    toward = [levels["source"][-1].select("id").join(levels["target"][-1].select("id"), "id", "left_semi")]
    for level in levels["target"][-2::-1]:
        ahead = toward[-1].select(F.col("id").alias("at")).join(steps, "at").join(level.select("id"), "id", "left_semi")
        toward.append(cut_lineage(least(ahead)))
    path, at = [], target
    for level in (*toward[:0:-1], *levels["source"][:0:-1]):
        by = level.filter(F.col("id") == F.lit(at)).first()["by"]
        path.append((at, by["type"]))
        at = by["parent"]
    path.append((source, None))
    return spark.createDataFrame([(n, x, t) for n, (x, t) in enumerate(reversed(path))], schema)


def reachable(edges: DataFrame, roots: DataFrame, types: list[str] | None = None, most_rounds: int = 10_000) -> DataFrame:
    """(id): all nodes that the roots reach over the edges, themselves included, however far and through whatever cycles.

    Each round writes its frontier only. It raises where ``most_rounds`` don't do.
    """
    step = of_types(edges, types or REACH_EDGES).select(F.col("src").alias("id"), F.col("dst").alias("to")).filter("id is not null and to is not null").distinct()
    front = cut_lineage(roots.select("id").filter("id is not null").distinct())
    seen = _Seen(front)
    for _ in range(most_rounds):
        front = cut_lineage(front.join(step, "id").select(F.col("to").alias("id")).distinct().join(seen.all(), "id", "left_anti"))
        if front.isEmpty():
            return seen.all()
        seen.add(front)
    raise RuntimeError("reachability has not settled")


def dependent_files(edges: DataFrame, targets: DataFrame, types: tuple[str, ...] = ("IMPORTS", "EXPORTS")) -> DataFrame:
    """(target, id): files that import or re-export from each target, once each."""
    t = targets.select(F.col("id").alias("target")).distinct()
    return of_types(edges, list(types)).join(t, F.col("dst") == F.col("target")).select("target", F.col("src").alias("id")).distinct()


def dependents_closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id): files that depend on the targets, directly or not; the targets themselves aside unless they are in a cycle."""
    back = of_types(edges, ["IMPORTS", "EXPORTS"]).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("IMPORTS").alias("type"))
    first = back.join(targets.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("id"))
    return reachable(back, first, ["IMPORTS"])


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == name)


def who_calls(nodes: DataFrame, edges: DataFrame, repo: str, name: str) -> DataFrame:
    """(id, name, path): direct callers of the nodes of that name."""
    named = nodes.filter((F.col("repo_id") == repo) & (F.col("name") == name)).select(F.col("id").alias("dst"))
    return of_types(edges, ["CALLS"]).join(named, "dst").select(F.col("src").alias("id")).distinct().join(nodes.select("id", "name", "path"), "id")


def files_depending_on(nodes: DataFrame, edges: DataFrame, repo: str, dependency: str) -> DataFrame:
    """(id, path): files that import the dependency of that name."""
    named = nodes.filter((F.col("repo_id") == repo) & (F.col("label") == "Dependency") & (F.col("name") == dependency)).select(F.col("id").alias("dst"))
    files = nodes.filter("label = 'File'").select(F.col("id").alias("src"), "path")
    return of_types(edges, ["IMPORTS"]).join(named, "dst").join(files, "src").select(F.col("src").alias("id"), "path").distinct()


def unused_components(nodes: DataFrame, edges: DataFrame, repo: str) -> DataFrame:
    """(id, name, path): components that nothing uses and that handle no route."""
    routes = nodes.filter("label = 'Route'").select(F.col("id").alias("dst"))
    handlers = of_types(edges, ["HANDLES"]).join(routes, "dst").select(F.col("src").alias("id"))
    used = of_types(edges, ["USES_COMPONENT"]).select(F.col("dst").alias("id"))
    return (
        nodes.filter((F.col("repo_id") == repo) & (F.col("label") == "Component"))
        .join(used, "id", "left_anti")
        .join(handlers, "id", "left_anti")
        .select("id", "name", "path")
    )


def context_flow(nodes: DataFrame, edges: DataFrame, repo: str) -> DataFrame:
    """(provider, context, consumers): sorted distinct names of the consumers of each provided context.

    Consumers are gathered once a context, before its providers are joined to it.
    """
    ctx = nodes.filter((F.col("repo_id") == repo) & (F.col("label") == "Context")).select(F.col("id").alias("ctx"), F.col("name").alias("context"))
    name = nodes.select("id", "name")
    gives = of_types(edges, ["PROVIDES_CONTEXT"]).select("src", F.col("dst").alias("ctx")).join(name.toDF("src", "provider"), "src").select("ctx", "provider").distinct()
    takes = of_types(edges, ["CONSUMES_CONTEXT"]).select("src", F.col("dst").alias("ctx")).join(name.toDF("src", "consumer"), "src")
    heard = takes.groupBy("ctx").agg(F.collect_set("consumer").alias("consumers"))
    # Contexts of one name that one provider serves are one row.
    flows = ctx.join(gives, "ctx").join(heard, "ctx").groupBy("provider", "context").agg(F.flatten(F.collect_list("consumers")).alias("all"))
    return flows.select("provider", "context", F.array_sort(F.array_distinct("all")).alias("consumers"))


def routes(nodes: DataFrame, edges: DataFrame, repo: str) -> DataFrame:
    """(id, route, path, handlers): each route with the sorted names of what handles it, none if nothing does."""
    r = nodes.filter((F.col("repo_id") == repo) & (F.col("label") == "Route")).select("id", F.col("name").alias("route"), "path")
    by = of_types(edges, ["HANDLES"]).select("src", F.col("dst").alias("id")).join(nodes.select(F.col("id").alias("src"), F.col("name").alias("handler")), "src")
    return r.join(by.select("id", "handler"), "id", "left").groupBy("id", "route", "path").agg(F.sort_array(F.collect_list("handler")).alias("handlers"))


def symbol_detail(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def expand_seeds(edges: DataFrame, seeds: DataFrame, top: int = 10, hops: int = 2, decay: float = 0.6, per_seed: int = 20, types: list[str] | None = None) -> DataFrame:
    """(node, score, seed, distance): neighbours of the best seeds; ``seeds`` has (id, score, rank).

    The first ``top`` seeds in their order are followed at once, not one after the other.
    """
    from thicket.operators.fusion import expansion_scores

    first = seeds.filter(F.col("rank") <= top)
    steps = undirected(of_types(edges, types or EXPANSION_EDGES))
    reached = distances(steps, first.select("id"), hops)
    own = first.groupBy(F.col("id").alias("seed")).agg(F.max("score").alias("seed_score"), F.min("rank").alias("seed_order"))
    return expansion_scores(reached.join(own, "seed").select("seed", "seed_score", "seed_order", F.col("id").alias("node"), "distance"), decay, per_seed)


def file_tree(files: DataFrame) -> DataFrame:
    """(repo_id, path, parent, name, is_file): all files and the folders above them, each once; null paths are left out."""
    from thicket.functions.paths import ancestor_dirs, basename, dirname

    f = files.filter("rel_path is not null").select("repo_id", F.col("rel_path").alias("path"))
    dirs = f.select("repo_id", F.explode(ancestor_dirs(F.col("path"))).alias("path")).withColumn("is_file", F.lit(False))
    return (
        dirs.unionByName(f.withColumn("is_file", F.lit(True)))
        .distinct()
        .select("repo_id", "path", dirname(F.col("path")).alias("parent"), basename(F.col("path")).alias("name"), "is_file")
    )


def call_edges(refs: DataFrame) -> DataFrame:
    """(src, dst, count, line): call references reduced to one edge for each pair, with the first line; no edges to oneself."""
    return refs.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("count"), F.min("line").alias("line"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (repo_id, src, type, dst) and, for exports, name; the last by ``seq`` keeps its properties."""
    w = Window.partitionBy("repo_id", "src", "type", "dst", F.when(F.col("type") == "EXPORTS", F.col("name"))).orderBy(F.desc("seq"))
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rekey_routes(nodes: DataFrame, edges: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after files were renamed: a route of the old path that nothing contains any more takes over the edges of its
    duplicate at the new path, which goes; ``renames`` has (old_path, new_path) within one repository."""
    r = nodes.filter("label = 'Route'")
    old = r.join(renames, r["path"] == renames["old_path"]).join(of_types(edges, ["CONTAINS"]).select(F.col("dst").alias("id")), "id", "left_anti")
    pairs = old.select(F.col("id").alias("old_id"), "name", "new_path").join(r.select(F.col("id").alias("new_id"), "name", F.col("path").alias("new_path")), ["name", "new_path"])
    move = pairs.select("old_id", "new_id", "new_path")
    kept = nodes.join(move.select(F.col("new_id").alias("id")), "id", "left_anti").join(move.select(F.col("old_id").alias("id"), "new_path"), "id", "left")
    kept = kept.withColumn("path", F.coalesce("new_path", "path")).drop("new_path").select(*nodes.columns)
    moved = edges.join(move.select(F.col("new_id").alias("dst"), "old_id"), "dst", "left").withColumn("dst", F.coalesce("old_id", "dst")).drop("old_id")
    return kept, moved.select(*edges.columns)


#: Named queries: description, the parameters that they need, and the function.
TEMPLATES: dict[str, tuple[str, tuple[str, ...], Callable]] = {
    "who_calls": ("Direct callers of a symbol by name", ("repo", "name"), who_calls),
    "files_depending_on": ("Files that import a dependency", ("repo", "dependency"), files_depending_on),
    "unused_components": ("Components that nothing uses", ("repo",), unused_components),
    "context_flow": ("Providers and consumers of contexts", ("repo",), context_flow),
    "routes": ("Routes and their handlers", ("repo",), routes),
}


def run_template(nodes: DataFrame, edges: DataFrame, name: str, params: dict[str, str]) -> DataFrame:
    """A named query; superfluous parameters are dropped, missing or unknown ones raise ValidationError."""
    if name not in TEMPLATES:
        raise ValidationError(f"unknown template {name!r}; available: {', '.join(TEMPLATES)}")
    _, needed, run = TEMPLATES[name]
    missing = [p for p in needed if not isinstance(params.get(p), str) or not params[p]]
    if missing:
        raise ValidationError(f"template {name!r} needs {', '.join(missing)}")
    return run(nodes, edges, **{p: params[p] for p in needed})


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame([], "id string, repo_id string, label string, name string, path string"),
        spark.createDataFrame([], "repo_id string, src string, dst string, type string"),
    )
