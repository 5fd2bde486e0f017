"""Queries of the graph operators over the adapted star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import analysis, graph
from thicket.sources.adapters import GRAPH_SQL, REPO, seeds
from thicket.sources.adapters import graph as read

QUERIES: dict = {}
SQL: dict[str, str] = {}
SEEDS = "seeds AS (SELECT id FROM nodes WHERE label <> 'File' AND TRY_CAST(substr(id, 2) AS BIGINT) % 100 = 0)"
ENTRIES = ["n0.ts", "n7.ts"]
ENTRY_SQL = "('n0.ts', 'n7.ts')"


def query(sql: str | None = None, recursive: bool = True, prelude: str = ""):
    """Registers a function of (nodes, edges) as a query, with its SQL over the tables nodes and edges."""

    def register(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(*read(spark, folder))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {GRAPH_SQL}{prelude}{sql}"
        return f

    return register


def _trails(types: str, depth: int, upward: bool) -> str:
    a, b = ("dst", "src") if upward else ("src", "dst")
    return f""", {SEEDS}, step AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE type = '{types}'),
walk(seed, here, depth, used) AS (SELECT id, id, 0, []::VARCHAR[] FROM seeds
    UNION ALL SELECT seed, b, depth + 1, list_append(used, a || '>' || b) FROM walk JOIN step ON here = a WHERE depth < {depth} AND NOT list_contains(used, a || '>' || b))
"""


@query(_trails("CALLS", 2, True) + "SELECT DISTINCT seed, here AS id, name, label AS kind, path, depth FROM walk JOIN nodes ON here = id WHERE depth > 0")
def callers_depth(nodes, edges):
    return graph.summaries(graph.callers(edges, seeds(nodes), 2), nodes).select("seed", "id", "name", "kind", "path", "depth")


@query(_trails("CALLS", 3, False) + "SELECT DISTINCT seed, here AS id, name, label AS kind, path, depth FROM walk JOIN nodes ON here = id WHERE depth > 0")
def callees_depth(nodes, edges):
    return graph.summaries(graph.callees(edges, seeds(nodes), 3), nodes).select("seed", "id", "name", "kind", "path", "depth")


@query(_trails("USES_COMPONENT", 3, True) + "SELECT DISTINCT seed, here AS id, depth FROM walk JOIN nodes ON here = id WHERE depth > 0 AND label = 'Component'")
def component_usage_depth(nodes, edges):
    return graph.component_usage(nodes, edges, seeds(nodes), 3)


@query(
    f", {SEEDS} SELECT s.id AS seed, 'outgoing' AS direction, e.type AS edge, n.id, n.name, n.label AS kind, n.path FROM seeds s JOIN edges e ON e.src = s.id JOIN nodes n ON n.id = e.dst "
    "UNION ALL SELECT s.id, 'incoming', e.type, n.id, n.name, n.label, n.path FROM seeds s JOIN edges e ON e.dst = s.id JOIN nodes n ON n.id = e.src"
)
def neighbors(nodes, edges):
    return graph.neighbors(nodes, edges, seeds(nodes)).select("seed", "direction", "edge", "id", "name", "kind", "path")


@query(f", {SEEDS} SELECT n.* FROM nodes n JOIN seeds USING (id)")
def symbol_detail(nodes, edges):
    return graph.symbol_detail(nodes, seeds(nodes)).select(*nodes.columns)


@query("SELECT * FROM nodes WHERE name = 'Customer#000000042'")
def find_by_name(nodes, edges):
    return graph.find_by_name(nodes, "Customer#000000042")


@query("SELECT DISTINCT path FROM nodes WHERE label = 'File'")
def file_paths(nodes, edges):
    return nodes.filter("label = 'File'").select("path").distinct()


_SUB = "('CALLS', 'USES_COMPONENT', 'USES_HOOK', 'IMPORTS', 'CONTAINS')"


@query(
    f""", {SEEDS}, used AS (SELECT DISTINCT src, dst, type FROM edges WHERE type IN {_SUB}), step AS (SELECT src AS a, dst AS b FROM used UNION SELECT dst, src FROM used),
near AS (SELECT id AS seed, id FROM seeds UNION SELECT s.id, b FROM seeds s JOIN step ON a = s.id)
SELECT DISTINCT seed, src, dst, type FROM used JOIN near ON id = src OR id = dst"""
)
def subgraph_edges(nodes, edges):
    return graph.subgraph(edges, seeds(nodes), None, 2)


@query(
    """, step AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk(id, distance) AS (SELECT 'c0', 0 UNION SELECT b, distance + 1 FROM walk JOIN step ON id = a WHERE distance < 4),
d AS (SELECT id, min(distance) AS distance FROM walk GROUP BY 1), back(step, id, edge) AS (
    SELECT distance, id, NULL::VARCHAR FROM d WHERE id = 'c77'
    UNION ALL SELECT q.step - 1, q.prev, q.type FROM (SELECT b.step, d.id AS prev, e.type, row_number() OVER (PARTITION BY b.step ORDER BY d.id, e.type) AS n
        FROM back b JOIN (SELECT src AS x, dst AS y, type FROM edges UNION SELECT dst, src, type FROM edges) e ON e.x = b.id JOIN d ON d.id = e.y AND d.distance = b.step - 1 WHERE b.step > 0) q WHERE q.n = 1)
SELECT b.step, b.id, (SELECT n.edge FROM back n WHERE n.step = b.step - 1) AS edge FROM back b"""
)
def shortest_path(nodes, edges):
    return graph.shortest_path(edges, "c0", "c77")


@query("SELECT DISTINCT dst AS target, src AS id FROM edges WHERE type IN ('IMPORTS', 'EXPORTS')")
def dependent_files(nodes, edges):
    return graph.dependent_files(edges, nodes.filter("label = 'File'").select("id"))


@query(", walk(id) AS (SELECT src FROM edges WHERE type = 'IMPORTS' AND dst IN ('shop:n9.ts', 'shop:n12.ts', 'shop:n23.ts') UNION SELECT src FROM walk JOIN edges ON dst = id AND type = 'IMPORTS') SELECT id FROM walk")
def dependents_closure(nodes, edges):
    return graph.dependents_closure(edges, nodes.filter("id in ('shop:n9.ts', 'shop:n12.ts', 'shop:n23.ts')").select("id"))


@query("SELECT DISTINCT a.id, a.name, a.path FROM nodes t JOIN edges e ON e.dst = t.id AND e.type = 'CALLS' JOIN nodes a ON a.id = e.src WHERE t.name = 'Customer#000000042'")
def who_calls(nodes, edges):
    return graph.run_template(nodes, edges, "who_calls", {"repo": REPO, "name": "Customer#000000042"})


@query(
    "SELECT id, name, path FROM nodes c WHERE label = 'Component' AND NOT EXISTS (SELECT 1 FROM edges WHERE dst = c.id AND type = 'USES_COMPONENT') "
    "AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes r ON r.id = e.dst AND r.label = 'Route' WHERE e.src = c.id AND e.type = 'HANDLES')"
)
def unused_components(nodes, edges):
    return graph.run_template(nodes, edges, "unused_components", {"repo": REPO})


@query(
    "SELECT p.name AS provider, c.name AS context, list_sort(list(DISTINCT u.name)) AS consumers FROM nodes c JOIN edges g ON g.dst = c.id AND g.type = 'PROVIDES_CONTEXT' JOIN nodes p ON p.id = g.src "
    "JOIN edges t ON t.dst = c.id AND t.type = 'CONSUMES_CONTEXT' JOIN nodes u ON u.id = t.src WHERE c.label = 'Context' GROUP BY 1, 2"
)
def context_flow(nodes, edges):
    return graph.run_template(nodes, edges, "context_flow", {"repo": REPO})


@query(
    "SELECT r.id, r.name AS route, r.path, coalesce(list_sort(list(h.name) FILTER (h.name IS NOT NULL)), []) AS handlers FROM nodes r LEFT JOIN edges e ON e.dst = r.id AND e.type = 'HANDLES' LEFT JOIN nodes h ON h.id = e.src "
    "WHERE r.label = 'Route' GROUP BY 1, 2, 3"
)
def routes_handlers(nodes, edges):
    return graph.run_template(nodes, edges, "routes", {"repo": REPO})


@query(
    """, used AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('CALLS', 'USES_COMPONENT', 'USES_HOOK', 'PROVIDES_CONTEXT', 'CONSUMES_CONTEXT', 'IMPORTS')),
step AS (SELECT src AS a, dst AS b FROM used UNION SELECT dst, src FROM used),
s AS (SELECT id AS seed, TRY_CAST(substr(id, 2) AS BIGINT) // 100 + 1 AS rank, 1.0::DOUBLE / (TRY_CAST(substr(id, 2) AS BIGINT) // 100 + 1) AS score FROM nodes WHERE label <> 'File' AND TRY_CAST(substr(id, 2) AS BIGINT) % 100 = 0 AND TRY_CAST(substr(id, 2) AS BIGINT) // 100 < 10),
w AS (SELECT seed, score, rank, b AS node, 1 AS distance FROM s JOIN step ON a = seed UNION SELECT seed, score, rank, t.b, 2 FROM s JOIN step f ON f.a = seed JOIN step t ON t.a = f.b),
d AS (SELECT seed, score, rank, node, min(distance) AS distance FROM w WHERE node <> seed GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS n FROM d),
b AS (SELECT node, score * power(0.6::DOUBLE, distance) AS score, seed, distance, row_number() OVER (PARTITION BY node ORDER BY score * power(0.6::DOUBLE, distance) DESC, rank) AS m FROM k WHERE n <= 20)
SELECT node, round(score, 6) AS score, seed, distance FROM b WHERE m = 1"""
)
def expand_seeds(nodes, edges):
    n = F.substring("id", 2, 20).try_cast("long") / 100
    ranked = seeds(nodes).withColumn("rank", (n + 1).cast("int")).withColumn("score", 1 / F.col("rank"))
    return graph.expand_seeds(edges, ranked).select("node", F.round("score", 6).alias("score"), "seed", "distance")


_REACH = "type IN ('CALLS', 'IMPORTS', 'USES_COMPONENT', 'USES_HOOK')"


@query(f", {SEEDS}, walk(id) AS (SELECT id FROM seeds UNION SELECT dst FROM walk JOIN edges ON src = id AND {_REACH}) SELECT id FROM walk")
def reachability(nodes, edges):
    return graph.reachable(edges, seeds(nodes))


_ROOTS = f""", roots AS (SELECT id FROM nodes WHERE label = 'Route' OR (exported AND path IN {ENTRY_SQL})
    UNION SELECT s.id FROM nodes f JOIN edges i ON i.src = f.id AND i.type = 'IMPORTS' JOIN nodes t ON t.id = i.dst AND t.label = 'File' JOIN edges d ON d.src = t.id AND d.type = 'DEFINES' JOIN nodes s ON s.id = d.dst AND s.exported
        WHERE f.label = 'File' AND f.path IN {ENTRY_SQL}
    UNION SELECT e.src FROM edges e JOIN nodes r ON r.id = e.dst AND r.label = 'Route' WHERE e.type = 'HANDLES'),
walk(id) AS (SELECT id FROM roots UNION SELECT dst FROM walk JOIN edges ON src = id AND {_REACH}), dynamic AS (SELECT DISTINCT dst AS id FROM edges WHERE type = 'IMPORTS' AND kind = 'dynamic')
"""


@query(_ROOTS + "SELECT id FROM roots")
def dead_code_roots(nodes, edges):
    return analysis.dead_code_roots(nodes, edges, ENTRIES)


@query(
    _ROOTS + "SELECT n.id, n.name, n.label AS kind, n.path, CASE WHEN d.id IS NOT NULL THEN 'possibly-used' ELSE 'dead' END AS confidence FROM nodes n LEFT JOIN dynamic d ON d.id = n.repo_id || ':' || n.path "
    "WHERE n.label IN ('Function', 'Component', 'Hook') AND n.id NOT IN (SELECT id FROM walk)"
)
def dead_symbols(nodes, edges):
    return analysis.dead_symbols(nodes, edges, analysis.dead_code_roots(nodes, edges, ENTRIES))


@query(
    _ROOTS + "SELECT f.id, f.path, CASE WHEN f.id IN (SELECT id FROM dynamic) THEN 'possibly-used' ELSE 'dead' END AS confidence FROM nodes f JOIN (SELECT e.src, count(w.id) AS hits FROM edges e JOIN nodes s ON s.id = e.dst AND s.label IN ('Function', 'Component', 'Hook') "
    f"LEFT JOIN walk w ON w.id = e.dst WHERE e.type IN ('DEFINES', 'DECLARES') GROUP BY 1) h ON h.src = f.id AND h.hits = 0 WHERE f.label = 'File' AND f.path NOT IN {ENTRY_SQL} AND f.id NOT IN (SELECT id FROM walk)"
)
def dead_files(nodes, edges):
    return analysis.dead_files(nodes, edges, analysis.dead_code_roots(nodes, edges, ENTRIES), ENTRIES)


def call_edge_agg(spark: SparkSession, folder: str) -> DataFrame:
    from thicket.sources.tables import table

    refs = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.call_edges(refs.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("line")))


QUERIES["call_edge_agg"] = call_edge_agg
SQL["call_edge_agg"] = "SELECT o_custkey AS src, l_suppkey AS dst, count(*) AS count, min(l_linenumber) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey GROUP BY 1, 2"


def dependency_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as what is declared, customers of orders as what is imported: the keys of one that the other lacks."""
    from thicket.sources.tables import table

    declared = table(spark, folder, "part").select(F.concat(F.lit("k"), F.col("p_partkey")).alias("name"))
    imports = table(spark, folder, "orders").select(F.concat(F.lit("k"), F.col("o_custkey")).alias("name"))
    return analysis.dependency_mismatches(declared, imports)


QUERIES["dependency_mismatches"] = dependency_mismatches
SQL["dependency_mismatches"] = """WITH d AS (SELECT DISTINCT 'k' || p_partkey AS name FROM part), i AS (SELECT 'k' || o_custkey AS name, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(d.name, i.name) AS name, CASE WHEN d.name IS NULL THEN 'phantom' ELSE 'unused' END AS kind, coalesce(i.n, 0) AS import_count FROM d FULL JOIN i ON d.name = i.name WHERE d.name IS NULL OR i.name IS NULL"""


def files_depending_on(spark: SparkSession, folder: str) -> DataFrame:
    """Files (orders) that import a dependency (the part with key 7)."""
    from thicket.sources.tables import table

    orders = table(spark, folder, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.lit(REPO).alias("repo_id"), F.lit("File").alias("label"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("o"), F.col("o_orderkey"), F.lit(".ts")).alias("path"))
    parts = table(spark, folder, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.lit(REPO).alias("repo_id"), F.lit("Dependency").alias("label"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("name"), F.lit("").alias("path"))
    edges = table(spark, folder, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.lit("IMPORTS").alias("type"))
    return graph.run_template(orders.unionByName(parts), edges, "files_depending_on", {"repo": REPO, "dependency": "part-7"})


QUERIES["files_depending_on"] = files_depending_on
SQL["files_depending_on"] = "SELECT DISTINCT 'o' || l_orderkey AS id, 'o' || l_orderkey || '.ts' AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 7"
