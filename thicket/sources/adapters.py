"""The star-schema tables read as a code graph, so that each graph operator has data at any scale, and a twin in SQL.

Customers are symbols, their label by key; nations are files that define them; orders are references between symbols, their type by
priority; the nations from which a nation's customers buy most line items are what its file imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.sources.stores import snapshot_folder, stored_graph
from thicket.sources.tables import table

LABELS = ["Component", "Hook", "Context", "Route", "Function"]
REPO = "shop"
#: Nations with which a nation trades most: what its file imports.
PARTNERS = 3

GRAPH_SQL = """
nodes AS (
    SELECT 'c' || c_custkey AS id, 'shop' AS repo_id, ['Component', 'Hook', 'Context', 'Route', 'Function'][CAST(c_custkey % 5 AS INT) + 1] AS label,
        c_name AS name, 'n' || c_nationkey || '.ts' AS path, c_acctbal > 5000 AS exported FROM customer
    UNION ALL SELECT 'shop:n' || n_nationkey || '.ts', 'shop', 'File', n_name, 'n' || n_nationkey || '.ts', false FROM nation
), refs AS (
    SELECT 'c' || o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS t, o_orderpriority AS p, o_orderkey // (SELECT count(*) FROM customer) AS k FROM orders
), edges AS (
    SELECT DISTINCT src, dst, type, NULL::VARCHAR AS kind FROM (
        SELECT src, 'c' || t AS dst, CASE WHEN p = '1-URGENT' THEN 'CALLS' WHEN p = '2-HIGH' AND t % 5 = 0 THEN 'USES_COMPONENT'
            WHEN p = '3-MEDIUM' AND t % 5 = 1 THEN 'USES_HOOK' WHEN p = '4-NOT SPECIFIED' AND t % 5 = 2 AND k % 2 = 0 THEN 'PROVIDES_CONTEXT'
            WHEN p = '4-NOT SPECIFIED' AND t % 5 = 2 THEN 'CONSUMES_CONTEXT' WHEN p = '5-LOW' AND t % 5 = 3 THEN 'HANDLES' END AS type FROM refs)
    WHERE type IS NOT NULL AND src <> dst
    UNION ALL SELECT 'shop:' || path, id, 'DEFINES', NULL FROM nodes WHERE label <> 'File'
    UNION ALL SELECT 'shop:n' || c_nationkey || '.ts', 'shop:n' || s_nationkey || '.ts', 'IMPORTS', CASE WHEN (c_nationkey + s_nationkey) % 5 = 0 THEN 'dynamic' ELSE 'static' END
        FROM (SELECT c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
            WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, s_nationkey) <= 3)
)
"""


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as they are stored, edges in folders by type; written at the first use and again when the tables' files change."""
    tables = [f"{folder}/{name}.parquet" for name in ("customer", "nation", "orders", "lineitem", "supplier")]
    return stored_graph(spark, snapshot_folder(spark, tables, "graph"), lambda: read_graph(spark, folder))


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) out of the tables in ``folder``."""
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    path = F.concat(F.lit("n"), F.col("c_nationkey"), F.lit(".ts"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("c_custkey") % 5 + 1).cast("int"))
    symbols = customer.select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.lit(REPO).alias("repo_id"), label.alias("label"), F.col("c_name").alias("name"), path.alias("path"), (F.col("c_acctbal") > 5000).alias("exported")
    )
    file = F.concat(F.lit("n"), F.col("n_nationkey"), F.lit(".ts"))
    files = table(spark, folder, "nation").select(
        F.concat(F.lit(REPO + ":"), file).alias("id"), F.lit(REPO).alias("repo_id"), F.lit("File").alias("label"), F.col("n_name").alias("name"), file.alias("path"), F.lit(False).alias("exported")
    )
    # One row of one number.
    size = F.broadcast(customer.agg(F.count("*").alias("size")))
    refs = orders.crossJoin(size).select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), (F.col("o_orderkey") % F.col("size")).alias("t"), F.col("o_orderpriority").alias("p"), F.floor(F.col("o_orderkey") / F.col("size")).alias("k")
    )
    rest = F.col("t") % 5
    kind = (
        F.when(F.col("p") == "1-URGENT", "CALLS")
        .when((F.col("p") == "2-HIGH") & (rest == 0), "USES_COMPONENT")
        .when((F.col("p") == "3-MEDIUM") & (rest == 1), "USES_HOOK")
        .when((F.col("p") == "4-NOT SPECIFIED") & (rest == 2) & (F.col("k") % 2 == 0), "PROVIDES_CONTEXT")
        .when((F.col("p") == "4-NOT SPECIFIED") & (rest == 2), "CONSUMES_CONTEXT")
        .when((F.col("p") == "5-LOW") & (rest == 3), "HANDLES")
    )
    none = F.lit(None).cast("string")
    used = refs.select("src", F.concat(F.lit("c"), F.col("t")).alias("dst"), kind.alias("type"), none.alias("kind")).filter("type is not null and src <> dst").distinct()
    defines = symbols.select(F.concat(F.lit(REPO + ":"), F.col("path")).alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("type"), none.alias("kind"))
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    traded = (
        items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .filter("c_nationkey <> s_nationkey")
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.count("*").alias("n"))
    )
    most = Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "s_nationkey")
    abroad = traded.withColumn("place", F.row_number().over(most)).filter(F.col("place") <= PARTNERS)
    imports = abroad.select(
        F.concat(F.lit(REPO + ":n"), F.col("c_nationkey"), F.lit(".ts")).alias("src"), F.concat(F.lit(REPO + ":n"), F.col("s_nationkey"), F.lit(".ts")).alias("dst"), F.lit("IMPORTS").alias("type"),
        F.when((F.col("c_nationkey") + F.col("s_nationkey")) % 5 == 0, "dynamic").otherwise("static").alias("kind"),
    )
    edges = used.unionByName(defines).unionByName(imports)
    return symbols.unionByName(files), edges


def seeds(nodes: DataFrame) -> DataFrame:
    """The stated query set: symbols whose key is divisible by 100."""
    return nodes.filter((F.col("label") != "File") & (F.substring("id", 2, 20).try_cast("long") % 100 == 0)).select("id")
