"""Declared and used dependencies of repositories: their graph and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.analysis import dependency_mismatches
from thicket.operators.resolve import package_name
from thicket.sources.discover import config_files, manifests


def dependency_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``files(repo_id, path, source)``: packages, what they declare, and configuration files.

    Nodes have (id, repo_id, label, name, path, version, dep_kind, version_range, config_kind, declared), edges (repo_id, src, dst, type,
    version_range). A dependency is one node a repository, with the id that observed imports use, so both meet there; where several
    manifests declare it, the last by path tells its kind and range on the node, while each package's edge keeps its own.
    """
    declared = manifests(files)
    none = F.lit(None).cast("string")

    def node(df: DataFrame, label: str, **columns) -> DataFrame:
        given = {c: columns.get(c, none) for c in ("id", "name", "path", "version", "dep_kind", "version_range", "config_kind")}
        return df.select(given["id"].alias("id"), "repo_id", F.lit(label).alias("label"), *[given[c].alias(c) for c in list(given)[1:]], columns.get("declared", F.lit(None).cast("boolean")).alias("declared"))

    package = F.concat("repo_id", F.lit("::package::"), "package_path")
    dep = F.concat("repo_id", F.lit("::dep::"), "name")
    packages = node(packages_of(files), "Package", id=package, name=F.col("package"), path=F.col("package_path"), version=F.col("version"))
    last = Window.partitionBy("repo_id", "name").orderBy(F.col("package_path").desc(), F.col("kind").desc())
    one = declared.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    deps = node(one, "Dependency", id=dep, name=F.col("name"), dep_kind=F.col("kind"), version_range=F.col("version_range"), declared=F.lit(True))
    configs = config_files(files, declared.select("repo_id", F.col("package_path").alias("folder")).distinct())
    configs = node(configs, "Configuration", id=F.concat("repo_id", F.lit(":"), "path"), path=F.col("path"), config_kind=F.col("kind"))
    by_pair = declared.groupBy("repo_id", package.alias("src"), dep.alias("dst")).agg(F.max_by("version_range", "kind").alias("version_range"))
    return packages.unionByName(deps).unionByName(configs), by_pair.select("repo_id", "src", "dst", F.lit("DEPENDS_ON").alias("type"), "version_range")


def packages_of(files: DataFrame) -> DataFrame:
    """(repo_id, package_path, package, version) of each manifest, those without dependencies included."""
    m = files.filter(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("m", F.from_json("source", "struct<name: string, version: string>")).filter(F.get_json_object("source", "$").startswith("{"))
    folder = F.when(F.col("path") == "package.json", ".").otherwise(F.regexp_replace("path", "/package.json$", ""))
    kept = m.select("repo_id", folder.alias("package_path"), F.coalesce("m.name", folder).alias("package"), F.col("m.version").alias("version"))
    root = kept.filter("package_path = '.'").select("repo_id").distinct()
    return kept.join(root, "repo_id", "left_semi").dropDuplicates(["repo_id", "package_path"])


def dependency_report(files: DataFrame, imports: DataFrame) -> dict[str, DataFrame]:
    """The five lists: packages, dependencies, edges, configurations and mismatches.

    ``imports`` has (repo_id, path, source, source_class) as parsed. Dependencies are those declared or imported, with how many files
    import each. Repositories without any manifest have imports only, which then are all phantoms.
    """
    nodes, edges = dependency_graph(files)
    used = imports.filter("source_class <> 'relative'").select("repo_id", "path", package_name(F.col("source")).alias("name"))
    counted = used.distinct().groupBy("repo_id", "name").agg(F.count("*").alias("import_count"))
    declared = nodes.filter("label = 'Dependency'").select("repo_id", "name", "dep_kind", "version_range", "declared")
    dependencies = declared.join(counted, ["repo_id", "name"], "full_outer").select(
        F.concat("repo_id", F.lit("::dep::"), "name").alias("id"), "repo_id", "name", "dep_kind", F.coalesce("declared", F.lit(False)).alias("declared"), "version_range", F.coalesce("import_count", F.lit(0)).alias("import_count")
    )
    missing = dependency_mismatches(declared, used, ["repo_id"]).join(declared.select("repo_id", "name", "dep_kind"), ["repo_id", "name"], "left")
    return {
        "packages": nodes.filter("label = 'Package'").select("id", "repo_id", "path", "name", "version"),
        "dependencies": dependencies,
        "edges": edges.select("repo_id", "src", "dst", "version_range"),
        "configurations": nodes.filter("label = 'Configuration'").select("repo_id", "path", "config_kind"),
        "mismatches": missing.select("repo_id", "name", "kind", "dep_kind", "import_count"),
    }
