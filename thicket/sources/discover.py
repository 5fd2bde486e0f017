"""Source trees, manifests and configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.ids import content_hash
from thicket.functions.paths import glob_pattern

# Suffixes of sources, folders that are ignored, sections of a manifest and names of configuration files.
SOURCE_SUFFIXES = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"]
IGNORED = ["**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.next/**", "**/.turbo/**"]
SECTIONS = {"dependencies": "prod", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
CONFIGS = {
    "tsconfig": ["tsconfig.json"],
    "vite": ["vite.config.ts", "vite.config.js", "vite.config.mjs"],
    "next": ["next.config.js", "next.config.mjs", "next.config.ts"],
    "webpack": ["webpack.config.js", "webpack.config.ts", "webpack.config.cjs"],
    "rollup": ["rollup.config.js", "rollup.config.mjs", "rollup.config.ts"],
    "eslint": [".eslintrc.json", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc", "eslint.config.js", "eslint.config.mjs", "eslint.config.ts"],
    "prettier": [".prettierrc", ".prettierrc.json", ".prettierrc.js", "prettier.config.js", "prettier.config.mjs"],
}


def ignored(path, globs: list[str] | None = None):
    """Whether a relative path, or the folder of that name, matches an ignore glob."""
    patterns = "|".join(glob_pattern(g) for g in [*IGNORED, *(globs or [])])
    return path.rlike(patterns) | F.concat(path, F.lit("/")).rlike(patterns)


def discover(spark: SparkSession, root: str, suffixes: list[str] | None = None, globs: list[str] | None = None) -> DataFrame:
    """(path, size, source, hash) of the sources below ``root``.

    Unreadable files are skipped by the reader, and so are names that start with '.' or '_', which Spark's file sources never list.
    """
    at = F.regexp_replace("path", r"^file:/*", "/")
    base = "/" + root.strip("/") + "/"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
        .select(F.regexp_replace(at, "^" + base.replace(".", r"\."), "").alias("path"), F.col("length").alias("size"), F.col("content").cast("string").alias("source"))
    )
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(suffixes or SOURCE_SUFFIXES)
    return files.filter(wanted & ~ignored(F.col("path"), globs)).withColumn("hash", content_hash(F.col("source")))


def manifests(files: DataFrame) -> DataFrame:
    """(repo_id, package_path, package, version, name, version_range, kind) out of ``files(repo_id, path, source)``.

    Manifests are ``package.json`` at the root and in the folders of one-level workspace globs ``dir/*``. One that can't be read is
    skipped; without a root manifest a repository has none.
    """
    fields = ", ".join(f"{s}: map<string, string>" for s in SECTIONS)
    schema = f"struct<name: string, version: string, workspaces: string, {fields}>"
    m = (
        files.filter(F.col("path").rlike(r"(^|/)package\.json$"))
        .withColumn("m", F.from_json("source", schema))
        .filter("m.name is not null or m.version is not null or m.workspaces is not null or m.dependencies is not null or m.devDependencies is not null")
        .withColumn("package_path", F.when(F.col("path") == "package.json", ".").otherwise(F.regexp_replace("path", "/package.json$", "")))
    )
    globs = F.coalesce(F.from_json("m.workspaces", "array<string>"), F.from_json("m.workspaces", "struct<packages: array<string>>")["packages"], F.array().cast("array<string>"))
    root = m.filter("package_path = '.'").select("repo_id", F.explode_outer(F.array_union(F.array(F.lit(".")), F.transform(F.filter(globs, lambda g: g.endswith("/*")), lambda g: F.regexp_replace(g, r"/\*$", "")))).alias("under"))
    member = m.withColumn("under", F.when(F.col("package_path") == ".", ".").otherwise(F.regexp_replace("package_path", "/[^/]+$", "")))
    kept = member.join(root.distinct(), ["repo_id", "under"], "left_semi")
    sections = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"m.{s}").alias("deps")) for s, kind in SECTIONS.items()])
    return (
        kept.select("repo_id", "package_path", F.coalesce("m.name", "package_path").alias("package"), F.col("m.version").alias("version"), F.explode(sections).alias("s"))
        .select("repo_id", "package_path", "package", "version", F.col("s.kind").alias("kind"), F.explode("s.deps").alias("name", "version_range"))
    )


def config_files(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, kind): known configuration files at the root and in the folders (repo_id, folder) of members."""
    names = F.create_map(*[F.lit(x) for kind, fs in CONFIGS.items() for f in fs for x in (f, kind)])
    f = files.select("repo_id", "path", F.regexp_extract("path", "([^/]*)$", 1).alias("base"), F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("folder")).distinct()
    known = f.withColumn("kind", F.element_at(names, F.col("base"))).filter("kind is not null")
    at_root = known.filter("folder = ''")
    if folders is None:
        return at_root.select("repo_id", "path", "kind")
    return at_root.unionByName(known.join(folders.select("repo_id", "folder").distinct(), ["repo_id", "folder"], "left_semi").select(*known.columns)).select("repo_id", "path", "kind").distinct()
