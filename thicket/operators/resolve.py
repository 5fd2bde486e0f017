"""Resolution of imports, exports and references as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.paths import dirname, normalized
from thicket.session import cut_lineage

# Suffixes in the order in which they are tried, and the built-in modules.
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
BUILTINS = "assert buffer child_process cluster crypto dns events fs http https net os path process stream url util zlib".split()


def package_name(specifier):
    """The package of a specifier: two segments of scoped ones, ``node:x`` as it is."""
    return F.when(specifier.startswith("node:"), specifier).when(specifier.startswith("@"), F.regexp_extract(specifier, "^(@[^/]+/[^/]+|@[^/]+)", 1)).otherwise(
        F.substring_index(specifier, "/", 1)
    )


def specifier_class(specifier):
    return F.when(specifier.startswith("."), "relative").when(specifier.startswith("node:") | specifier.isin(BUILTINS), "builtin").otherwise("package")


def resolve_modules(imports: DataFrame, paths: DataFrame, aliases: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``imports(repo_id, path, specifier)`` with ``target``: the file of (repo_id, path) that each comes to, or null.

    A relative specifier is tried as it is, then with each suffix, then as a folder's index; else the prefixes of the aliases are
    tried in their order. All candidates are joined at once and the first that exists is kept.
    """
    i = imports.select("repo_id", "path", "specifier").filter("specifier is not null").distinct()
    folder = dirname(F.col("path"))
    base = F.when(folder == "", F.col("specifier")).otherwise(F.concat(folder, F.lit("/"), F.col("specifier")))
    roots = i.filter(F.col("specifier").startswith(".")).withColumn("root", normalized(base)).withColumn("alias", F.lit(0))
    for n, (prefix, targets) in enumerate(aliases or []):
        stem = prefix.removesuffix("*")
        for m, target in enumerate(targets):
            into = F.concat(F.lit(target.removesuffix("*")), F.expr(f"substring(specifier, {len(stem) + 1})"))
            hit = i.filter(F.col("specifier").startswith(stem) if prefix.endswith("*") else F.col("specifier") == prefix)
            roots = roots.unionByName(hit.withColumn("root", normalized(into)).withColumn("alias", F.lit(1 + n * 100 + m)))
    endings = ["", *SUFFIXES, *[f"/index{s}" for s in SUFFIXES]]
    tried = roots.select("*", F.posexplode(F.array(*[F.concat("root", F.lit(e)) for e in endings])).alias("n", "candidate"))
    there = paths.select("repo_id", F.col("path").alias("candidate")).distinct()
    best = tried.join(there, ["repo_id", "candidate"]).groupBy("repo_id", "path", "specifier").agg(F.min_by("candidate", F.struct("alias", "n")).alias("target"))
    return i.join(best, ["repo_id", "path", "specifier"], "left")


def resolve_exports(wanted: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, symbol_id): the symbol that a file's exported name leads to, or null.

    ``wanted`` has (file, name), ``exports`` (file, ord, name, local, kind, target), kind one of named, default, reExport and star,
    ``symbols`` (file, qualified, id). An explicit export wins over stars and the first in order over later ones; a local one
    without symbol gets the id ``file#local``. Names are followed one file a round, however long
    the chain; a file is visited once for a name, so cycles end.
    """
    start = wanted.select("file", "name").distinct()
    front = start.select(F.col("file").alias("from"), F.col("name").alias("as"), "file", "name", F.lit("").alias("via"))
    seen = cut_lineage(front.select("from", "as", "file", "name").distinct())
    found = None
    local = symbols.select(F.col("file"), F.col("qualified").alias("local"), F.col("id").alias("symbol")).dropDuplicates(["file", "local"])
    while True:
        explicit = front.join(exports.filter("kind <> 'star'"), ["file", "name"])
        first = Window.partitionBy("from", "as", "file", "name").orderBy("ord")
        explicit = explicit.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
        here = explicit.filter("kind <> 'reExport'").join(local, ["file", "local"], "left").select(
            "from", "as", F.coalesce("symbol", F.concat("file", F.lit("#"), F.col("local"))).alias("symbol_id"), F.col("via")
        )
        on = explicit.filter("kind = 'reExport' and target is not null").select("from", "as", F.col("target").alias("file"), F.col("local").alias("name"), "via")
        rest = front.join(explicit.select("from", "as", "file", "name"), ["from", "as", "file", "name"], "left_anti")
        stars = rest.join(exports.filter("kind = 'star' and target is not null").select("file", "ord", "target"), "file").select(
            "from", "as", F.col("target").alias("file"), "name", F.concat("via", F.lpad(F.col("ord").cast("string"), 6, "0")).alias("via")
        )
        found = here if found is None else found.unionByName(here)
        found = cut_lineage(found)
        front = cut_lineage(
            on.unionByName(stars).groupBy("from", "as", "file", "name").agg(F.min("via").alias("via")).join(seen, ["from", "as", "file", "name"], "left_anti")
        )
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front.select("from", "as", "file", "name")))
    best = found.groupBy("from", "as").agg(F.min_by("symbol_id", F.struct("via", "symbol_id")).alias("symbol_id"))
    return start.join(best.toDF("file", "name", "symbol_id"), ["file", "name"], "left")


def resolve_references(refs: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """``refs`` with (resolved, outcome): 'resolved', 'unresolved' within the repository, or 'external'.

    ``refs`` has (file, scope, name), scope the qualified name around it; ``symbols`` (file, qualified, id); ``bindings`` (file,
    local, imported, target_file, symbol_id), target_file null for packages. In turn: ``this.x`` in the enclosing class; the nearest
    scope outward that has the name, unless its first part is an import; the import itself, by its second part for ``*``.
    """
    r = refs.withColumn("ref", F.monotonically_increasing_id()) if "ref" not in refs.columns else refs
    first = F.substring_index("name", ".", 1)
    scopes = F.transform(F.sequence(F.size(F.split("scope", "\\.")), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(F.split("scope", "\\."), F.lit(1), n), "."))
    named = F.when(first == "this", F.substring_index(F.expr("substring(name, 6)"), ".", 1)).otherwise(F.col("name"))
    tried = r.select("ref", "file", first.alias("first"), named.alias("named"), F.posexplode(scopes).alias("up", "around"))
    tried = tried.withColumn("qualified", F.when(F.col("around") == "", F.col("named")).otherwise(F.concat("around", F.lit("."), F.col("named"))))
    b = bindings.select("file", F.col("local").alias("first"), "imported", "target_file", "symbol_id", F.lit(True).alias("bound")).dropDuplicates(["file", "first"])
    near = (
        tried.join(b.select("file", "first", "bound"), ["file", "first"], "left")
        .filter("bound is null")
        .join(symbols.select("file", "qualified", F.col("id").alias("near")), ["file", "qualified"])
        .groupBy("ref")
        .agg(F.min_by("near", F.struct("up", "near")).alias("near"))
    )
    out = r.withColumn("first", first).join(near, "ref", "left").join(b, ["file", "first"], "left")
    starred = F.when((F.col("imported") == "*") & F.col("target_file").isNotNull(), F.concat("target_file", F.lit("#"), F.split("name", "\\.")[1]))
    resolved = F.coalesce("near", F.when(F.col("imported") == "*", starred).otherwise(F.col("symbol_id")))
    outcome = F.when(resolved.isNotNull(), "resolved").when(F.col("bound") & F.col("target_file").isNull(), "external").otherwise("unresolved")
    return out.withColumn("resolved", resolved).withColumn("outcome", outcome).select(*refs.columns, "resolved", "outcome")
