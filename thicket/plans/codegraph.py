"""The code graph of sources: parsed tables, resolved references, nodes and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.paths import ancestor_dirs, basename, dirname
from thicket.operators.resolve import package_name, resolve_exports, resolve_modules, resolve_references
from thicket.parse.extract import extract
from thicket.session import cut_lineage

PARSED = """repo_id string, path string, error string, file_doc string,
    symbols array<struct<kind:string,name:string,qualified:string,signature:string,doc:string,start_line:int,end_line:int,exported:boolean,meta:map<string,string>>>,
    imports array<struct<source:string,kind:string,source_class:string,line:int,specifiers:array<struct<local:string,imported:string>>>>,
    exports array<struct<ord:int,name:string,local:string,kind:string,source:string,line:int>>,
    refs array<struct<scope:string,name:string,kind:string,line:int>>"""

# Labels of nodes by kind of symbol.
LABELS = {"function": "Function", "method": "Method", "class": "Class", "interface": "Interface", "enum": "Enum", "typeAlias": "TypeAlias", "variable": "Variable", "component": "Component", "hook": "Hook", "context": "Context", "route": "Route"}


def parse_sources(sources: DataFrame, extractors: list[Callable] | None = None) -> DataFrame:
    """One row (repo_id, path, error, symbols, imports, exports, refs) for each of ``sources(repo_id, path, source)``.

    A file that can't be parsed has an error, and what could be read of it; a suffix without parser has an error alone. No file
    fails the job. Extra columns are dropped, null sources left out.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, text in zip(batch["repo_id"], batch["path"], batch["source"]):
                try:
                    r = extract(path, text, extractors)
                except Exception as e:  # noqa: BLE001
                    rows.append((repo, path, f"{type(e).__name__}: {e}"[:300], None, [], [], [], []))
                    continue
                own = [{"kind": s.kind, "name": s.name, "qualified": s.qualified, "signature": s.signature, "doc": s.doc, "start_line": s.start, "end_line": s.end, "exported": s.exported, "meta": s.meta} for s in r.symbols]
                rows.append((repo, path, r.error, r.file_doc, own, r.imports, r.exports, r.refs))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "error", "file_doc", "symbols", "imports", "exports", "refs"])

    return sources.filter("source is not null and path is not null").select("repo_id", "path", "source").mapInPandas(parsed, PARSED)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The parsed rows as flat tables, each with ``file``, the file's id."""
    p = parsed.withColumn("file", F.concat("repo_id", F.lit(":"), F.col("path")))
    flat = {name: p.select("repo_id", "path", "file", F.explode(name).alias("x")).select("repo_id", "path", "file", "x.*") for name in ("symbols", "imports", "exports", "refs")}
    flat["symbols"] = flat["symbols"].withColumn("id", F.concat("file", F.lit("#"), F.col("qualified")))
    flat["files"] = p.select("repo_id", "path", "file").distinct()
    return flat


def resolve(t: dict[str, DataFrame], aliases: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """The table of references with (resolved, outcome)."""
    known = t["files"].select("repo_id", "path")
    wanted = t["imports"].select("repo_id", "path", F.col("source").alias("specifier")).unionByName(t["exports"].filter("source is not null").select("repo_id", "path", F.col("source").alias("specifier")))
    targets = cut_lineage(resolve_modules(wanted, known, aliases))
    keyed = targets.withColumn("target_file", F.concat("repo_id", F.lit(":"), F.col("target"))).select("repo_id", "path", F.col("specifier").alias("source"), "target_file")
    bound = t["imports"].select("repo_id", "path", "file", "source", F.explode("specifiers").alias("s")).join(keyed, ["repo_id", "path", "source"], "left")
    bound = bound.select("file", F.col("s.local").alias("local"), F.col("s.imported").alias("imported"), "target_file")
    exports = t["exports"].join(keyed, ["repo_id", "path", "source"], "left").select("file", "ord", "name", "local", "kind", F.col("target_file").alias("target"))
    need = bound.filter("target_file is not null and imported <> '*'").select(F.col("target_file").alias("file"), F.col("imported").alias("name"))
    led = resolve_exports(need, exports, t["symbols"].select("file", "qualified", "id")).select(F.col("file").alias("target_file"), F.col("name").alias("imported"), "symbol_id")
    bindings = bound.join(led, ["target_file", "imported"], "left")
    # What handles a route is named at the top of the file, whatever the route is called.
    handles = F.col("kind") == "handles"
    refs = t["refs"].select(
        "repo_id", "path", "file", F.when(handles, "").otherwise(F.coalesce("scope", F.lit(""))).alias("scope"), "name", "kind", "line", F.when(handles, F.col("scope")).alias("route")
    )
    # A provider element refers to its context.
    provider = (F.col("kind") == "jsx") & F.col("name").endswith(".Provider")
    refs = refs.withColumn("provides", provider).withColumn("name", F.when(provider, F.regexp_replace("name", r"\.Provider$", "")).otherwise(F.col("name")))
    return resolve_references(refs, t["symbols"].select("file", "qualified", "id"), bindings)


def nodes_of(t: dict[str, DataFrame]) -> DataFrame:
    """(id, repo_id, label, name, path, exported) of repositories, folders, files, symbols and dependencies."""
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    no = F.lit(False)
    symbols = t["symbols"].select("id", "repo_id", F.element_at(names, F.col("kind")).alias("label"), "name", "path", "exported")
    files = t["files"].select(F.col("file").alias("id"), "repo_id", F.lit("File").alias("label"), basename(F.col("path")).alias("name"), "path", no.alias("exported"))
    repos = t["files"].select("repo_id").distinct().select(F.col("repo_id").alias("id"), "repo_id", F.lit("Repository").alias("label"), F.col("repo_id").alias("name"), F.lit("").alias("path"), no.alias("exported"))
    dirs = t["files"].select("repo_id", F.explode(ancestor_dirs(F.col("path"))).alias("path")).distinct()
    dirs = dirs.select(F.concat("repo_id", F.lit(":"), F.col("path"), F.lit("/")).alias("id"), "repo_id", F.lit("Directory").alias("label"), basename(F.col("path")).alias("name"), "path", no.alias("exported"))
    deps = t["imports"].filter("source_class <> 'relative'").select("repo_id", package_name(F.col("source")).alias("name")).distinct()
    deps = deps.select(F.concat("repo_id", F.lit("::dep::"), F.col("name")).alias("id"), "repo_id", F.lit("Dependency").alias("label"), "name", F.lit("").alias("path"), no.alias("exported"))
    return repos.unionByName(dirs).unionByName(files).unionByName(symbols).unionByName(deps).dropDuplicates(["id"])


def edges_of(t: dict[str, DataFrame], references: DataFrame, aliases: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(repo_id, src, dst, type, kind, line, count): one edge for each pair and type, with the first line and how often it occurs."""
    f, s = t["files"], t["symbols"]
    folder = dirname(F.col("path"))
    up = F.when(folder == "", F.col("repo_id")).otherwise(F.concat("repo_id", F.lit(":"), folder, F.lit("/")))
    none = F.lit(None).cast("string")

    def edge(df: DataFrame, src, dst, kind, detail=none, line=F.lit(0)) -> DataFrame:
        return df.select("repo_id", src.alias("src"), dst.alias("dst"), kind.alias("type"), detail.alias("kind"), line.cast("int").alias("line"))

    dirs = f.select("repo_id", F.explode(ancestor_dirs(F.col("path"))).alias("path")).distinct()
    holds = edge(f, up, F.col("file"), F.lit("CONTAINS")).unionByName(edge(dirs, up, F.concat("repo_id", F.lit(":"), F.col("path"), F.lit("/")), F.lit("CONTAINS")))
    holds = holds.unionByName(edge(s, F.col("file"), F.col("id"), F.lit("CONTAINS")))
    defines = edge(s, F.col("file"), F.col("id"), F.when(F.col("kind") == "variable", "DECLARES").otherwise("DEFINES"))
    owner = s.filter("kind = 'class'").select("file", F.col("qualified").alias("owner"), F.col("id").alias("class_id"))
    methods = s.filter("kind = 'method'").withColumn("owner", F.regexp_replace("qualified", r"\.[^.]*$", "")).join(owner, ["file", "owner"])
    defines = defines.unionByName(edge(methods, F.col("class_id"), F.col("id"), F.lit("DEFINES")))
    targets = resolve_modules(t["imports"].select("repo_id", "path", F.col("source").alias("specifier")), f.select("repo_id", "path"), aliases).withColumnRenamed("specifier", "source")
    i = t["imports"].join(targets, ["repo_id", "path", "source"], "left")
    local = i.filter("target is not null")
    outside = i.filter("target is null and source_class <> 'relative'")
    imports = edge(local, F.col("file"), F.concat("repo_id", F.lit(":"), F.col("target")), F.lit("IMPORTS"), F.col("kind"), F.col("line")).unionByName(
        edge(outside, F.col("file"), F.concat("repo_id", F.lit("::dep::"), package_name(F.col("source"))), F.lit("IMPORTS"), F.col("kind"), F.col("line"))
    )
    gives = t["exports"].filter("kind in ('named', 'default')").join(s.select("file", F.col("qualified").alias("local"), "id"), ["file", "local"])
    exports = edge(gives, F.col("file"), F.col("id"), F.lit("EXPORTS"), F.col("name"), F.col("line"))
    kinds = s.select(F.col("id").alias("resolved"), F.col("kind").alias("target_kind"))
    r = references.filter("outcome = 'resolved'").join(kinds, "resolved", "left")
    source = F.when(F.col("scope") == "", F.col("file")).otherwise(F.concat("file", F.lit("#"), F.col("scope")))
    kind = (
        F.when(F.col("kind") == "extends", "EXTENDS")
        .when(F.col("kind") == "implements", "IMPLEMENTS")
        .when(F.col("kind") == "call", "CALLS")
        .when((F.col("kind") == "hook") & (F.col("target_kind") == "hook"), "USES_HOOK")
        .when(F.col("kind") == "hook", "CALLS")
        .when(F.col("provides"), "PROVIDES_CONTEXT")
        .when((F.col("kind") == "jsx") & (F.col("target_kind") == "component"), "USES_COMPONENT")
        .when(F.col("kind") == "write", "WRITES")
        .when((F.col("kind") == "read") & (F.col("target_kind") == "context"), "CONSUMES_CONTEXT")
        .when((F.col("kind") == "read") & (F.col("target_kind") == "variable"), "READS")
        .when((F.col("kind") == "read") & F.col("target_kind").isin("enum", "typeAlias"), "USES")
    )
    behaviour = edge(r, source, F.col("resolved"), kind, none, F.col("line")).filter("type is not null and (type <> 'CALLS' or src <> dst)")
    handles = edge(r.filter("kind = 'handles'"), F.col("resolved"), F.concat("file", F.lit("#"), F.col("route")), F.lit("HANDLES"), none, F.col("line"))
    every = holds.unionByName(defines).unionByName(imports).unionByName(exports).unionByName(behaviour).unionByName(handles)
    named = F.when(F.col("type") == "EXPORTS", F.col("kind")).otherwise("")
    return every.groupBy("repo_id", "src", "dst", "type", named.alias("name")).agg(F.min("kind").alias("kind"), F.min("line").alias("line"), F.count("*").alias("count")).drop("name")


def code_graph(sources: DataFrame, aliases: list[tuple[str, list[str]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``sources(repo_id, path, source)``; parsed once and written to the shared folder, without the texts."""
    t = tables(cut_lineage(parse_sources(sources)))
    return nodes_of(t), edges_of(t, resolve(t, aliases), aliases)
