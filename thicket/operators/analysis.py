"""Analysis of repositories: dead code, dependencies, summaries and advice."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.graph import of_types, reachable

# Entry files by default, the shape of test files, and the kinds that are checked.
ENTRY_FILES = ["src/main.ts", "src/main.tsx", "src/index.ts", "src/index.tsx", "src/App.tsx", "main.ts", "main.tsx", "index.ts", "index.tsx", "index.js", "App.tsx"]
TEST_FILES = r"(^|/)(__tests__/.*|.*\.(test|spec)\.[jt]sx?)$"
CHECKED = ["Function", "Component", "Hook"]


def dead_code_roots(nodes: DataFrame, edges: DataFrame, entries: list[str] | None = None, include_tests: bool = False, tests: str = TEST_FILES) -> DataFrame:
    """(id): routes and APIs, exported symbols of entry files and of the files that they import, handlers of routes and, if wanted,
    all that test files define. ``nodes`` has ``exported``."""
    entries = ENTRY_FILES if entries is None else entries
    at_entry = nodes.filter(F.col("label").isin("Route", "Api") | (F.col("exported") & F.col("path").isin(entries))).select("id")
    files = nodes.filter("label = 'File'")
    entry = files.filter(F.col("path").isin(entries)).select(F.col("id").alias("src"))
    imported = of_types(edges, ["IMPORTS"]).join(entry, "src").select(F.col("dst").alias("src")).join(files.select(F.col("id").alias("src")), "src")
    exported = nodes.filter("exported").select(F.col("id").alias("dst"))
    seeded = of_types(edges, ["DEFINES"]).join(imported.distinct(), "src").join(exported, "dst").select(F.col("dst").alias("id"))
    routes = nodes.filter(F.col("label").isin("Route", "Api")).select(F.col("id").alias("dst"))
    handlers = of_types(edges, ["HANDLES"]).join(routes, "dst").select(F.col("src").alias("id"))
    roots = at_entry.unionByName(seeded).unionByName(handlers)
    if include_tests:
        roots = roots.unionByName(nodes.filter(F.col("path").rlike(tests)).select("id"))
    return roots.distinct()


def dead_symbols(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, name, kind, path, confidence): checked symbols that no root reaches; 'possibly-used' where their file is imported
    dynamically. Without roots there is no report at all. ``edges`` has ``kind`` of imports."""
    if roots.isEmpty():
        return nodes.limit(0).select("id", "name", F.col("label").alias("kind"), "path", F.lit("").alias("confidence"))
    reached = reachable(edges, roots)
    dynamic = of_types(edges, ["IMPORTS"]).filter("kind = 'dynamic'").select(F.col("dst").alias("file")).distinct().withColumn("dynamic", F.lit(True))
    rest = nodes.filter(F.col("label").isin(CHECKED)).join(reached, "id", "left_anti")
    return rest.withColumn("file", F.concat("repo_id", F.lit(":"), "path")).join(dynamic, "file", "left").select(
        "id", "name", F.col("label").alias("kind"), "path", F.when(F.col("dynamic"), "possibly-used").otherwise("dead").alias("confidence")
    )


def dead_files(nodes: DataFrame, edges: DataFrame, roots: DataFrame, entries: list[str] | None = None) -> DataFrame:
    """(id, path, confidence): files, entry files aside, that define something checkable and of which nothing is reached."""
    entries = ENTRY_FILES if entries is None else entries
    if roots.isEmpty():
        return nodes.limit(0).select("id", "path", F.lit("").alias("confidence"))
    reached = reachable(edges, roots).withColumn("hit", F.lit(1))
    checked = nodes.filter(F.col("label").isin(CHECKED)).select(F.col("id").alias("dst"))
    held = of_types(edges, ["DEFINES", "DECLARES"]).join(checked, "dst").select(F.col("src").alias("id"), "dst")
    alive = held.join(reached.withColumnRenamed("id", "dst"), "dst", "left").groupBy("id").agg(F.count("hit").alias("hits"))
    dynamic = of_types(edges, ["IMPORTS"]).filter("kind = 'dynamic'").select(F.col("dst").alias("id")).distinct().withColumn("dynamic", F.lit(True))
    return (
        nodes.filter((F.col("label") == "File") & ~F.col("path").isin(entries))
        .join(alive.filter("hits = 0"), "id", "left_semi")
        .join(reached, "id", "left_anti")
        .join(dynamic, "id", "left")
        .select("id", "path", F.when(F.col("dynamic"), "possibly-used").otherwise("dead").alias("confidence"))
    )


def dependency_mismatches(declared: DataFrame, imports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., name, kind, import_count): declared but never imported is 'unused', imported but not declared 'phantom'.

    ``declared`` has (by..., name), ``imports`` one row (by..., name) an import. Names that start with ``node:`` are left out.
    """
    key = [*(by or []), "name"]
    used = imports.groupBy(*key).agg(F.count("*").alias("import_count"))
    both = declared.select(*key).distinct().withColumn("declared", F.lit(True)).join(used, key, "full_outer")
    return (
        both.filter(F.col("name").isNotNull() & ~F.col("name").startswith("node:"))
        .withColumn("import_count", F.coalesce("import_count", F.lit(0)))
        .withColumn("kind", F.when(F.col("declared") & (F.col("import_count") == 0), "unused").when(F.col("declared").isNull(), "phantom"))
        .filter("kind is not null")
        .select(*key, "kind", "import_count")
    )


def symbol_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo_id", F.lower("kind").alias("kind")).agg(F.count("*").alias("n"))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", F.lower("language").alias("language")).agg(F.count("*").alias("n"))


def key_modules(symbols: DataFrame, files: DataFrame, k: int = 10) -> DataFrame:
    """(repo_id, rel_path, exports, rank): the files with most exported symbols of each repository; ties go by path."""
    counts = symbols.filter("exported").groupBy("file_id").agg(F.count("*").alias("exports"))
    joined = counts.join(files.select(F.col("id").alias("file_id"), "repo_id", "rel_path").distinct(), "file_id")
    order = Window.partitionBy("repo_id").orderBy(F.desc("exports"), "rel_path")
    return joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("repo_id", "rel_path", "exports", "rank")


#: Dependencies that tell a stack.
STACKS = {"react": "React", "next": "Next.js", "vue": "Vue", "svelte": "Svelte", "express": "Express", "fastify": "Fastify", "vite": "Vite", "webpack": "webpack", "typescript": "TypeScript", "vitest": "Vitest", "jest": "Jest"}
# Entry points that are looked for where none is configured.
ENTRY_POINTS = ["src/main.ts", "src/main.tsx", "src/index.ts", "src/index.tsx", "src/App.tsx", "main.ts", "index.ts"]


def summarize_repository(repo: str, files: DataFrame, symbols: DataFrame, entries: list[str] | None = None, dependencies: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of a repository's summary: languages, symbols, key modules, entry points and, by its ``dependencies(repo_id, name)``, stacks.

    Entry points are the configured ones that exist, or else the usual candidates that do.
    """
    f, s = files.filter(F.col("repo_id") == repo), symbols.filter(F.col("repo_id") == repo)
    paths = f.select("rel_path").distinct()
    configured = paths.filter(F.col("rel_path").isin(entries or []))
    usual = paths.filter(F.col("rel_path").isin(ENTRY_POINTS))
    out = {
        "languages": language_counts(f),
        "symbols": symbol_counts(s),
        "key_modules": key_modules(s, f),
        # A handful of rows by construction.
        "entry_points": configured if entries and not configured.isEmpty() else usual,
    }
    if dependencies is not None:
        names = F.create_map(*[F.lit(x) for pair in STACKS.items() for x in pair])
        out["stacks"] = dependencies.filter(F.col("repo_id") == repo).select(F.element_at(names, F.col("name")).alias("stack")).filter("stack is not null").distinct()
    return out


# The patterns of the rules and the words that they pass over.
NOT_OUTER = set("const let var return if else true false null undefined this new typeof console window document Math JSON Object Array String Number Boolean Promise".split())
_HOOK_CALL = re.compile(r"use(?:Effect|Callback|Memo)\(\s*(?:\([^)]*\)|\w+)\s*=>\s*\{([\s\S]*?)\n?\}\s*,\s*\[([^\]]*)\]\s*\)", re.A)
_LOWER_WORD = re.compile(r"(\.\s*)?\b[a-z][a-zA-Z0-9]*\b", re.A)
_LIST_ITEM = re.compile(r"\.map\(\s*(?:\([^)]*\)|\w+)\s*=>\s*(?:\(?\s*)?(<[A-Za-z][\w.]*)\b([^>]*)>", re.A)
_INDEX_KEY = re.compile(r"\.map\(\s*\([^,)]+,\s*(\w+)\)\s*=>[\s\S]*?key=\{\s*\1\s*\}", re.A)
_MEMO = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*=\s*memo\(", re.A)
_ANY = re.compile(r":\s*any\b(?!\w)", re.A)
_NON_NULL = re.compile(r"[\w)\]]!(?![=:])", re.A)
_IMG = re.compile(r"<img\b(?![^>]*\balt\s*=)[^>]*>", re.I | re.A)
_HTML = re.compile(r"dangerouslySetInnerHTML")


# What each rule says; the dependency and the component are named where there is one.
MESSAGES = {
    "react-hook-deps": '"{0}" is used in the effect/callback body but missing from its dependency array',
    "react-list-key": "JSX element rendered inside .map() has no key prop",
    "perf-array-index-key": "Array index used as the key prop — breaks on reorder/insert/delete",
    "react-memo-inline-prop": "<{0}> is memoized but called with a new inline function/object prop every render",
    "ts-any-leak": "Explicit `any` type annotation leaks untyped values",
    "ts-non-null-assertion": "Non-null assertion (!) — consider a real null check or optional chaining",
    "a11y-img-alt": "<img> is missing an alt attribute (accessibility)",
    "security-dangerous-html": "dangerouslySetInnerHTML bypasses React's escaping — verify the HTML is sanitized",
}
Found = Iterator[tuple[int, str]]


def _hook_deps(text: str) -> Found:
    for m in _HOOK_CALL.finditer(text):
        deps = {d.strip() for d in m[2].split(",")}
        outer = (w[0] for w in _LOWER_WORD.finditer(m[1]) if not w[1] and w[0] not in NOT_OUTER and not re.match("set[A-Z]", w[0]))
        missing = next((w for w in outer if w not in deps), None)
        if missing:
            yield m.start(), missing


def _list_key(text: str) -> Found:
    return ((m.start(), "") for m in _LIST_ITEM.finditer(text) if not re.search(r"\bkey\s*=", m[2]))


def _memo_props(text: str) -> Found:
    for memo in _MEMO.finditer(text):
        for m in re.finditer(rf"<{memo[1]}\b[^>]*=\{{(?:\([^)]*\)\s*=>|function\b|\{{)", text):
            yield m.start(), memo[1]


def _pattern(pattern: re.Pattern[str]) -> Callable[[str], Found]:
    return lambda text: ((m.start(), "") for m in pattern.finditer(text))


#: Plug-ins (rule, severity, function of a text to (offset, named word)); add one to check more. Its message stands in MESSAGES or is the rule's name.
RULES: list[tuple[str, str, Callable[[str], Found]]] = [
    ("react-hook-deps", "warning", _hook_deps),
    ("react-list-key", "warning", _list_key),
    ("perf-array-index-key", "warning", _pattern(_INDEX_KEY)),
    ("react-memo-inline-prop", "info", _memo_props),
    ("ts-any-leak", "warning", _pattern(_ANY)),
    ("ts-non-null-assertion", "info", _pattern(_NON_NULL)),
    ("a11y-img-alt", "warning", _pattern(_IMG)),
    ("security-dangerous-html", "warning", _pattern(_HTML)),
]


def findings(text: str, rules: list[tuple[str, str, Callable[[str], Found]]] | None = None) -> list[tuple[str, int, str, str]]:
    """(rule, line, severity, message) of all rules, by line."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    out = []
    for rule, severity, check in RULES if rules is None else rules:
        out += [(rule, bisect_left(breaks, at) + 1, severity, MESSAGES.get(rule, rule).format(word)) for at, word in check(text)]
    return sorted(out, key=lambda f: f[1])


def rule_findings(sources: DataFrame, rules: list[tuple[str, str, Callable[[str], Found]]] | None = None) -> DataFrame:
    """(file_id, rule, line, severity, message): findings of the whole rule pack in each source; null sources have none."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, *x) for f, text in zip(batch["file_id"], batch["source"]) for x in findings(text, rules)]
            yield pd.DataFrame(rows, columns=["file_id", "rule", "line", "severity", "message"])

    once = sources.filter("source is not null").select("file_id", "source").distinct()
    return once.mapInPandas(check, "file_id string, rule string, line int, severity string, message string").distinct()


def advise(model, path: str, text: str, start: int = 1, guidelines: str = "") -> dict:
    """Findings of one symbol's text, a model's advice on them in the light of the project's guidelines, and a patch where one is safe.

    Only a missing alt text is patched: (path, first and last line of the file, replacement). Nothing is written.
    """
    found = findings(text)
    said = "\n".join(f"- line {line} [{severity}] {rule}: {message}" for rule, line, severity, message in found) or "none"
    prompt = f"File: {path}\n\n{text}\n\nStatic findings:\n{said}" + (f"\n\nProject guidelines:\n{guidelines}" if guidelines else "")
    patch = None
    for rule, line, _, _ in found:
        fixed = suggest_alt_patch(text, line) if rule == "a11y-img-alt" else None
        if fixed is not None:
            patch = {"path": path, "start_line": start + line - 1, "end_line": start + line - 1, "replacement": fixed}
            break
    return {"findings": found, "advice": model.complete(prompt), "patch": patch}


#: Rules without look-around, as column patterns: they stay in the JVM.
LINE_RULES = {"ts-any-leak": r":\s*any\b", "security-dangerous-html": "dangerouslySetInnerHTML"}


def line_rule_findings(sources: DataFrame) -> DataFrame:
    """(file_id, rule, line, n) of the rules that one line decides, by column expressions alone."""
    lines = sources.filter("source is not null").select("file_id", "source").distinct().select("file_id", F.posexplode(F.split("source", "\n")).alias("at", "text"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("n")) for r, p in LINE_RULES.items()]))
    return lines.select("file_id", (F.col("at") + 1).alias("line"), rules.alias("r")).filter("r.n > 0").select("file_id", "r.rule", "line", "r.n")


def suggest_alt_patch(text: str, line: int) -> str | None:
    """The line with ``alt=""`` put into its first image without one; None where there is none."""
    lines = text.split("\n")
    if not 1 <= line <= len(lines):
        return None
    patched = re.sub(r"<img\b(?![^>]*\balt\s*=)", '<img alt=""', lines[line - 1], count=1, flags=re.I)
    return patched if patched != lines[line - 1] else None
