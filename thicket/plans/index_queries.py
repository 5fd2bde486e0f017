"""Queries of indexing, lookups, analysis, chat and change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import ids, paths
from thicket.operators import analysis, chat, graph, indexing, ranking, resolve
from thicket.session import spread_partitions
from thicket.sources.tables import table
from thicket.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_DISCOVERED = "(SELECT DISTINCT split_part(file_id, ':', 1) AS repo_id, regexp_replace(file_id, '^[^:]*:', '') AS path, substr(sha256(source), 1, 16) AS hash FROM file_sources WHERE file_id IS NOT NULL)"
_DIFF = f"""SELECT coalesce(d.repo_id, s.repo_id) AS repo_id, coalesce(d.path, s.path) AS path, CASE WHEN d.path IS NULL THEN 'removed' WHEN s.path IS NULL THEN 'added' WHEN d.hash IS NULL THEN 'unreadable' WHEN d.hash IS NOT DISTINCT FROM s.hash THEN 'unchanged' ELSE 'changed' END AS state
FROM {_DISCOVERED} d FULL JOIN (SELECT DISTINCT repo_id, rel_path AS path, content_hash AS hash FROM files) s ON s.repo_id = d.repo_id AND s.path = d.path"""


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, path, hash) of the sources that are there."""
    f = F.col("file_id")
    return table(spark, folder, "file_sources").filter("file_id is not null").select(ids.repo_of(f).alias("repo_id"), ids.path_of(f).alias("path"), ids.content_hash(F.col("source")).alias("hash"))


@query(_DIFF)
def hash_diff(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "files").select("repo_id", F.col("rel_path").alias("path"), F.col("content_hash").alias("hash"))
    return indexing.hash_diff(discovered(spark, folder), stored)


@query(f"WITH t AS (SELECT DISTINCT repo_id FROM ({_DIFF}) WHERE state IN ('added', 'changed', 'removed')) SELECT id, CAST(coalesce(generation, 0) + CASE WHEN repo_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS generation FROM repositories LEFT JOIN t ON id = repo_id")
def next_generation(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.next_generation(table(spark, folder, "repositories"), hash_diff(spark, folder)).select("id", F.col("generation").cast("long").alias("generation"))


@query(
    f"SELECT DISTINCT f.repo_id, f.rel_path AS old_path, new_path FROM files f JOIN (SELECT repo_id, hash, min(path) AS new_path FROM {_DISCOVERED} GROUP BY 1, 2) a ON a.repo_id = f.repo_id AND a.hash = f.content_hash"
)
def rename_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Where the content of each catalogued file lies now."""
    stored = table(spark, folder, "files").select("repo_id", F.col("rel_path").alias("path"), F.col("content_hash").alias("hash"))
    return indexing.rename_pairs(stored, discovered(spark, folder))


@query(
    """WITH s AS (SELECT DISTINCT file_id, string_split(source, chr(10)) AS lines FROM file_sources WHERE source IS NOT NULL), p AS (SELECT *, CASE WHEN len(lines) <= 120 THEN 1 ELSE 1 + CAST(ceil((len(lines) - 120) / 110.0) AS INT) END AS parts FROM s),
e AS (SELECT *, unnest(range(parts)) AS n FROM p) SELECT file_id, CASE WHEN parts > 1 THEN n END AS part, n * 110 + 1 AS first_line, len(lines[n * 110 + 1 : n * 110 + 120]) AS n_lines, substr(sha256(array_to_string(lines[n * 110 + 1 : n * 110 + 120], chr(10))), 1, 16) AS hash FROM e"""
)
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "file_sources").filter("source is not null").distinct()
    cut = indexing.chunk_windows(s, "file_id", "source")
    return cut.select("file_id", F.col("part").cast("long").alias("part"), F.col("first_line").cast("long").alias("first_line"), F.col("n_lines").cast("long").alias("n_lines"), ids.content_hash(F.col("content")).alias("hash"))


_NEW = "(SELECT DISTINCT id, substr(sha256(content), 1, 16) AS content_hash FROM chunks)"


def _fresh(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with the hash of what they hold, chunks as they were stored): hashes that are stale show."""
    prior = table(spark, folder, "chunks")
    return prior.select("id", ids.content_hash(F.col("content")).alias("content_hash")).distinct(), prior


@query(f"SELECT n.id, n.content_hash FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.embedded_at IS NOT NULL AND c.id = n.id AND c.content_hash = n.content_hash)")
def embed_gate(spark: SparkSession, folder: str) -> DataFrame:
    new, prior = _fresh(spark, folder)
    return indexing.to_embed(new, prior)


@query(f"SELECT n.id, n.content_hash, max(c.embedded_at) AS embedded_at FROM {_NEW} n LEFT JOIN chunks c ON c.id = n.id AND c.content_hash = n.content_hash GROUP BY 1, 2")
def carry_over(spark: SparkSession, folder: str) -> DataFrame:
    new, prior = _fresh(spark, folder)
    return indexing.carry_over(new, prior)


@query("SELECT DISTINCT id FROM symbols WHERE id IS NOT NULL AND id NOT IN (SELECT symbol_id FROM chunks WHERE symbol_id IS NOT NULL)")
def gone_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of which no chunk is left."""
    return indexing.gone(table(spark, folder, "chunks").select(F.col("symbol_id").alias("id")), table(spark, folder, "symbols").filter("id is not null"))


@query(
    "WITH r AS (SELECT DISTINCT * FROM index_runs), n AS (SELECT run_id, max(coalesce(len(errors), 0)) AS n FROM index_run_results GROUP BY 1) SELECT r.id AS run_id, repo_id, kind, CASE WHEN finished_at IS NULL THEN 'running' WHEN error IS NOT NULL THEN 'failed' ELSE 'done' END AS state, "
    "round((epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0, 3) AS seconds, coalesce(n, 0) AS errors FROM r LEFT JOIN n ON n.run_id = r.id"
)
def run_journal(spark: SparkSession, folder: str) -> DataFrame:
    j = indexing.run_journal(table(spark, folder, "index_runs"), table(spark, folder, "index_run_results"))
    return j.withColumn("seconds", F.round("seconds", 3))


@query(
    "WITH r AS (SELECT DISTINCT id, repo_id, started_at, finished_at FROM index_runs WHERE started_at IS NOT NULL) SELECT a.id AS run_id, a.repo_id, (SELECT count(*) FROM r b WHERE b.repo_id = a.repo_id AND (b.started_at < a.started_at OR b.started_at = a.started_at AND b.id < a.id) "
    "AND (b.finished_at IS NULL OR b.finished_at > a.started_at)) AS n FROM r a"
)
def overlapping_runs(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.overlapping_runs(table(spark, folder, "index_runs"))


@query(
    "SELECT DISTINCT id, split_part(id, ':', 1) AS repo, regexp_replace(split_part(id, '#', 1), '^[^:]*:', '') AS path, regexp_extract(regexp_replace(id, '~[0-9]+$', ''), '^[^#]*#(.*)$', 1) AS qualified, TRY_CAST(nullif(regexp_extract(id, '~([0-9]+)$', 1), '') AS INT) AS part FROM chunks"
)
def id_codec(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("id")
    return table(spark, folder, "chunks").select("id").distinct().select(
        "id", ids.repo_of(c).alias("repo"), ids.path_of(c).alias("path"), F.coalesce(ids.qualified_of(c), F.lit("")).alias("qualified"), ids.part_of(c).alias("part")
    )


@query("SELECT DISTINCT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS point, substr(sha256(id), 1, 16) AS hash FROM (SELECT id, sha1(id) AS h FROM chunks)")
def point_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("id").distinct().select("id", ids.point_id(F.col("id")).alias("point"), ids.content_hash(F.col("id")).alias("hash"))


_TREE = """WITH f AS (SELECT DISTINCT repo_id, rel_path AS path FROM files WHERE rel_path IS NOT NULL), p AS (SELECT repo_id, string_split(path, '/') AS parts FROM f),
d AS (SELECT DISTINCT repo_id, array_to_string(parts[1:n], '/') AS path FROM (SELECT repo_id, parts, unnest(range(1, len(parts))) AS n FROM p)) """


@query(_TREE + "SELECT repo_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS name, is_file FROM (SELECT *, true AS is_file FROM f UNION ALL SELECT *, false FROM d)")
def file_tree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.file_tree(table(spark, folder, "files"))


@query(_TREE + "SELECT repo_id, path, count(*) AS n FROM d JOIN (SELECT repo_id, path AS file FROM f) USING (repo_id) WHERE starts_with(file, path || '/') GROUP BY 1, 2")
def files_under(spark: SparkSession, folder: str) -> DataFrame:
    """How many files each folder holds, at any depth."""
    f = table(spark, folder, "files").filter("rel_path is not null").select("repo_id", "rel_path").distinct()
    return f.select("repo_id", F.explode(paths.ancestor_dirs(F.col("rel_path"))).alias("path")).groupBy("repo_id", "path").agg(F.count("*").alias("n"))


@query("SELECT repo_id, lower(kind) AS kind, count(*) AS n FROM (SELECT DISTINCT * FROM symbols) GROUP BY 1, 2")
def symbol_counts(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.symbol_counts(table(spark, folder, "symbols").distinct())


@query("SELECT repo_id, lower(language) AS language, count(*) AS n FROM (SELECT DISTINCT id, repo_id, language FROM files) GROUP BY 1, 2")
def repo_languages(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.language_counts(table(spark, folder, "files").select("id", "repo_id", "language").distinct())


@query(
    "SELECT repo_id, rel_path, exports, row_number() OVER (PARTITION BY repo_id ORDER BY exports DESC, rel_path) AS rank FROM (SELECT file_id, count(*) AS exports FROM (SELECT DISTINCT id, file_id FROM symbols WHERE exported) GROUP BY 1) JOIN (SELECT DISTINCT id AS file_id, repo_id, rel_path FROM files) USING (file_id) QUALIFY rank <= 10"
)
def key_modules(spark: SparkSession, folder: str) -> DataFrame:
    symbols = table(spark, folder, "symbols").filter("exported").select("id", "file_id", "exported").distinct()
    return analysis.key_modules(symbols, table(spark, folder, "files"))


@query("SELECT file_id, id, name, start_line, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, id) AS place FROM (SELECT DISTINCT id, file_id, name, start_line FROM symbols)")
def symbols_by_file(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    s = table(spark, folder, "symbols").select("id", "file_id", "name", "start_line").distinct()
    return s.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "id"))).select("file_id", "id", "name", "start_line", "place")


@query("SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id FROM files)")
def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """All file ids with their place in the order of ids."""
    return ranking.global_rank(table(spark, folder, "files").select("id").distinct(), [F.col("id")], "place")


@query(
    "WITH m AS (SELECT DISTINCT session_id, id, role, content, created_at FROM chat_messages WHERE session_id IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, id DESC) AS back FROM m QUALIFY back <= 6) "
    "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY back DESC) AS turn, id, role, content FROM b"
)
def chat_history(spark: SparkSession, folder: str) -> DataFrame:
    return chat.history(table(spark, folder, "chat_messages"))


@query("SELECT repo_id, id FROM (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC NULLS LAST, id DESC) AS n FROM (SELECT DISTINCT repo_id, id, created_at FROM chat_sessions WHERE repo_id IS NOT NULL)) WHERE n = 1")
def implicit_session(spark: SparkSession, folder: str) -> DataFrame:
    return chat.latest_session(table(spark, folder, "chat_sessions"))


@query(
    "SELECT id, row_number() OVER (PARTITION BY id ORDER BY first) AS place, mark FROM (SELECT id, mark, min(n) AS first FROM (SELECT id, unnest(m) AS mark, generate_subscripts(m, 1) AS n FROM (SELECT DISTINCT id, regexp_extract_all(content, '\\[(S[0-9]+)\\]', 1) AS m FROM chat_messages)) GROUP BY 1, 2)"
)
def citations(spark: SparkSession, folder: str) -> DataFrame:
    return chat.cited(table(spark, folder, "chat_messages").select("id", "content").distinct())


@query(
    "SELECT id, place, c->>'file' AS file, TRY_CAST(c->>'startLine' AS INT) AS start_line, TRY_CAST(c->>'endLine' AS INT) AS end_line FROM (SELECT id, unnest(CAST(j AS JSON[])) AS c, generate_subscripts(CAST(j AS JSON[]), 1) AS place FROM (SELECT DISTINCT id, citations_json AS j FROM chat_messages WHERE json_valid(citations_json) AND json_type(citations_json) = 'ARRAY')) WHERE c->>'file' IS NOT NULL"
)
def stored_citations(spark: SparkSession, folder: str) -> DataFrame:
    return chat.stored_citations(table(spark, folder, "chat_messages"))


@query(
    "SELECT file_id, rule, line, n FROM (SELECT file_id, line, unnest([{'rule': 'ts-any-leak', 'n': len(regexp_extract_all(text, ':\\s*any\\b'))}, {'rule': 'security-dangerous-html', 'n': len(regexp_extract_all(text, 'dangerouslySetInnerHTML'))}], recursive := true) FROM "
    "(SELECT file_id, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT DISTINCT file_id, string_split(source, chr(10)) AS l FROM file_sources WHERE source IS NOT NULL))) WHERE n > 0"
)
def line_rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.line_rule_findings(table(spark, folder, "file_sources"))


@query()
def rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.rule_findings(table(spark, folder, "file_sources"))


def import_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, path, specifier) of all imports, requires and re-exports as parsed."""
    from thicket.plans.codegraph import parse_sources, tables

    t = tables(parse_sources(_sources(spark, folder)))
    both = t["imports"].select("repo_id", "path", F.col("source").alias("specifier")).unionByName(t["exports"].select("repo_id", "path", F.col("source").alias("specifier")))
    return both.filter("specifier is not null").distinct()


_IMPORTS = r"""src AS (SELECT DISTINCT file_id, min(source) AS source FROM file_sources WHERE source IS NOT NULL AND regexp_matches(file_id, '\.(ts|mts|cts|tsx|js|jsx|mjs|cjs)$') GROUP BY 1),
i AS (SELECT DISTINCT split_part(file_id, ':', 1) AS repo_id, regexp_replace(file_id, '^[^:]*:', '') AS path, unnest(list_concat(regexp_extract_all(source, '(?m)^\x{FEFF}?(?:import\s|export\s+(?:type\s+)?[{*])[^''"`;=()]*?[''"]([^''"\n]+)[''"]', 1), regexp_extract_all(source, '(?:^|[^.\w$])(?:require|import)\(\s*[''"]([^''"\n]+)[''"]', 1))) AS specifier FROM src)"""


@query(
    f"""WITH {_IMPORTS}, b AS (SELECT *, string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS dir FROM i WHERE starts_with(specifier, '.')),
n AS (SELECT repo_id, path, specifier, CASE WHEN starts_with(specifier, './') THEN array_to_string(dir, '/') || '/' || substr(specifier, 3) WHEN starts_with(specifier, '../../') THEN array_to_string(list_concat(dir[1:len(dir) - 2], [substr(specifier, 7)]), '/')
    ELSE array_to_string(list_concat(dir[1:len(dir) - 1], [substr(specifier, 4)]), '/') END AS root FROM b),
e AS (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.cts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '/index.mts', '/index.cts']) AS ending, unnest(range(17)) AS n),
t AS (SELECT repo_id, path, specifier, arg_min(root || ending, e.n) AS target FROM n, e WHERE (repo_id, root || ending) IN (SELECT (repo_id, rel_path) FROM files) GROUP BY 1, 2, 3)
SELECT i.*, target FROM i LEFT JOIN t USING (repo_id, path, specifier)"""
)
def import_resolution(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "files").select("repo_id", F.col("rel_path").alias("path"))
    return resolve.resolve_modules(import_rows(spark, folder), known)


@query(
    f"WITH {_IMPORTS} SELECT repo_id, CASE WHEN starts_with(specifier, '.') THEN 'relative' WHEN starts_with(specifier, 'node:') OR specifier IN ({', '.join(repr(b) for b in resolve.BUILTINS)}) THEN 'builtin' ELSE 'package' END AS class, "
    "CASE WHEN starts_with(specifier, '.') THEN NULL WHEN starts_with(specifier, 'node:') THEN specifier WHEN starts_with(specifier, '@') THEN regexp_extract(specifier, '^(@[^/]+/[^/]+|@[^/]+)', 1) ELSE split_part(specifier, '/', 1) END AS package, count(*) AS n FROM i GROUP BY 1, 2, 3"
)
def dependency_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each repository imports what, relative imports together."""
    i, s = import_rows(spark, folder), F.col("specifier")
    return i.groupBy("repo_id", resolve.specifier_class(s).alias("class"), F.when(~s.startswith("."), resolve.package_name(s)).alias("package")).agg(F.count("*").alias("n"))


@query(
    "WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) "
    "SELECT user_id AS repo_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM g GROUP BY user_id, g"
)
def event_bursts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("user_id").alias("repo_id"), F.col("ts").alias("at"), F.col("event_type").alias("path"))
    return watch.debounced_bursts(e, "30 minutes").select("repo_id", F.col("burst.start").alias("started"), F.col("burst.end").alias("ended"), "n")


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Median, 95th percentile and mean, as benchmarks report them."""
    return table(spark, folder, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean")
    )


@query("WITH s AS (SELECT DISTINCT repo_id, id FROM symbols), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY id) AS place, count(*) OVER (PARTITION BY repo_id) AS total FROM s) SELECT repo_id, id, total, total > 10 AS truncated FROM n WHERE place <= 10")
def truncated_list(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten symbols of each repository, how many there are, and whether the list was cut: a report."""
    from pyspark.sql import Window

    s = table(spark, folder, "symbols").select("repo_id", "id").distinct()
    total = s.groupBy("repo_id").agg(F.count("*").alias("total"))
    first = s.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("id"))).filter("place <= 10")
    return first.join(total, "repo_id").select("repo_id", "id", "total", (F.col("total") > 10).alias("truncated"))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    # Texts of one file that differ: the least of them.
    s = table(spark, folder, "file_sources").filter("source is not null").groupBy("file_id").agg(F.min("source").alias("source"))
    rows = s.select(ids.repo_of(F.col("file_id")).alias("repo_id"), ids.path_of(F.col("file_id")).alias("path"), "source")
    return rows.repartition(spread_partitions(spark), "repo_id", "path")


@query()
def code_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of the code graph of all sources, by parsing and resolving them."""
    from thicket.plans.codegraph import code_graph

    return code_graph(_sources(spark, folder))[1]


@query()
def parsed_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols by parsing all sources."""
    from thicket.plans.codegraph import parse_sources, tables

    return tables(parse_sources(_sources(spark, folder)))["symbols"].select("id", "kind", "name", "qualified", "signature", "doc", "start_line", "end_line", "exported")


_CODE = r"""src AS (SELECT file_id, min(source) AS source FROM file_sources WHERE source IS NOT NULL AND regexp_matches(file_id, '\.(ts|mts|cts|tsx|js|jsx|mjs|cjs)$') GROUP BY 1)"""


@query(
    rf"""WITH {_CODE} SELECT DISTINCT file_id AS file, unnest(regexp_extract_all(source, '(?m)^export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|const|let|var|class|interface|type|enum)\s+([\w$]+)', 1)) AS name FROM src"""
)
def parsed_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Names that files export where they declare them."""
    from thicket.plans.codegraph import parse_sources, tables

    return tables(parse_sources(_sources(spark, folder)))["exports"].filter("kind = 'named' and source is null and local = name").select("file", "name").distinct()


@query()
def context_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Context of each file's first eight symbols under a budget of 600 tokens."""
    from pyspark.sql import Window

    from thicket.operators.context import context_blocks as fold

    s = table(spark, folder, "symbols").dropDuplicates(["id"])
    code = table(spark, folder, "chunks").groupBy(F.col("symbol_id").alias("id")).agg(F.min_by("content", F.col("id")).alias("code"))
    none = F.lit(None).cast("string")
    ranked = s.join(code, "id", "left").select(
        F.col("file_id").alias("query"), F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "id")).alias("rank"), F.col("id").alias("symbol_id"), ids.path_of(F.col("id")).alias("path"),
        "start_line", "end_line", "signature", "qualified", "doc", "code", none.alias("callers"), none.alias("callees"), none.alias("related"),
    )
    return fold(ranked, 600)


@query(
    f"""WITH j AS (SELECT DISTINCT id, repo_id, rel_path AS path, content_hash, indexed_at FROM files), h AS (SELECT repo_id, path, min(hash) AS hash FROM {_DISCOVERED} GROUP BY 1, 2)
SELECT DISTINCT j.id, CASE WHEN epoch(TIMESTAMP '2024-06-01') - epoch(date_trunc('second', indexed_at)) > 31536000 OR h.hash IS DISTINCT FROM content_hash THEN 'expired' ELSE 'pending' END AS state FROM j LEFT JOIN h ON h.repo_id = j.repo_id AND h.path = j.path"""
)
def edit_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """An edit of each catalogued file, proposed when it was indexed: those a year old or of drifted files have expired."""
    from thicket.operators.edits import current_states

    f = table(spark, folder, "files").select("id", "repo_id", "rel_path", "content_hash", "indexed_at").distinct()
    journal = f.select("id", F.lit("pending").alias("state"), F.col("indexed_at").alias("created_at"), F.concat("repo_id", F.lit(":"), "rel_path").alias("file_id"), "content_hash")
    there = discovered(spark, folder).groupBy(F.concat("repo_id", F.lit(":"), "path").alias("file_id")).agg(F.min("hash").alias("content_hash"))
    return current_states(journal, there, F.lit("2024-06-01").cast("timestamp"), 31_536_000).select("id", "state").distinct()
