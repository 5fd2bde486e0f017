"""Incremental indexing: what changed, what is chunked, embedded, carried over or purged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.ids import content_hash

WINDOW_LINES, WINDOW_STEP = 120, 110


def hash_diff(discovered: DataFrame, stored: DataFrame, by: str = "repo_id") -> DataFrame:
    """(by, path, state): added, changed, removed or unchanged, from (by, path, hash) of what is there and what is stored.

    A file that is there but couldn't be read has a null hash; it counts as 'unreadable' and is kept, never as removed.
    """
    d = discovered.select(by, "path", F.col("hash").alias("new"), F.lit(True).alias("there")).distinct()
    s = stored.select(by, "path", F.col("hash").alias("old"), F.lit(True).alias("known")).distinct()
    state = (
        F.when(F.col("there").isNull(), "removed")
        .when(F.col("known").isNull(), "added")
        .when(F.col("new").isNull(), "unreadable")
        .when(F.col("new").eqNullSafe(F.col("old")), "unchanged")
        .otherwise("changed")
    )
    return d.join(s, [by, "path"], "full_outer").select(by, "path", state.alias("state"))


def rename_pairs(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(old_path, new_path): each removed file with the first added one, by path, of the same repository and content."""
    both = removed.select("repo_id", "hash", F.col("path").alias("old_path")).distinct().join(
        added.groupBy("repo_id", "hash").agg(F.min("path").alias("new_path")), ["repo_id", "hash"]
    )
    return both.select("repo_id", "old_path", "new_path")


def part_count(lines: Column, size: int = WINDOW_LINES, step: int = WINDOW_STEP) -> Column:
    return F.when(lines <= size, 1).otherwise(1 + F.ceil((lines - size) / step)).cast("int")


def chunk_windows(rows: DataFrame, key: str, text: str, size: int = WINDOW_LINES, step: int = WINDOW_STEP) -> DataFrame:
    """(key, part, first_line, n_lines, content): windows of ``size`` lines every ``step`` lines; short texts are one part with a
    null number. Null texts have none."""
    lines = F.split(text, "\n")
    cut = rows.filter(F.col(text).isNotNull()).select(key, lines.alias("lines")).withColumn("parts", part_count(F.size("lines"), size, step))
    each = cut.select(key, "lines", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("n"))
    part = F.slice("lines", F.col("n") * step + 1, F.lit(size))
    return each.select(
        key,
        F.when(F.col("parts") > 1, F.col("n")).alias("part"),
        (F.col("n") * step + 1).alias("first_line"),
        F.size(part).alias("n_lines"),
        F.array_join(part, "\n").alias("content"),
    )


def chunk_symbols(symbols: DataFrame, sources: DataFrame, size: int = WINDOW_LINES, step: int = WINDOW_STEP) -> DataFrame:
    """(id, symbol_id, repo_id, content, content_hash): one chunk for each symbol, long ones in windows ``~0``, ``~1``, ...

    A chunk has header comments with path, kind and name, signature, documentation and part, then the symbol's lines.
    """
    s = symbols.filter("start_line is not null and end_line is not null").join(
        sources.filter("source is not null").groupBy("file_id").agg(F.max("source").alias("source")), "file_id"
    )
    start, end = F.col("start_line").cast("int"), F.col("end_line").cast("int")
    body = F.slice(F.split("source", "\n"), F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0)))
    cut = chunk_windows(s.select("id", F.array_join(body, "\n").alias("body")), "id", "body", size, step)
    path = F.regexp_extract("file_id", "^[^:]*:(.*)$", 1)
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("// "), path, F.lit(" · "), F.col("kind"), F.lit(" "), F.col("qualified")),
        F.concat(F.lit("// "), F.col("signature")),
        F.when(F.length("doc") > 0, F.concat(F.lit("// "), F.col("doc"))),
        F.when(F.col("part").isNotNull(), F.concat(F.lit("// part "), F.col("part") + 1)),
    )
    joined = cut.join(s.select("id", "file_id", "repo_id", "kind", "qualified", "signature", "doc"), "id")
    content = F.concat_ws("\n", head, F.col("content"))
    return joined.select(
        F.concat("id", F.when(F.col("part").isNotNull(), F.concat(F.lit("~"), F.col("part"))).otherwise("")).alias("id"),
        F.col("id").alias("symbol_id"),
        "repo_id",
        content.alias("content"),
    ).withColumn("content_hash", content_hash(F.col("content")))


def carry_over(chunks: DataFrame, prior: DataFrame) -> DataFrame:
    """New chunks with ``embedded_at`` of the prior one where id and hash are the same, else null."""
    old = prior.groupBy("id", "content_hash").agg(F.max("embedded_at").alias("embedded_at"))
    return chunks.drop("embedded_at").join(old, ["id", "content_hash"], "left")


def to_embed(chunks: DataFrame, prior: DataFrame) -> DataFrame:
    """New chunks of which no embedded prior one has the same id and hash."""
    return chunks.join(prior.filter("embedded_at is not null").select("id", "content_hash").distinct(), ["id", "content_hash"], "left_anti")


def gone(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    """Ids that were stored and aren't there any more: their postings and vectors go."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def replace_rows(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Upsert: stored rows whose key isn't in ``fresh``, and all of ``fresh``."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*stored.columns))


def purge_files(symbols: DataFrame, chunks: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, chunks and edges without those of the removed files (``file_id``); routes keep their nodes, their edges go."""
    dead = symbols.join(removed.select("file_id").distinct(), "file_id", "left_semi")
    kept = symbols.join(removed.select("file_id").distinct(), "file_id", "left_anti")
    ids = dead.select("id").unionByName(removed.select(F.col("file_id").alias("id"))).distinct()
    left = chunks.join(dead.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti")
    clean = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, left, clean.select(*edges.columns)


def next_generation(repositories: DataFrame, diff: DataFrame) -> DataFrame:
    """Repositories with the generation raised by one where anything changed."""
    touched = diff.filter("state in ('added', 'changed', 'removed')").select(F.col("repo_id").alias("id")).distinct().withColumn("touched", F.lit(1))
    raised = F.coalesce("generation", F.lit(0)) + F.coalesce("touched", F.lit(0))
    return repositories.join(touched, "id", "left").withColumn("generation", raised).drop("touched")


def run_journal(runs: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, repo_id, kind, state, seconds, errors): each run once with how it ended and how many files failed."""
    r = runs.dropDuplicates(["id"])
    counts = results.select("run_id", F.coalesce(F.size("errors"), F.lit(0)).alias("n")).groupBy("run_id").agg(F.max("n").alias("errors"))
    state = F.when(F.col("finished_at").isNull(), "running").when(F.col("error").isNotNull(), "failed").otherwise("done")
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000
    return r.join(counts, r["id"] == counts["run_id"], "left").select(
        F.col("id").alias("run_id"), "repo_id", "kind", state.alias("state"), seconds.alias("seconds"), F.greatest(F.coalesce("errors", F.lit(0)), F.lit(0)).alias("errors")
    )


def overlapping_runs(runs: DataFrame) -> DataFrame:
    """(run_id, repo_id, n): how many earlier runs of the repository a run overlaps; a run without end overlaps all later ones.

    Counted as starts before minus ends before, in one pass over the runs in time.
    """
    r = runs.dropDuplicates(["id"]).filter("started_at is not null")
    ends = r.filter("finished_at is not null").select("repo_id", F.col("finished_at").alias("t"), F.lit(None).cast("string").alias("run_id"), F.lit(-1).alias("d"))
    both = r.select("repo_id", F.col("started_at").alias("t"), F.col("id").alias("run_id"), F.lit(1).alias("d")).unionByName(ends)
    before = Window.partitionBy("repo_id").orderBy("t", "d", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("n", F.coalesce(F.sum("d").over(before), F.lit(0))).filter("d = 1").select("run_id", "repo_id", "n")
