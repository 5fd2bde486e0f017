"""Indexing as one operator: what changed is parsed, purged, written, indexed and embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.ids import content_hash
from thicket.operators import bm25, indexing, vectors
from thicket.plans.codegraph import edges_of, nodes_of, parse_sources, resolve, tables
from thicket.session import cut_lineage
from thicket.sources.stores import KeywordStore, VectorStore, _files

Progress = Callable[[str, int], None]
TABLES = ("files", "parsed", "chunks", "nodes", "edges")


class CodeIndex:
    """The stored index of repositories in one shared folder.

    Tables are written a generation at a time and become current with the last, tiny write; a run that is cut off leaves the old ones.
    """

    def __init__(self, spark: SparkSession, folder: str, dimensions: int = vectors.DIMENSIONS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.keywords = KeywordStore(spark, f"{self.folder}/postings", "id", bm25.CHUNK_WEIGHTS, ["symbol_id", "repo_id", "kind", "path"])
        self.vectors = VectorStore(spark, f"{self.folder}/vectors", "id", "hash", dimensions, ["symbol_id", "repo_id", "kind", "path"])

    def generation(self) -> int:
        """The current generation; 0 before the first run. Caches of search results are keyed by it."""
        if not _files(self.spark, f"{self.folder}/current"):
            return 0
        return self.spark.read.parquet(f"{self.folder}/current").agg(F.max("generation")).first()[0] or 0

    def table(self, name: str) -> DataFrame | None:
        gen = self.generation()
        return self.spark.read.parquet(f"{self.folder}/tables/{gen}/{name}") if gen else None

    def run(self, sources: DataFrame, progress: Progress | None = None, aliases: list[tuple[str, list[str]]] | None = None) -> dict[str, int]:
        """Brings the index to ``sources(repo_id, path, source)``; the counts of files by state.

        Only added and changed files are parsed, chunked and embedded; those of unchanged content keep their vectors. References are
        resolved anew over all repositories. ``progress`` hears of each stage (discover, parse, graph, embed, done) with the number of files.
        Null sources are unreadable files: they keep what is stored. Repositories that aren't in ``sources`` stay as they are.
        """
        tell = progress or (lambda stage, n: None)
        found = cut_lineage(sources.filter("path is not null").select("repo_id", "path", "source", content_hash(F.col("source")).alias("hash")).dropDuplicates(["repo_id", "path"]))
        stored, old = self.table("files"), self.table("parsed")
        known = found.limit(0).select("repo_id", "path", "hash") if stored is None else stored
        mine = known.join(found.select("repo_id").distinct(), "repo_id", "left_semi")
        diff = cut_lineage(indexing.hash_diff(found, mine))
        counts = {r["state"]: r["n"] for r in diff.groupBy("state").agg(F.count("*").alias("n")).collect()}
        tell("discover", sum(counts.values()))
        fresh_files = diff.filter("state in ('added', 'changed')").select("repo_id", "path")
        touched = counts.get("added", 0) + counts.get("changed", 0)
        if not touched and not counts.get("removed"):
            tell("done", 0)
            return counts
        gone = diff.filter("state in ('removed', 'changed')").select("repo_id", "path")
        fresh = cut_lineage(parse_sources(found.join(fresh_files, ["repo_id", "path"], "left_semi")))
        tell("parse", touched)
        self._write(fresh, found, fresh_files, gone, known, old, aliases, tell, touched)
        tell("done", touched)
        return counts

    def _write(self, fresh, found, fresh_files, gone, known, old, aliases, tell: Progress, touched: int) -> None:
        gen = self.generation() + 1

        def out(df: DataFrame, name: str) -> DataFrame:
            path = f"{self.folder}/tables/{gen}/{name}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)

        parsed = out(fresh if old is None else old.join(gone, ["repo_id", "path"], "left_anti").unionByName(fresh), "parsed")
        kept = known.join(gone, ["repo_id", "path"], "left_anti").select("repo_id", "path", "hash")
        out(kept.unionByName(found.join(fresh_files, ["repo_id", "path"], "left_semi").select("repo_id", "path", "hash")), "files")
        t = tables(parsed)
        out(nodes_of(t), "nodes")
        out(edges_of(t, resolve(t, aliases), aliases), "edges")
        tell("graph", touched)
        symbols = tables(fresh)["symbols"].withColumn("file_id", F.col("file"))
        chunks = indexing.chunk_symbols(symbols, found.withColumn("file_id", F.concat("repo_id", F.lit(":"), "path")))
        named = chunks.join(symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "path").dropDuplicates(["symbol_id"]), "symbol_id").dropDuplicates(["id"])
        prior = self.table("chunks")
        made = cut_lineage(indexing.carry_over(named, prior if prior is not None else named.limit(0).withColumn("embedded_at", F.lit(None).cast("timestamp"))))
        fresh_chunks = made.filter("embedded_at is null")
        if prior is not None:
            left = prior.join(gone, ["repo_id", "path"], "left_anti")
            lost = cut_lineage(prior.select("id").join(left.select("id").unionByName(made.select("id")), "id", "left_anti"))
            if not lost.isEmpty():
                self.keywords.delete(lost)
                self.vectors.delete(lost)
        self.keywords.upsert(bm25.with_tokens_column(made))
        embedded = vectors.mock_vectors(fresh_chunks, "id", "content", self.vectors.dimensions, keep_empty=True)
        self.vectors.upsert(embedded.join(fresh_chunks.select("id", "symbol_id", "repo_id", "kind", "path"), "id"))
        now = made.withColumn("embedded_at", F.coalesce("embedded_at", F.current_timestamp()))
        out(now if prior is None else left.unionByName(now.select(*left.columns)), "chunks")
        tell("embed", touched)
        self.spark.createDataFrame([(gen,)], "generation int").write.mode("append").parquet(f"{self.folder}/current")

    def wipe(self, repo: str) -> None:
        """Removes all of a repository, as before it is indexed from scratch."""
        if not self.generation():
            return
        gen = self.generation() + 1
        for name in ("keywords", "vectors"):
            store = getattr(self, name)
            if store.exists():
                store.delete(store.live_keys().filter(F.col("repo_id") == repo).select("id"))
        for name in TABLES:
            self.table(name).filter(F.col("repo_id") != repo).write.mode("overwrite").parquet(f"{self.folder}/tables/{gen}/{name}")
        self.spark.createDataFrame([(gen,)], "generation int").write.mode("append").parquet(f"{self.folder}/current")
