"""Stored indexes: postings by term and vectors by embedder, with upserts and deletes by key.

Both are append-only folders of generations, so that a write never touches what readers see: ``rows`` (what is searched), ``keys``
(key, generation, further columns; one row for each upserted key) and ``gone`` (key, generation; one row for each deleted one).
A row is live if its generation is its key's newest and no later delete names it. ``compact`` rewrites the live rows as one generation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.errors import ValidationError
from thicket.operators import bm25, vectors
from thicket.session import cut_lineage, shared_folder

#: Folders of terms: a search reads those of its own terms.
BUCKETS = 64


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of a table's files, or of the one file that it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)) if fs.exists(p) else []


def snapshot_folder(spark: SparkSession, tables: list[str], name: str) -> str:
    """A place in the shared folder for what is derived from these tables as their files are now."""
    state = repr([(t, _files(spark, t)) for t in tables])
    return f"{shared_folder(spark)}/thicket-{name}-{hashlib.sha1(state.encode()).hexdigest()[:16]}"


def stored_graph(spark: SparkSession, folder: str, make: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a stored graph, made and written if it isn't there: edges in folders by type, which a search by type prunes to."""
    if not _files(spark, f"{folder}/edges/_SUCCESS"):
        nodes, edges = make()
        nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
    nodes, edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    return nodes, edges.withColumn("type", F.col("type").cast("string"))


class _Generations:
    """Upserts, deletes and the live rows of one store."""

    def __init__(self, spark: SparkSession, folder: str, key: str, keep: list[str] | None = None):
        self.spark, self.folder, self.key, self.keep = spark, folder.rstrip("/"), key, keep or []

    def _generations(self, name: str) -> list[int]:
        """The generations of a part that were written to their end."""
        found = (re.search(r"gen=(\d+)$", n) for n, _, _ in _files(self.spark, f"{self.folder}/{name}"))
        return [int(m[1]) for m in found if m and _files(self.spark, f"{self.folder}/{name}/gen={m[1]}/_SUCCESS")]

    def exists(self) -> bool:
        """Whether anything was ever written; the keys come last, so a write that was cut off doesn't count."""
        return bool(self._generations("keys"))

    def _read(self, name: str) -> DataFrame:
        # What a write that was cut off left behind isn't read.
        gens = self._generations("keys" if name == "rows" else name)
        return self.spark.read.parquet(f"{self.folder}/{name}").filter(F.col("gen").isin(gens))

    def _generation(self) -> int:
        return max([*self._generations("keys"), *self._generations("gone")], default=0)

    def _rows(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    #: Columns by which a generation's rows lie in folders.
    parts: tuple[str, ...] = ()

    def upsert(self, rows: DataFrame) -> None:
        """Writes rows with unique keys; those of a key replace what it had. Null keys are left out."""
        gen = self._generation() + 1
        rows = rows.filter(F.col(self.key).isNotNull())
        self._put(self._rows(rows), self._keys(rows), gen)

    def _put(self, rows: DataFrame, keys: DataFrame, gen: int) -> None:
        # Over what an earlier try left there.
        rows.write.mode("overwrite").partitionBy(*self.parts).parquet(f"{self.folder}/rows/gen={gen}")
        keys.write.mode("overwrite").parquet(f"{self.folder}/keys/gen={gen}")

    def _keys(self, rows: DataFrame) -> DataFrame:
        return rows.select(self.key, *self.keep)

    def delete(self, keys: DataFrame) -> None:
        """Forgets the rows of ``keys``; unknown ones are no fault."""
        gen = self._generation() + 1
        keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct().write.mode("overwrite").parquet(f"{self.folder}/gone/gen={gen}")

    def live_keys(self) -> DataFrame:
        """(key, gen, further columns) of what is live."""
        keys = self._read("keys")
        if keys.select("gen").distinct().limit(2).count() > 1:
            last = F.max_by(F.struct(*[c for c in keys.columns if c != self.key]), "gen")
            keys = keys.groupBy(self.key).agg(last.alias("x")).select(self.key, "x.*")
        if self._generations("gone"):
            gone = self._read("gone").groupBy(self.key).agg(F.max("gen").alias("until"))
            keys = keys.join(gone, self.key, "left").filter("until is null or until < gen").drop("until")
        return keys

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of live keys; where nothing was ever replaced or deleted, all rows are."""
        if len(self._generations("keys")) == 1 and not self._generations("gone"):
            return rows
        return rows.join(self.live_keys().select(self.key, "gen"), [self.key, "gen"], "left_semi")

    def compact(self) -> None:
        """Rewrites the live rows as the one generation there is. Not for use beside other writers."""
        rows, keys = cut_lineage(self._live(self._read("rows")).drop("gen")), cut_lineage(self.live_keys().drop("gen"))
        gen = self._generation() + 1
        self._put(rows, keys, gen)
        for n in range(1, gen):
            for name in ("keys", "rows", "gone"):
                self.wipe(f"{name}/gen={n}")

    def _glob(self, pattern: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return found is not None and len(found) > 0

    def wipe(self, name: str = "") -> None:
        """Removes the store, or one of its parts."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class KeywordStore(_Generations):
    """A full-text index: postings in folders by term, with the columns that searches filter by."""

    def __init__(self, spark: SparkSession, folder: str, key: str, weights: dict[str, float], keep: list[str] | None = None):
        super().__init__(spark, folder, key, keep)
        self.weights = weights

    parts = ("bucket",)

    def _rows(self, rows: DataFrame) -> DataFrame:
        made = bm25.postings(rows, self.key, self.weights, self.keep)
        # A term's postings lie together and sorted, so that a search for it skips the other row groups.
        return made.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(16))).sortWithinPartitions("bucket", "term")

    def _keys(self, rows: DataFrame) -> DataFrame:
        size = bm25.sizes(self.weights)
        return rows.select(self.key, *self.keep, size.alias("size"))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(key, further columns, term, tf, size) of live rows; of some terms, only their folders are read."""
        if not self._glob("rows/gen=*/bucket=*"):
            # Nothing that was written has a token.
            none = self._read("keys").limit(0).select(self.key, *self.keep)
            return none.select("*", F.lit("").alias("term"), F.lit(0.0).alias("tf"), F.lit(0).alias("size"))
        rows = self._read("rows")
        if terms is not None:
            spots = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(spots) & F.col("term").isin(terms))
        return self._live(rows).drop("gen", "bucket")

    def stats(self) -> DataFrame:
        return self.live_keys().agg(F.count("*").alias("n"), F.avg("size").alias("avgdl"))

    def search(self, text: str, k: int = 20, keep: Column | None = None) -> DataFrame:
        """(key, score, rank) of one text."""
        return bm25.search(self.postings(bm25.terms_of(self.spark, text)), self.stats(), text, self.key, k, keep)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class VectorStore(_Generations):
    """A collection of vectors of one embedder and width; searches filter by the payload's columns before they rank."""

    def __init__(self, spark: SparkSession, folder: str, key: str, embedder: str, dimensions: int, keep: list[str] | None = None):
        if dimensions < 1:
            raise ValidationError("a collection needs at least one dimension")
        super().__init__(spark, f"{folder.rstrip('/')}/{embedder}-{dimensions}", key, keep)
        self.dimensions = dimensions

    def _rows(self, rows: DataFrame) -> DataFrame:
        # Vectors of another width belong to another collection.
        return rows.filter(F.size("vector") == self.dimensions).select(self.key, *self.keep, "vector")

    def vectors(self) -> DataFrame:
        return self._live(self._read("rows")).drop("gen")

    def search(self, queries: DataFrame, k: int = 20, keep: Column | None = None, query_key: str = "query") -> DataFrame:
        """(query, key, score, rank) of ``queries(query, vector)``."""
        rows = self.vectors()
        return vectors.top_k(rows if keep is None else rows.filter(keep), queries, self.key, "vector", k, query_key)

    def fit(self, cells: int | None = None) -> np.ndarray:
        return vectors.fit_cells(self.vectors(), self.key, "vector", cells)
