"""Ranks over whole tables without a single-task sort, and the best rows of many queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.session import cut_lineage, wide_partitions


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: row numbers of the whole table in ``order``.

    Rows are cut into ranges of that order, numbered within each and shifted by the sizes of the ranges before: one row a range.
    """
    parts = cut_lineage(df.repartitionByRange(wide_partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_n", within).join(bases, "_part").withColumn(name, (F.col("_base") + F.col("_n")).cast("int")).drop("_part", "_n", "_base")


#: Scores are ranked as rounded to 9 digits; what lies so near to the last place may still take it.
NEAR = 2e-9


class Best:
    """The ``k`` best rows of each query so far: by score as rounded to 9 digits, then by key. Only scores above ``above`` count, if it is given."""

    def __init__(self, k: int, queries: int, above: float | None = None):
        self.k, self.queries, self.above = k, queries, above
        self.query, self.score, self.near = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.floor = np.full(queries, -np.inf)
        self.keys: pa.Array | None = None

    def add(self, scores: np.ndarray, keys: pa.Array) -> None:
        """``scores`` has a line for each query and a column for each key. What can't be among the best is told by comparisons, so that few scores are ever sorted."""
        least = (self.floor - NEAR)[:, None]
        good = ~(scores < least) if self.above is None else scores >= np.maximum(least, np.nextafter(self.above, np.inf))
        # Read as they lie in memory.
        by_query = good.flags.c_contiguous
        spot = np.flatnonzero(good if by_query else good.T)
        query, row = np.divmod(spot, good.shape[1]) if by_query else np.divmod(spot, good.shape[0])[::-1]
        many = np.flatnonzero(np.bincount(query, minlength=self.queries) > 4 * self.k) if scores.shape[1] > self.k else []
        if len(many):
            last = np.full(self.queries, -np.inf)
            last[many] = np.partition(scores[many], -self.k, axis=1)[:, -self.k]
            kept = ~(scores[query, row] < last[query] - NEAR)
            query, row = query[kept], row[kept]
        if not len(query):
            return
        new, score = keys.take(pa.array(row)), scores[query, row]
        near = np.round(score, 9)
        keys = new if self.keys is None else pa.concat_arrays([self.keys, new])
        query, score, near = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.near, near])
        order = np.lexsort((pc.rank(keys, tiebreaker="dense").to_numpy(), -near, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.keys = keys.take(pa.array(order))
        self.query, self.score, self.near = query[order], score[order], near[order]
        full = rank == self.k - 1
        self.floor[self.query[full]] = self.near[full]
