"""Fusion, reranking, expansion and measures of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import embed_tokens

RRF_K = 60


def reciprocal_rank_fusion(lists: list[tuple[str, DataFrame]], key: str, k: int = RRF_K, by: list[str] | None = None) -> DataFrame:
    """(by..., key, score, provenance, rank) of named ranked lists with (by..., key, rank): the sum of 1/(k + rank).

    An item that stands several times in one list adds each time; provenance has its least rank by list. Terms are added in the
    lists' order. Equal scores follow the key in the order of the locale. No lists or empty ones give no rows.
    """
    by = by or []
    union = reduce(
        DataFrame.unionByName,
        [df.select(*by, key, F.col("rank").cast("int").alias("place"), F.lit(n).alias("no"), F.lit(name).alias("list")) for n, (name, df) in enumerate(lists)],
    )
    fused = union.groupBy(*by, key).agg(
        F.array_sort(F.collect_list(F.struct("no", "place"))).alias("hits"), F.collect_list(F.struct("list", "place")).alias("seen")
    )
    total = F.aggregate("hits", F.lit(0.0), lambda s, h: s + 1.0 / (F.lit(float(k)) + h["place"]))
    names = F.array_sort(F.array_distinct(F.col("seen.list")))
    least = F.map_from_arrays(names, F.transform(names, lambda n: F.array_min(F.transform(F.filter("seen", lambda s: s["list"] == n), lambda s: s["place"]))))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(F.desc("score"), *_locale(fused, key))
    scored = fused.select(*by, key, total.alias("score"), least.alias("provenance"))
    if not by:
        # One list of all items: a global order, found without one task sorting everything.
        return _global_rank(scored, [F.desc("score"), *_locale(scored, key)])
    return scored.withColumn("rank", F.row_number().over(order))


def _locale(df: DataFrame, key: str) -> list[Column]:
    return [F.collate(F.col(key), "UNICODE"), F.col(key)] if dict(df.dtypes)[key] == "string" else [F.col(key)]


def _global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    from thicket.operators.ranking import global_rank

    return global_rank(df, order, "rank")


def rerank_by_overlap(candidates: DataFrame, query: str, content: str, prior: str = "rank", by: list[str] | None = None) -> DataFrame:
    """``candidates`` with (overlap, reranked): how many distinct tokens query and content share; ties keep the prior order. Both are texts or arrays of their tokens."""
    kinds = dict(candidates.dtypes)
    shared = F.size(F.array_intersect(*[F.col(c) if kinds[c].startswith("array") else embed_tokens(F.coalesce(F.col(c), F.lit(""))) for c in (query, content)]))
    scored = candidates.withColumn("overlap", shared)
    if not by:
        from thicket.operators.ranking import global_rank

        return global_rank(scored, [F.desc("overlap"), F.col(prior)], "reranked")
    return scored.withColumn("reranked", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("overlap"), prior)))


def recall_precision(hits: DataFrame, relevant: DataFrame, by: str, key: str, k: int = 5) -> DataFrame:
    """(by, recall, precision) at ``k``: relevant hits by the number expected (at most 1), and by the number of hits."""
    top = hits.filter(F.col("rank") <= k)
    good = relevant.select(by, key).distinct().withColumn("good", F.lit(1))
    counts = top.join(good, [by, key], "left").groupBy(by).agg(F.count("*").alias("hits"), F.count("good").alias("good"))
    expected = good.groupBy(by).agg(F.count("*").alias("expected"))
    return expected.join(counts, by, "left").select(
        by,
        F.least(F.lit(1.0), F.coalesce("good", F.lit(0)) / F.least("expected", F.lit(k))).alias("recall"),
        F.when(F.coalesce("hits", F.lit(0)) == 0, 0.0).otherwise(F.col("good") / F.col("hits")).alias("precision"),
    )


def expansion_scores(reached: DataFrame, decay: float = 0.6, per_seed: int = 20) -> DataFrame:
    """(node, score, seed, distance) from (seed, seed_score, node, distance): nearest ``per_seed`` of each seed, score falling by
    ``decay`` a hop, the best seed kept for each node."""
    near = Window.partitionBy("seed").orderBy("distance", "node")
    kept = reached.filter("distance > 0").withColumn("n", F.row_number().over(near)).filter(F.col("n") <= per_seed)
    scored = kept.withColumn("score", F.col("seed_score") * F.pow(F.lit(decay), F.col("distance")))
    best = F.max_by(F.struct("score", "seed", "distance"), F.struct("score", -F.col("seed_order")))
    return scored.groupBy("node").agg(best.alias("b")).select("node", "b.score", "b.seed", "b.distance")
