"""Problem 7: records of several sources mixed to target shares of the total size."""

from __future__ import annotations

import marshal
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.subjects import assign_matched, listed, passages_of
from thicket.llm.tokens import LEAF, TOKENIZERS, VOCABULARY, coder, encode_tree
from thicket.session import cut_lineage, spread

#: Cells of (source, language, topic) that are broadcast to the documents; more are joined by a shuffle, with the same result.
MOST_CELLS = 200_000
#: Bins of the sampling variable in which thresholds are calibrated for each source.
BINS = 4_096
ROUNDS = 200


def source_name(source: Column) -> Column:
    """Source names as in the targets: lower case, trimmed, joined by hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "-")


def language_name(lang: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(lang)), "^[a-z]{2,3}", 0), F.lit("")), F.lit("und"))


def measure(
    documents: DataFrame, labels: DataFrame | None = None, subjects: DataFrame | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of each document; topic is the subject with the best score as problem 8 assigns them, or 'none'.

    Texts are read once, for tokens and terms together; without texts the rows are written to the shared folder. Rows that repeat a
    doc_id share their topic.
    """
    extra = listed(subjects)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, decode = coder(folder, vocabulary)
        for batch in batches:
            tokens, found, terms = [], [], []
            for text in batch["text"]:
                tokens.append(len(encode_tree(text, encode, decode, LEAF)) if text else 0)
                passages = passages_of(text, extra) if text else []
                found.append(marshal.dumps(passages) if passages else None)
                terms.append(sorted({k for p in passages for _, _, unit in p for k in unit}))
            yield batch[["doc_id", "source", "lang"]].assign(tokens=tokens, found=found, terms=terms)

    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), language_name(F.col("lang")).alias("lang"), "text"
    )
    sized = cut_lineage(spread(rows).mapInPandas(measured, "doc_id bigint, source string, lang string, tokens long, found binary, terms array<int>"))
    assigned = assign_matched(sized.filter("found is not null and doc_id is not null"), labels, extra)
    topics = assigned.groupBy("doc_id").agg(F.max(F.struct("score", "subject")).alias("best")).select("doc_id", F.col("best.subject").alias("topic"))
    return cut_lineage(
        sized.select("doc_id", "source", "lang", "tokens").join(topics, "doc_id", "left").select(
            "doc_id", "source", "lang", F.coalesce("topic", F.lit("none")).alias("topic"), "tokens"
        )
    )


def rake(
    size: np.ndarray, keys: list[np.ndarray], goals: list[np.ndarray], caps: np.ndarray, rounds: int = ROUNDS, tolerance: float = 1e-9
) -> np.ndarray:
    """Weights of cells by iterative proportional fitting.

    ``size`` has the cells' tokens, ``keys`` their index in each dimension, ``goals`` the tokens wanted for each index; the
    first dimension (source) is met last in each round and exactly, as far as ``caps`` allow: what a capped cell can't give,
    the source's other cells give.
    """
    weight = np.minimum(np.ones(len(size)), caps)
    for _ in range(rounds):
        old = weight.copy()
        for key, goal in zip(keys[1:], goals[1:]):
            now = np.bincount(key, weight * size, len(goal))
            weight = np.minimum(weight * np.where(now > 0, goal / np.maximum(now, 1e-12), 1.0)[key], caps)
        for _ in range(64):
            now = np.bincount(keys[0], weight * size, len(goals[0]))
            ratio = np.where(now > 0, goals[0] / np.maximum(now, 1e-12), 1.0)
            room = weight < caps
            spare = np.bincount(keys[0], np.where(room, weight * size, 0.0), len(goals[0]))
            factor = np.where(ratio > 1, 1 + (goals[0] - now) / np.maximum(spare, 1e-12), ratio)
            grown = np.where((ratio[keys[0]] > 1) & ~room, weight, np.minimum(weight * factor[keys[0]], caps))
            if np.abs(grown - weight).max(initial=0.0) < tolerance:
                break
            weight = grown
        if np.abs(weight - old).max(initial=0.0) < 1e-7:
            break
    return weight


def goals_of(targets: DataFrame) -> DataFrame:
    """(source, share, cap) of each source with a target; where a source has several, its largest share and cap."""
    return (
        targets.filter("source is not null and target_share > 0")
        .groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("double").alias("cap"))
    )


def plan_mixture(measured: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, repeats): how many times each used document enters the mixture.

    Only sources with a target take part; a target without documents can't be met and leaves the others their proportions.
    ``total_tokens`` is by default the most at which every source reaches its share within ``max_repeats``; a larger one
    leaves scarce sources short, which the report shows. Tokens are raked to the sources' targets and to the languages' and
    topics' shares among all documents of these sources. A document's weight w gives it floor(w) copies and one more if its hash
    falls under a threshold, calibrated for each source so that its tokens come to the goal. Documents without tokens aren't
    used; repeated doc_ids are one document each row. Empty tables give no rows.

    All cells of (source, language, topic) are raked, however many there are. The driver holds one sum of tokens for each: sources are
    those of the targets, topics those of the vocabulary and the list, and a language is a code of 2 or 3 letters.
    """
    spark = measured.sparkSession
    goals = goals_of(targets)
    used = measured.filter("tokens > 0").join(goals, "source")
    cells = used.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).join(goals, "source").orderBy("source", "lang", "topic").toArrow().to_pandas()
    if cells.empty:
        return measured.limit(0).withColumn("repeats", F.lit(0))
    source, names = pd.factorize(cells["source"])
    first = cells.drop_duplicates("source")
    share, cap = first["share"].to_numpy(float), first["cap"].to_numpy(float)
    share = share / share.sum()
    size = cells["tokens"].to_numpy(float)
    have = np.bincount(source, size, len(names))
    total = float(total_tokens) if total_tokens else float((cap * have / share).min())
    keys, wanted = [source], [np.minimum(share * total, cap * have)]
    for column in ("lang", "topic"):
        codes, values = pd.factorize(cells[column])
        keys.append(codes)
        goal = np.bincount(codes, size, len(values))
        wanted.append(goal / goal.sum() * wanted[0].sum())
    cells["weight"] = rake(size, keys, wanted, cap[source])
    cells["base"] = np.floor(cells["weight"] + 1e-9)
    cells["part"] = (cells["weight"] - cells["base"]).clip(lower=0)
    cells["goal"] = wanted[0][source]
    table = spark.createDataFrame(pa.Table.from_pandas(cells[["source", "lang", "topic", "base", "part", "goal"]], preserve_index=False))
    if len(cells) <= MOST_CELLS:
        table = F.broadcast(table)
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = used.select("doc_id", "source", "lang", "topic", "tokens").join(table, ["source", "lang", "topic"]).withColumn(
        "v", F.when(F.col("part") > 1e-9, unit / F.col("part"))
    )
    drawn = drawn.withColumn("bin", F.when(F.col("v").isNull(), -1).otherwise(F.least(F.floor(F.col("v") * (BINS // 4)), F.lit(BINS - 1))))
    # At most BINS + 1 sums a source; the edge is the bin where their running sum comes nearest to what is left of the goal.
    sums = drawn.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("base")).alias("sure"), F.first("goal").alias("goal"))
    whole = Window.partitionBy("source")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = sums.withColumn("left", F.col("goal") - F.sum("sure").over(whole)).withColumn(
        "reached", F.sum(F.when(F.col("bin") >= 0, F.col("tokens")).otherwise(0)).over(upto)
    )
    here = F.struct(F.abs(F.col("reached") - F.col("left")).alias("off"), F.col("bin").alias("edge"))
    none = F.struct(F.abs(F.col("left")).alias("off"), F.lit(-1).cast("long").alias("edge"))
    edges = steps.groupBy("source").agg(F.min(F.least(here, none)).alias("best")).select("source", F.col("best.edge").alias("edge"))
    return (
        # One row a source with a target.
        drawn.join(F.broadcast(edges), "source")
        .withColumn("repeats", (F.col("base") + F.when((F.col("bin") >= 0) & (F.col("bin") <= F.col("edge")), 1).otherwise(0)).cast("int"))
        .filter("repeats > 0")
        .select("doc_id", "source", "lang", "topic", "tokens", "repeats")
    )


def reached_marginals(mixture: DataFrame, measured: DataFrame, targets: DataFrame) -> DataFrame:
    """(dimension, value, target_share, actual_share) of sources, languages and topics: what the mixture was raked to and what it has."""
    goals = goals_of(targets)
    of_targets = measured.filter("tokens > 0").join(goals, "source")
    met = of_targets.select("source", "share").distinct()
    asked = met.select(F.lit("source").alias("dimension"), F.col("source").alias("value"), F.col("share").alias("n"))
    got = None
    for dimension, column in (("source", "source"), ("language", "lang"), ("topic", "topic")):
        if column != "source":
            asked = asked.unionByName(of_targets.groupBy(F.lit(dimension).alias("dimension"), F.col(column).alias("value")).agg(F.sum("tokens").cast("double").alias("n")))
        part = mixture.groupBy(F.lit(dimension).alias("dimension"), F.col(column).alias("value")).agg(F.sum(F.col("tokens") * F.col("repeats")).cast("double").alias("n"))
        got = part if got is None else got.unionByName(part)

    def shares(rows: DataFrame, name: str) -> DataFrame:
        totals = rows.groupBy("dimension").agg(F.sum("n").alias("total"))
        # Three rows by construction.
        return rows.join(F.broadcast(totals), "dimension").select("dimension", "value", (F.col("n") / F.col("total")).alias(name))

    return shares(asked, "target_share").join(shares(got, "actual_share"), ["dimension", "value"], "left").na.fill(0.0, ["actual_share"])


def reached_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, copies, tokens, actual_share) of each target; zero where nothing was to be had."""
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").dropDuplicates(["source"])
    got = mixture.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("repeats").alias("copies"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most")
    )
    both = goal.join(got, "source", "left").na.fill(0, ["documents", "copies", "tokens", "most"])
    whole = got.agg(F.sum("tokens").alias("whole"))
    return both.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "documents", "copies", "tokens", F.col("most").alias("most_repeats"),
        F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
    )


def mixture_of(documents: DataFrame, targets: DataFrame, labels: DataFrame | None = None, subjects: DataFrame | None = None, total_tokens: int | None = None) -> DataFrame:
    """The mixture of ``documents``; texts are measured once and written to the shared folder, without the texts."""
    return plan_mixture(measure(documents, labels, subjects), targets, total_tokens)
