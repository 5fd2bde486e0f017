"""From a question to grounded context: the retrieval pipeline with pluggable models."""

from __future__ import annotations

import itertools
import json
import logging
from collections.abc import Callable
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.errors import ModelError, ValidationError
from thicket.functions.paths import ancestor_dirs
from thicket.operators import bm25, chat, context, fusion, graph, intents, vectors
from thicket.operators.ranking import global_rank
from thicket.plans.codegraph import tables
from thicket.sources.stores import KeywordStore, VectorStore

log = logging.getLogger(__name__)
#: Languages by suffix, as filters name them.
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx"}
NO_CONTEXT = "Not enough indexed context to answer that."


class MockModel:
    """An offline language model: it cycles through given answers."""

    def __init__(self, answers: list[str] | None = None):
        self._answers = itertools.cycle(answers or ["See [S1]."])
        self.prompts: list[str] = []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return next(self._answers)


def rewrite_queries(question: str, model=None) -> list[str]:
    """2 to 4 queries by the model; the question itself where there is no model or its answer isn't such a list."""
    if model is None:
        return [question]
    try:
        queries = json.loads(model.complete(f"Rewrite as 2-4 search queries, as JSON {{\"queries\": [...]}}: {question}"))["queries"]
    except (ModelError, ValueError, KeyError, TypeError) as e:
        log.warning("question isn't rewritten: %s", e)
        return [question]
    sound = isinstance(queries, list) and 2 <= len(queries) <= 4 and all(isinstance(q, str) and q.strip() for q in queries)
    return queries if sound else [question]


def standalone_question(question: str, history: list[tuple[str, str]], model=None) -> str:
    """A follow-up reworded to stand alone; unchanged without history or model, or if the model fails or says nothing."""
    if not history or model is None:
        return question
    try:
        said = "\n".join(f"{role}: {text}" for role, text in history)
        return model.complete(f"{said}\nReword as a standalone question: {question}").strip() or question
    except ModelError as e:
        log.warning("follow-up stays as it is: %s", e)
        return question


@dataclass
class Index:
    """The tables of an index: chunks (id, symbol_id, content, name, path, kind, tokens), symbols, nodes, edges.

    Searches read the stored postings and vectors where there are any, and else what the chunks give.
    """

    chunks: DataFrame
    symbols: DataFrame
    nodes: DataFrame
    edges: DataFrame
    keywords: KeywordStore | None = None
    vectors: VectorStore | None = None
    generation: int = 0

    @classmethod
    def of(cls, stored) -> Index:
        """The index that a ``CodeIndex`` holds."""
        symbols = tables(stored.table("parsed"))["symbols"]
        return cls(stored.table("chunks"), symbols, stored.table("nodes"), stored.table("edges"), stored.keywords, stored.vectors, stored.generation())

    def payload(self) -> DataFrame:
        """(id, kind, path, dirs, language) of each chunk: what searches filter by."""
        suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
        return self.chunks.select("id", "kind", "path", ancestor_dirs(F.col("path")).alias("dirs"), F.element_at(names, suffix).alias("language"))


@dataclass
class Answer:
    content: str
    citations: list[dict]
    blocks: list[dict]
    queries: list[str]
    intent: tuple | None
    grounded: bool = field(default=False)


def _symbols_of(hits: DataFrame) -> DataFrame:
    return hits.withColumn("symbol_id", F.regexp_replace("id", r"~\d+$", "")).select("symbol_id", "score", "rank")


def keyword_hits(index: Index, text: str, k: int = 20, kinds: list[str] | None = None, path_prefix: str | None = None) -> DataFrame:
    """(symbol_id, score, rank): a split symbol stands in the list once for each part. Filters come after the statistics, which are the whole index's."""
    keep = bm25.matches_filters(kinds, path_prefix) if kinds or path_prefix else None
    if index.keywords is not None:
        return _symbols_of(index.keywords.search(text, k, keep))
    postings = bm25.postings(index.chunks, "id", bm25.CHUNK_WEIGHTS, ["kind", "path"])
    return _symbols_of(bm25.search(postings, bm25.corpus_stats(index.chunks, bm25.CHUNK_WEIGHTS), text, "id", k, keep))


def semantic_hits(index: Index, text: str, k: int = 20, kinds: list[str] | None = None, path_prefix: str | None = None, language: str | None = None) -> DataFrame:
    """(symbol_id, score, rank): nearest chunks among those that the filters keep; a path prefix is a folder."""
    spark = index.chunks.sparkSession
    asked = vectors.mock_vectors(spark.createDataFrame([("q", text)], "id string, text string"), "id", "text", keep_empty=True).withColumnRenamed("id", "query")
    rows = index.vectors.vectors() if index.vectors is not None else vectors.mock_vectors(index.chunks, "id", "content", keep_empty=True)
    if kinds or path_prefix or language:
        kept = index.payload().filter(vectors.matches_filters(kinds, path_prefix, language)).select("id")
        rows = rows.join(kept, "id", "left_semi")
    return _symbols_of(vectors.top_k(rows, asked, "id", "vector", k))


def graph_hits(index: Index, question: str, k: int = 20) -> DataFrame | None:
    """(symbol_id, score, graph_path, rank): callers, callees or users of the last candidate that names a node; score 1 / (1 + depth)."""
    intent = intents.hierarchy_intent(question)
    if not intent:
        return None
    kind, names_asked = intent
    known = {r["name"]: r["id"] for r in index.nodes.filter(F.col("name").isin(names_asked)).groupBy("name").agg(F.min("id").alias("id")).collect()}
    seed = next((known[n] for n in reversed(names_asked) if n in known), None)
    if seed is None:
        return None
    one = index.nodes.filter(F.col("id") == seed).select("id")
    found = graph.component_usage(index.nodes, index.edges, one, 3) if kind == "usage" else graph.hierarchy(index.edges, one, ["CALLS"], 2, kind == "callers")
    names = index.nodes.select(F.col("id").alias("symbol_id"), "name")
    start = next(n for n in reversed(names_asked) if n in known)
    depth = F.col("depth").cast("string")
    words = {
        "callers": F.concat(F.coalesce("name", "symbol_id"), F.lit(f" → {start} (depth "), depth, F.lit(")")),
        "callees": F.concat(F.lit(f"{start} → "), F.coalesce("name", "symbol_id"), F.lit(" (depth "), depth, F.lit(")")),
        "usage": F.concat(F.coalesce("name", "symbol_id"), F.lit(f" renders {start}")),
    }
    best = found.groupBy(F.col("id").alias("symbol_id")).agg(F.min("depth").alias("depth")).join(names, "symbol_id", "left")
    best = best.select("symbol_id", (1 / (1 + F.col("depth"))).alias("score"), words[kind].alias("graph_path")).orderBy(F.desc("score"), "symbol_id").limit(k)
    return global_rank(best, [F.desc("score"), F.col("symbol_id")], "rank")


#: Plug-ins by name: a list of (symbol_id, score, rank[, graph_path]) for a question, or None; add one to search in another way.
RETRIEVERS: dict[str, Callable[[Index, str, int], DataFrame | None]] = {"bm25": keyword_hits, "vector": semantic_hits}


def search(
    index: Index, text: str, mode: str = "hybrid", k: int = 10, kinds: list[str] | None = None, path_prefix: str | None = None, language: str | None = None
) -> DataFrame:
    """(symbol_id, score, rank) by keyword, semantic or hybrid search; ``k`` from 1 to 100. All filters hold in each list; keyword search has no language."""
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValidationError(f"unknown mode {mode!r}")
    if not 1 <= k <= 100:
        raise ValidationError("k must be between 1 and 100")
    if mode == "keyword":
        return keyword_hits(index, text, k, kinds, path_prefix)
    if mode == "semantic":
        return semantic_hits(index, text, k, kinds, path_prefix, language)
    lists = [("bm25", keyword_hits(index, text, k, kinds, path_prefix)), ("vector", semantic_hits(index, text, k, kinds, path_prefix, language))]
    fused = fusion.reciprocal_rank_fusion(lists, "symbol_id")
    if language:
        fused = fused.join(index.payload().filter(F.col("language") == language).select(F.regexp_replace("id", r"~\d+$", "").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
    return fused.filter(F.col("rank") <= k)


def expanded(index: Index, seeds: DataFrame, decay: float = 0.6) -> DataFrame:
    """(symbol_id, score, graph_path, rank) of the seeds' surroundings; the path tells seed, hops and end."""
    grown = graph.expand_seeds(index.edges, seeds, decay=decay)
    names = index.nodes.select("id", "name")
    told = (
        grown.join(names.toDF("node", "node_name"), "node", "left")
        .join(names.toDF("seed", "seed_name"), "seed", "left")
        .select(
            F.col("node").alias("symbol_id"), "score",
            F.concat(F.coalesce("seed_name", "seed"), F.lit(" → "), F.coalesce("node_name", "node"), F.lit(" ("), F.col("distance").cast("string"), F.lit(" hops)")).alias("graph_path"),
        )
    )
    return global_rank(told, [F.desc("score"), F.col("symbol_id")], "rank")


def ask(
    index: Index, question: str, model=None, history: list[tuple[str, str]] | None = None, reranker: Callable | None = None, budget: int = context.BUDGET,
    count: Callable[[str], int] = context.quarter, rerank: bool = True, remember: Callable[[str, str], None] | None = None,
) -> Answer:
    """The whole pipeline: rewriting, retrieval, graph, expansion, fusion, reranking, context, answer and citations.

    ``reranker`` orders (symbol_id, rank, content, asked) by a column ``reranked``; with ``rerank`` off the fused order stays. ``count`` counts a text's
    tokens, ``remember`` is given both turns to keep. Only ranks and at most 50 candidates and 8 blocks ever reach the driver.
    """
    asked = question
    question = standalone_question(question, history or [], model)
    queries = rewrite_queries(question, model)
    ranked: list[tuple[str, DataFrame]] = [(name, df) for q in queries for name, retrieve in RETRIEVERS.items() if (df := retrieve(index, q, 20)) is not None]
    seeds = [r for _, df in ranked for r in df.collect()]
    by_graph = graph_hits(index, question)
    if by_graph is not None:
        ranked.append(("graph", by_graph))
    spark = index.chunks.sparkSession
    top = sorted(seeds, key=lambda r: -r["score"])[:10]
    if top:
        rows = spark.createDataFrame([(r["symbol_id"], float(r["score"]), n + 1) for n, r in enumerate(top)], "id string, score double, rank int")
        ranked.append(("expansion", expanded(index, rows)))
    fused = fusion.reciprocal_rank_fusion(ranked, "symbol_id").filter("rank <= 50").select("symbol_id", "rank")
    paths = [df.select("symbol_id", "graph_path", F.lit(n).alias("n")) for n, (_, df) in enumerate(ranked) if "graph_path" in df.columns]
    if paths:
        # The first list that knows a path tells it.
        first = reduce(DataFrame.unionByName, paths).groupBy("symbol_id").agg(F.min_by("graph_path", "n").alias("graph_path"))
        fused = fused.join(first, "symbol_id", "left")
    else:
        fused = fused.withColumn("graph_path", F.lit(None).cast("string"))
    texts = index.chunks.groupBy("symbol_id").agg(F.min_by("content", "id").alias("content"))
    candidates = fused.join(texts, "symbol_id", "left").withColumn("asked", F.lit(question))
    if not rerank:
        ordered = candidates.withColumn("reranked", F.col("rank"))
    else:
        ordered = reranker(candidates) if reranker else fusion.rerank_by_overlap(candidates, "asked", "content")
    best = ordered.filter("reranked <= 8").select("symbol_id", F.col("reranked").alias("rank"), "graph_path")
    blocks = [r.asDict() for r in context_for(index, best, budget, count).collect()]
    paths_of = {r["symbol_id"]: r["graph_path"] for r in best.collect()}
    intent = intents.template_intent(question)
    if not blocks:
        answer = Answer(NO_CONTEXT, [], [], queries, intent)
    else:
        prompt = "\n\n".join(b["text"] for b in blocks)
        said = (model or MockModel()).complete(f"{prompt}\n\nQuestion: {question}")
        marks = {b["mark"]: b for b in blocks}
        cited = [r["mark"] for r in chat.cited(spark.createDataFrame([(0, said)], "id int, content string")).orderBy("place").collect()]
        named = [{**{k: marks[m][k] for k in ("mark", "symbol_id", "path", "start_line", "end_line")}, "graph_path": paths_of.get(marks[m]["symbol_id"])} for m in cited if m in marks]
        answer = Answer(said, named, blocks, queries, intent, True)
    if remember:
        remember("user", asked)
        remember("assistant", answer.content)
    return answer


#: Files that a block's related files name at most.
MOST_RELATED = 10


def related_files(index: Index, ranked: DataFrame) -> DataFrame:
    """(symbol_id, related): the files that import the symbol's file or that it imports, by path."""
    at = ranked.select("symbol_id", F.regexp_extract("symbol_id", "^([^#]*)", 1).alias("file")).distinct()
    imports = graph.of_types(index.edges, ["IMPORTS"]).select("src", "dst")
    files = index.nodes.filter("label = 'File'").select(F.col("id").alias("other"), "path")
    near = at.join(imports.toDF("file", "other"), "file").unionByName(at.join(imports.toDF("other", "file"), "file")).select("symbol_id", "other").distinct().join(files, "other")
    order = Window.partitionBy("symbol_id").orderBy("path")
    first = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MOST_RELATED)
    paths = F.transform(F.array_sort(F.collect_list("path")), lambda p: F.concat(F.lit("- "), p))
    return first.groupBy("symbol_id").agg(F.concat(F.lit("Related files:\n"), F.array_join(paths, "\n")).alias("related"))


def context_for(index: Index, ranked: DataFrame, budget: int = context.BUDGET, count: Callable[[str], int] = context.quarter) -> DataFrame:
    """Context blocks of ``ranked(symbol_id, rank)`` with code, callers, callees and related files."""
    s = index.symbols.dropDuplicates(["id"])
    path = F.regexp_extract("id", "^[^:]*:([^#]*)", 1)
    rows = ranked.join(s.select(F.col("id").alias("symbol_id"), path.alias("path"), "start_line", "end_line", "signature", "qualified", "doc"), "symbol_id", "left")
    code = index.chunks.groupBy("symbol_id").agg(F.min_by("content", "id").alias("code"))
    ids = ranked.select(F.col("symbol_id").alias("id"))
    named = index.nodes.select("id", "name", "path").join(s.select("id", "signature"), "id", "left")
    for label, upward in (("callers", True), ("callees", False)):
        text = context.hierarchy_text(graph.hierarchy(index.edges, ids, ["CALLS"], 2, upward), named, label.capitalize())
        rows = rows.join(text.select(F.col("seed").alias("symbol_id"), F.col("text").alias(label)), "symbol_id", "left")
    rows = rows.join(code, "symbol_id", "left").join(related_files(index, ranked), "symbol_id", "left").withColumn("query", F.lit(0))
    return context.context_blocks(rows, budget, count=count)
