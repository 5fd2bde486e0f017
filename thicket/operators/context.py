"""Context blocks under a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 12_000


def quarter(text: str) -> int:
    return ceil(len(text) / 4)


def assemble(rows: list[dict], budget: int = BUDGET, count: Callable[[str], int] = quarter) -> tuple[list[dict], int, bool]:
    """(blocks, tokens used, truncated) of the ranked symbols of one question.

    A row has path, start_line, end_line, signature, qualified, doc, code, callers, callees and related (texts or None). If the head
    of a block doesn't fit, assembly ends there; of the rest, each part that doesn't fit is left out alone. Code of one span is
    given once. Rows without a path are unknown symbols and skipped.
    """
    blocks: list[dict] = []
    spans: set[tuple] = set()
    used, truncated = 0, False
    for row in rows:
        if row.get("path") is None:
            continue
        mark = f"S{len(blocks) + 1}"
        lines = [f"[{mark}] {row['path']}:{row['start_line']}-{row['end_line']}", f"signature: {row['signature'] or row['qualified']}"]
        if row.get("doc"):
            lines.append(f"doc: {row['doc']}")
        text = "\n".join(lines)
        tokens = count(text)
        if used + tokens > budget:
            truncated = True
            break
        span = (row["path"], row["start_line"], row["end_line"])
        parts = [("code", None if span in spans else row.get("code")), *((k, row.get(k)) for k in ("callers", "callees", "related"))]
        for kind, part in parts:
            if part:
                more = count("\n\n" + part)
                if used + tokens + more <= budget:
                    text, tokens = f"{text}\n\n{part}", tokens + more
                    if kind == "code":
                        spans.add(span)
        used += tokens
        blocks.append({"mark": mark, "symbol_id": row.get("symbol_id"), "path": row["path"], "start_line": row["start_line"], "end_line": row["end_line"], "text": text, "tokens": tokens})
    return blocks, used, truncated


FIELDS = ["symbol_id", "path", "start_line", "end_line", "signature", "qualified", "doc", "code", "callers", "callees", "related"]


def context_blocks(ranked: DataFrame, budget: int = BUDGET, most: int = 8, count: Callable[[str], int] = quarter) -> DataFrame:
    """(query, mark, symbol_id, path, start_line, end_line, text, tokens, truncated) for many questions at once.

    ``ranked`` has (query, rank) and the fields of ``assemble``; the best ``most`` of each question are gathered in one row, a
    bounded number by construction, and folded there.
    """
    top = ranked.filter(F.col("rank") <= most).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", *FIELDS))).alias("rows"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, rows in zip(batch["query"], batch["rows"]):
                blocks, _, truncated = assemble([dict(r) for r in rows], budget, count)
                out += [{"query": query, **b, "truncated": truncated} for b in blocks]
            yield pd.DataFrame(out, columns=["query", "mark", "symbol_id", "path", "start_line", "end_line", "text", "tokens", "truncated"])

    kind = dict(ranked.dtypes)["query"]
    return top.mapInPandas(fold, f"query {kind}, mark string, symbol_id string, path string, start_line int, end_line int, text string, tokens int, truncated boolean")


#: A text of more lines than this is over any budget: no line takes less than ten characters, four to a token.
MOST_LINES = BUDGET * 4 // 10 + 1


def hierarchy_text(found: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """(seed, text) of callers or callees, by depth and name: one line each with path and signature; ``nodes`` has (id, name, path, signature).

    Of a hub's callers only so many are gathered that the text is over the budget, where assembly leaves it out.
    """
    order = Window.partitionBy("seed").orderBy("depth", "name", "id")
    first = found.join(nodes, "id").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MOST_LINES)
    rows = first.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("_n", "name", "path", "signature"))).alias("x"))
    line = F.transform("x", lambda r: F.concat(F.lit("- "), r["name"], F.lit(" ("), F.coalesce(r["path"], F.lit("?")), F.lit("): "), F.coalesce(r["signature"], r["name"])))
    return rows.select("seed", F.concat(F.lit(f"{label}:\n"), F.array_join(line, "\n")).alias("text"))
