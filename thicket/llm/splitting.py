"""Problem 5: oversized items cut at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.tokens import TOKENIZERS, coder
from thicket.operators.indexing import WINDOW_LINES, WINDOW_STEP

LIMIT, OVERLAP = 4_000, 200
_LINE = re.compile(r"\r\n|\n|\r")
_WORD = re.compile(r"\s+|(?<=[;,.!?)}\]>])")


def boundaries(text: str, starts: list[int]) -> list[tuple[int, list[int]]]:
    """(rank, sorted offsets): 0 where an enclosed definition starts or ends, 1 after blank lines, 2 after lines, 3 between words."""
    lines = [0]
    for m in _LINE.finditer(text):
        lines.append(m.end())
    own = sorted({lines[k] for k in starts if 0 < k < len(lines)})
    blank = [b for a, b in zip(lines, lines[1:]) if not text[a:b].strip()]
    return [(0, own), (1, blank), (2, lines[1:])]


def token_sums(text: str, encode: Callable[[str], list[int]], decode: Callable[[list[int]], bytes]) -> list[int]:
    """For each offset of ``text`` how many tokens start before it; a token that starts inside a character counts from the next one."""
    starts, at = [], 0
    for token in encode(text):
        starts.append(at)
        at += len(decode([token]))
    sums, k, byte = [], 0, 0
    for c in text:
        while k < len(starts) and starts[k] < byte:
            k += 1
        sums.append(k)
        byte += len(c.encode("utf-8", "surrogatepass"))
    sums.append(len(starts))
    return sums


def split_text(text: str, starts: list[int] | None = None, limit: int = LIMIT, overlap: int = OVERLAP, sums: list[int] | None = None) -> list[tuple[int, int]]:
    """[start, end) of the pieces of ``text``: each at most ``limit`` code points, each but the first starting ``overlap`` before
    the end of the one before. A text within the limit is one piece.

    ``sums`` are prefix sums of another measure, one for each offset from 0 on and for the end; limit and overlap are then in that
    measure, and an offset is found by binary search in them. An overlap is at least what was asked for where it would part a unit, and
    a single character over the limit is a piece of its own.

    A cut is the last boundary of the best rank found in the second half of the piece, else the last one of any rank beyond
    the overlap, else the limit itself; a hard cut never parts CR from LF, or a mark from the letter that it combines with.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    n = len(text)
    own = range(n + 1) if sums is None else sums
    if own[n] <= limit:
        return [(0, n)]
    ranks = boundaries(text, starts or [])
    pieces, at, done = [], 0, 0
    while own[n] - own[at] > limit:
        here = own[at]
        # Each piece ends beyond the one before.
        most = max(bisect_right(own, here + limit) - 1, done + 1)
        half = min(max(bisect_left(own, here + limit // 2), done + 1), most)
        least = min(max(bisect_left(own, here + overlap + 1), done + 1), most)
        cut = None
        for floor in (half, least):
            for _, offsets in ranks:
                k = bisect_right(offsets, most) - 1
                if k >= 0 and offsets[k] >= floor and k >= bisect_left(offsets, floor):
                    cut = offsets[k]
                    break
            if cut is not None:
                break
        if cut is None:
            spaces = [m.end() for m in _WORD.finditer(text, half, most) if half <= m.end() <= most]
            cut = spaces[-1] if spaces else most
            while not spaces and cut > half and (text[cut - 1 : cut + 1] == "\r\n" or _joins(text[cut])):
                cut -= 1
        pieces.append((at, cut))
        # Back by the overlap, but never as far as the piece before began.
        at, done = max(bisect_right(own, own[cut] - overlap) - 1, at + 1) if overlap else cut, cut
    pieces.append((at, n))
    return pieces


def _joins(c: str) -> bool:
    return "̀" <= c <= "ͯ" or "︀" <= c <= "️" or c == "‍" or "\U0001f3fb" <= c <= "\U0001f3ff"


def split_oversized(
    chunks: DataFrame, symbols: DataFrame | None = None, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, folder: str = TOKENIZERS
) -> DataFrame:
    """(chunk_id, piece, start, content): the ordered pieces of each chunk longer than ``limit`` code points, or tokens of a ``vocabulary``.

    ``symbols`` gives natural boundaries: lines where definitions inside the chunk's own one start or end. A chunk opens with
    header lines before the source line ``start_line``; the offset is found from the end, as both end on ``end_line``. A part (``~N``)
    has the lines of its window; where it has another number of lines, it is cut at its own ones only. Copies of a chunk count
    once; contents that differ under one id are each cut, in a stable order of hash. Null and short contents give no rows. Only
    oversized rows are shuffled or reach Python.
    """
    # A token has at least one byte, so no text of fewer bytes has more tokens.
    size = F.length("content") if vocabulary is None else F.octet_length("content")
    big = chunks.select(F.col("id").alias("chunk_id"), "symbol_id", "content").filter(size > limit).distinct()
    none = F.array().cast("array<int>")
    if symbols is None:
        cut = big.withColumn("edges", none).withColumn("first", F.lit(None).cast("int")).withColumn("last", F.lit(None).cast("int"))
    else:
        s = symbols.select("id", "file_id", F.col("start_line").cast("int").alias("a"), F.col("end_line").cast("int").alias("b"))
        spans = s.filter("a is not null and b >= a and file_id is not null").distinct()
        owner = big.select("symbol_id").distinct().join(spans.withColumnRenamed("id", "symbol_id"), "symbol_id")
        inner = (
            owner.join(spans.select("file_id", "id", F.col("a").alias("x"), F.col("b").alias("y")), "file_id")
            .filter("x >= a and y <= b and id <> symbol_id")
            .groupBy("symbol_id")
            .agg(F.array_union(F.collect_set("x"), F.collect_set(F.col("y") + 1)).alias("edges"))
        )
        lines = owner.groupBy("symbol_id").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        part = F.regexp_extract("chunk_id", r"~(\d+)$", 1).try_cast("int")
        begin = F.col("a") + F.coalesce(part, F.lit(0)) * WINDOW_STEP
        cut = (
            big.join(lines, "symbol_id", "left")
            .join(inner, "symbol_id", "left")
            .withColumn("first", begin)
            .withColumn("last", F.when(part.isNull(), F.col("b")).otherwise(F.least("b", begin + WINDOW_LINES - 1)))
            .withColumn("edges", F.coalesce("edges", none))
        )
    cut = cut.select("chunk_id", "content", "edges", "first", "last")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, decode = coder(folder, vocabulary) if vocabulary else (None, None)
        for batch in batches:
            out = []
            for chunk_id, text, edges, first, last in zip(batch["chunk_id"], batch["content"], batch["edges"], batch["first"], batch["last"]):
                starts = own_lines(chunk_id, text, edges, first, last) if len(edges) and not pd.isna(last) else []
                sums = token_sums(text, encode, decode) if vocabulary else None
                found = split_text(text, starts, limit, overlap, sums)
                if len(found) > 1:
                    out += [(chunk_id, k, a, text[a:b]) for k, (a, b) in enumerate(found)]
            yield pd.DataFrame(out, columns=["chunk_id", "piece", "start", "content"])

    return cut.mapInPandas(pieces, "chunk_id string, piece int, start int, content string")


def own_lines(chunk_id: str, text: str, edges: Iterable[int], first: int, last: int) -> list[int]:
    """The lines of a chunk's text, from 0 on, where source lines ``edges`` lie; none for a part that hasn't the lines of its window."""
    total = len(_LINE.findall(text)) + (not text.endswith(("\n", "\r")))
    if re.search(r"~\d+$", chunk_id):
        header = next((k + 1 for k, line in enumerate(text.split("\n")[:8]) if line.startswith("// part ")), 0)
        if total - header != last - first + 1:
            return []
    return [int(total - (last + 1 - e)) for e in edges if first < e <= last]
