"""Chat store: history, sessions and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 6


def history(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """(session_id, turn, id, role, content): the last ``n`` messages of each session, oldest first; equal times follow the id."""
    m = messages.filter("session_id is not null").select("session_id", "id", "role", "content", "created_at").distinct()
    late = Window.partitionBy("session_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    kept = m.withColumn("back", F.row_number().over(late)).filter(F.col("back") <= n)
    early = Window.partitionBy("session_id").orderBy(F.desc("back"))
    return kept.withColumn("turn", F.row_number().over(early)).select("session_id", "turn", "id", "role", "content")


def latest_session(sessions: DataFrame) -> DataFrame:
    """(repo_id, id): the newest session of each repository, that is, the implicit one."""
    return sessions.filter("repo_id is not null").groupBy("repo_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def cited(answers: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(key, place, mark): the marks ``S<n>`` that an answer cites, each once, in the order of their first appearance."""
    marks = F.array_distinct(F.regexp_extract_all(content, F.lit(r"\[(S\d+)\]"), F.lit(1)))
    return answers.select(key, F.posexplode(marks).alias("at", "mark")).select(key, (F.col("at") + 1).alias("place"), "mark")


def resolve_citations(answers: DataFrame, blocks: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """``cited`` joined with the context blocks (key, mark, ...); unknown marks are ignored."""
    return cited(answers, key, content).join(blocks, [key, "mark"])


def stored_citations(messages: DataFrame) -> DataFrame:
    """(id, place, file, start_line, end_line) out of ``citations_json``; broken JSON gives nothing."""
    schema = "array<struct<file:string,startLine:int,endLine:int>>"
    m = messages.filter("citations_json is not null").select("id", "citations_json").distinct()
    return m.select("id", F.posexplode(F.from_json("citations_json", schema)).alias("at", "c")).filter("c.file is not null").select(
        "id", (F.col("at") + 1).alias("place"), F.col("c.file").alias("file"), F.col("c.startLine").alias("start_line"), F.col("c.endLine").alias("end_line")
    )
