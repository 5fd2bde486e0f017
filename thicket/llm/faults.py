"""Problem 2: source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.files import sources_of
from thicket.llm.js_parser import fault
from thicket.parse.words import DIALECTS


def parse_flags(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, valid, line, message): one row for each file of a known language that has a source.

    Each text is read whole by the table-driven parser of its language; ``line`` and ``message`` tell the first error that it
    couldn't go on from. The language is that of the files row or, where it is null or an alias, that of the path. Null sources
    and other languages give no row, an empty script is valid, an empty JSON text isn't. Copies count once; where texts of one
    file differ, the first fault by line makes it invalid.
    """
    texts = sources_of(files, sources).filter(F.col("language").isin(*DIALECTS, "json"))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, repo, language, text in zip(batch["file_id"], batch["repo_id"], batch["language"], batch["source"]):
                found = fault(text, language)
                if found:
                    out.append((file, repo, language, False, text.count("\n", 0, found[0]) + 1, found[1][:200].encode("utf-8", "replace").decode()))
                else:
                    out.append((file, repo, language, True, None, None))
            yield pd.DataFrame(out, columns=["file_id", "repo_id", "language", "valid", "line", "message"])

    rows = texts.mapInPandas(parsed, "file_id string, repo_id string, language string, valid boolean, line int, message string")
    first = F.min(F.struct("valid", "line", "message"))
    return rows.groupBy("file_id", "repo_id", "language").agg(first.alias("f")).select(
        "file_id", "repo_id", "language", "f.valid", "f.line", "f.message"
    )


def fault_rates(flags: DataFrame) -> DataFrame:
    """(repo_id, language, files, faulty, rate) of each repository and language."""
    return (
        flags.groupBy("repo_id", "language")
        .agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("faulty"))
        .withColumn("rate", F.col("faulty") / F.col("files"))
    )
