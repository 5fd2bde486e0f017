"""Results as JSON or lines of text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    """(json): one document a row, columns in their order, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("json"))


def to_lines(df: DataFrame, separator: str = "  ") -> DataFrame:
    """(line): one line a row; line ends inside values are spaces, nulls a dash."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "), F.lit("-")) for c in df.columns]
    return df.select(F.concat_ws(separator, *cells).alias("line"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a line, in as many files as ``df`` has partitions."""
    to_json(df).write.mode("overwrite").text(path)


def stream(df: DataFrame, pretty: bool = False) -> Iterator[str]:
    """Documents for a terminal, a partition at a time: never all of them on the driver."""
    return (r["json"] for r in to_json(df, pretty).toLocalIterator())
