"""Sources with what the catalog knows of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.session import spread_partitions

# Names of languages as they are spelt in the catalog, and suffixes that tell a language.
ALIASES = {
    "javascript": "javascript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ecmascript": "javascript", "node": "javascript",
    "typescript": "typescript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "jsx": "jsx", "javascriptreact": "jsx", "tsx": "tsx", "typescriptreact": "tsx", "json": "json", "other": "other",
}
SUFFIXES = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "jsx": "jsx", "tsx": "tsx", "json": "json", "map": "json",
}


def _lookup(key: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def language_of(language: Column, path: Column) -> Column:
    """javascript, typescript, jsx, tsx, json or other. A full name in ``language`` tells it; for null or an alias, the path does."""
    said = F.lower(F.trim(language))
    plain = said.isin("javascript", "typescript", "jsx", "tsx", "json", "other")
    by_path = _lookup(F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)), SUFFIXES)
    return F.coalesce(F.when(plain, said), by_path, _lookup(said, ALIASES), F.lit("other"))


def sources_of(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, repo_id, rel_path, language, source) of each file with a source.

    Rows of files are reduced to one for each id. Sources are joined as they are, copies included: what is made of them is
    reduced later, when it is small. A source without a file row takes repository and path from its id, ``repo:path``.
    """
    one = files.filter("id is not null").groupBy(F.col("id").alias("file_id")).agg(
        F.min("repo_id").alias("repo_id"), F.min("rel_path").alias("rel_path"), F.min("language").alias("language")
    )
    texts = sources.select("file_id", "source").filter("file_id is not null and source is not null")
    # The join's own shuffle, with its number of partitions fixed: the parsing that follows needs all cores.
    texts = texts.repartition(spread_partitions(sources.sparkSession), "file_id")
    joined = texts.join(one, "file_id", "left").select(
        "file_id",
        F.coalesce("repo_id", F.substring_index("file_id", ":", 1)).alias("repo_id"),
        F.coalesce("rel_path", F.regexp_extract("file_id", "^[^:]*:(.*)$", 1)).alias("rel_path"),
        "language",
        "source",
    )
    return joined.withColumn("language", language_of(F.col("language"), F.col("rel_path")))
