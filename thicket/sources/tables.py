"""The catalog's tables as Parquet in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``folder/name.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace just the partitions that ``df`` holds (dynamic overwrite): the store's upsert by repository and path."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
