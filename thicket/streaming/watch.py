"""A folder of sources watched by Structured Streaming: each micro-batch is one incremental run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "repo_id string, path string, action string, hash string, at timestamp"


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change events as JSON lines dropped into ``folder``: action is add, change or unlink."""
    return spark.readStream.schema(CHANGES).json(folder)


def settle(batch: DataFrame) -> DataFrame:
    """The last event of each file in a batch: a burst of saves is one change."""
    last = Window.partitionBy("repo_id", "path").orderBy(F.desc("at"), F.desc("action"))
    return batch.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def debounced_bursts(events: DataFrame, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """(repo_id, burst, n, files): bursts of events of a repository, each ended by a gap without any; for batches and streams."""
    source = events.withWatermark("at", late) if events.isStreaming else events
    return source.groupBy("repo_id", F.session_window("at", gap).alias("burst")).agg(F.count("*").alias("n"), F.approx_count_distinct("path").alias("files"))


def watch(changes: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Starts a query that hands each settled batch to ``run(batch, batch_id)``.

    One run at a time is inherent to micro-batches; what arrives meanwhile is the next batch. A failing run is reported and its
    batch stays unprocessed only if there is no ``on_error``. Without ``interval`` it handles what there is and ends.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        try:
            run(settle(batch), batch_id)
        except Exception as e:
            if on_error is None:
                raise
            on_error(e)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
