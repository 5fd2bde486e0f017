"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Session settings for a stand-alone run; a cluster's own settings win where it sets them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
#: A scan above this size is never shuffled just to use more cores; parts then come from spark.sql.files.maxPartitionBytes.
MOST_SPREAD = 4 << 30


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the engine's defaults."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``; only where it is unset and the session is local (tests) a folder of our own."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "thicket-checkpoints")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def wide_partitions(spark: SparkSession) -> int:
    """Partitions of an explicit range repartitioning: as many as the session's shuffles use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_partitions(spark: SparkSession) -> int:
    """Partitions for stages that compute much for each row: no fewer than there are cores, whatever adaptive execution would merge."""
    return max(wide_partitions(spark), spark.sparkContext.defaultParallelism)


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes; for a plain scan that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with at least as many partitions as there are cores: shuffled only where its files have too few parts and are small."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if size_of(scan) > MOST_SPREAD or scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
