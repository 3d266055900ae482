"""Session helpers: scale settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

# Runtime SQL settings the operators rely on for skewed joins and right-sized shuffles.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffled quads shrink to a tenth, so the default 64 MB would be most of a GB in one task's memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m",
}

# Rows of a table that one task takes before they become many statements each.
ROWS_PER_TASK = 25_000


def configure(spark: SparkSession) -> SparkSession:
    """Turn on adaptive execution with skew-join splitting for this session."""
    for key, value in SCALE_CONF.items():
        spark.conf.set(key, value)
    return spark


def spread(table: DataFrame) -> DataFrame:
    """A freshly read table over at least as many tasks as there are cores.

    For work that is heavy per row: a file with fewer splits than cores would keep the others
    idle. A table with enough splits, as any large one has, is returned as it is.
    """
    if table.isStreaming:
        return table
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def dealt(table: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """A table in tasks of about ``rows`` rows, however few splits its files have.

    For work that makes many rows of one, or is heavy per row. The rows are counted first and dealt by
    a hash of their columns (no sort, and the same on a retry); what fits into one task stays as it is.
    """
    if table.isStreaming:
        return table
    tasks = -(-table.count() // rows)
    if tasks <= 1:
        return table
    keys = [F.col("`" + f.name.replace("`", "``") + "`") for f in table.schema.fields
            if isinstance(f.dataType, AtomicType)]
    tasks = max(tasks, table.sparkSession.sparkContext.defaultParallelism)
    return table.repartition(tasks, *keys) if keys else table.repartition(tasks)


def parallel_tasks(df: DataFrame) -> int:
    """Shuffle width of the session: a number given explicitly is not merged for small data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a single-machine session that names none gets a temporary one; on a cluster a machine-local
    folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tablegraph-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
