"""Session helpers: reading tables and cutting lineage between iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; filters and column lists still reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input that arrives in fewer pieces than there are cores.

    One large Parquet row group is one task, however much work follows it. On a
    library of many files this adds nothing to the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fan_out(df: DataFrame, *columns: str) -> DataFrame:
    """Shuffle to the full number of tasks, for little data with much work per row.

    Adaptive execution would merge such partitions by their size; a stated
    number is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster.

    Only a local session without the setting gets a folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would
    not survive the loss of that machine.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"{_CHECKPOINT_KEY} is not set on this cluster")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(_CHECKPOINT_KEY, folder)
    return folder


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The written table ends the lineage, outlives lost executors, and gives the
    next step exact sizes, so broadcast decisions rest on measured bytes. The
    shuffle files of the write are of no use after it, so Spark deletes them at
    once and not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_KEY)
        else:
            spark.conf.set(_CLEANUP_KEY, before)
    written = spark.read.schema(df.schema).parquet(path)
    written.step_path = path
    return written


def together(steps: list[DataFrame]) -> DataFrame:
    """Tables of equal columns that `cut` wrote as one scan; a union of many would grow the plan with each."""
    first = steps[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[s.step_path for s in steps])


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, once everything that reads them has been written itself."""
    for step in tables:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step.step_path)
        path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
