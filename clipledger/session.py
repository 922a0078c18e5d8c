"""Session set-up and the shared folder that cut-off points and tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# On a cluster shuffles start this fine and AQE joins small partitions, so that partitions of a
# 100 TB shuffle are some gigabytes at most without a setting per job.
CLUSTER_CONF = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "32768"}


def build_session(app: str = "clipledger", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library is tuned for. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_CONF)
    if not (master or "").startswith("local"):
        settings.update(CLUSTER_CONF)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. A temporary one is made only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="clipledger-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def reading_tasks(spark: SparkSession) -> int:
    """Tasks for small rows that each stand for much file reading."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, spark.sparkContext.defaultParallelism)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused folder below the shared one."""
    return f"{checkpoint_root(spark)}/clipledger/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, with its lineage cut."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
