"""Spark session settings this library is designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Verdicts are joined back on content hashes, and one hash may hold a large part
# of all rows: adaptive execution splits such partitions at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a streamed counter's increments are merged in each task before they are shuffled
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app_name: str = "gatesift", master: str | None = None, **conf) -> SparkSession:
    """A session with :data:`SETTINGS`; ``conf`` entries override them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    This is ``spark.checkpoint.dir``. Only a local session may do without it: it
    gets a temporary folder of its own, because no other machine needs to read it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gatesift-"))
    return context.getCheckpointDir()


def local_path(spark: SparkSession, path: str) -> str | None:
    """Where ``open()`` finds a path of the local file system; None in any other store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(target).toUri().getPath() if store.getUri().getScheme() == "file" else None


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lost with no executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
