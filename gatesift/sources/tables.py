"""Tables as inputs of CPU-bound operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, pieces: int | None = None) -> DataFrame:
    """Use all cores for a table that is stored in fewer pieces than there are cores.

    A parquet row group is read by one task, so a small table may be a single task, and
    detectors cost far more than moving its rows once. Tables with at least one piece per
    core, which is every large one, are left alone: no shuffle is added. For a table as it
    is read, with the needed columns selected. A stream doesn't know in how many ``pieces`` its
    files come; it is spread only if that number is given.
    """
    if pieces is None:
        if df.isStreaming:
            return df
        pieces = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if pieces < cores else df
