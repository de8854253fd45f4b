"""The cache table on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatesift.schemas import CACHE_DDL, CACHE_ENTRY


def write_cache(cache: DataFrame, path: str, mode: str = "append") -> None:
    """Write entries, partitioned so that clears and censuses by type or level prune."""
    cache.select(*CACHE_ENTRY).write.mode(mode) \
        .partitionBy("analysis_type", "security_level").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE_DDL).parquet(path).select(*CACHE_ENTRY)
