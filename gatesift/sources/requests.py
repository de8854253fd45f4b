"""Validation requests in, verdicts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift.operators.cache import to_verdict
from gatesift.schemas import CORRUPT, REQUEST, VERDICT


def _options(format: str) -> tuple[str, dict[str, str]]:
    """The schema to read with, and the options that keep lines that don't fit it."""
    if format != "json":
        return REQUEST, {}
    return f"{REQUEST}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def read_requests(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Requests with their declared schema; nothing is inferred.

    Fields that a JSON request leaves out are NULL. A line that is no JSON, or has a field of another
    kind, stays in as a row with the line in ``corrupt_request``: routing rejects it and keeps it.
    """
    schema, options = _options(format)
    return spark.read.schema(schema).format(format).options(**options).load(path)


def stream_requests(spark: SparkSession, path: str, format: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream of files."""
    schema, options = _options(format)
    reader = spark.readStream.schema(schema).format(format).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def write_verdicts(verdicts: DataFrame, path: str, *extra: str, batch: str = "all") -> None:
    """Write the verdict columns of a batch, partitioned by status so that readers can prune.

    A batch has a folder of its own, which writing it again replaces as a whole: a batch that is
    repeated after a failure, or that has other statuses than before, leaves nothing behind.
    """
    (to_verdict(verdicts, *extra).withColumn("status", F.coalesce("status", F.lit("rejected")))
     .write.mode("overwrite").partitionBy("status").parquet(f"{path.rstrip('/')}/batch={batch}"))


def read_verdicts(spark: SparkSession, path: str, *extra: str) -> DataFrame:
    """Verdicts of all batches; filters on ``batch`` and ``status`` choose the folders to read.

    ``extra`` are the columns written in front, as DDL fields.
    """
    fields = [*extra, *(f"{n} {t}" for n, t in VERDICT.items()), "batch string"]
    rows = spark.read.schema(", ".join(fields)).parquet(path)
    # a rejected request has no verdict
    return rows.withColumn("status", F.nullif(F.col("status"), F.lit("rejected")))
