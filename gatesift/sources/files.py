"""Raw files as a source, and their analysis."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions import payload as P
from gatesift.operators.analyze import (
    Expression,
    analyze,
    as_column,
    failed_analysis,
    oversize_analysis_sql,
    unavailable_analysis,
)
from gatesift.session import local_path

# What opening a file counts for and what files of a task come to, where files are dealt out over tasks.
OPEN_COST_BYTES = 16 * 1024
TASK_BYTES = 32 * 1024 * 1024


def write_files(lines: DataFrame, path: str) -> None:
    """Text files, one for each value of the first column; the second has their lines.

    The rows of a file come together and in order. Its path below ``path`` has ``<column>=<value>`` in
    it. In a local file system tasks write files with plain calls, into a folder a task: Hadoop's
    starts processes for every file, to set modes, and a folder a file takes long to list. Other
    stores get Spark's files, a folder each; tasks put them in place themselves, as the driver would
    do so one folder after another.
    """
    name, line = lines.columns
    folder = local_path(lines.sparkSession, path)
    if folder is None:
        (lines.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy(name).text(path))
        return
    os.makedirs(folder)
    # as bytes: a line is written as it is, and need not be valid UTF-8
    named = lines.select(F.col(name).cast("string"), F.col(line).cast("binary"))
    named.mapInArrow(_file_writer(folder, name), "files BIGINT").write.format("noop").mode("overwrite").save()


def _file_writer(folder: str, column: str) -> Callable:
    """Writes the files of a partition, as a closure that ships by value."""

    def write(batches):
        import os
        from itertools import groupby
        from urllib.parse import quote

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        below, count = f"{folder}/part-{task.partitionId():05d}", 0
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for key, group in groupby(rows, lambda row: row[0]):
            os.makedirs(below, exist_ok=True)
            name = f"{column}={quote(key, safe='') if key else '__HIVE_DEFAULT_PARTITION__'}"
            # readers skip hidden files, so they see none that is broken off; another attempt writes the same ones
            hidden = f"{below}/.{task.taskAttemptId()}"
            with open(hidden, "wb") as file:
                for _, line in group:
                    file.write(line or b"")
                    file.write(b"\n")
            os.replace(hidden, f"{below}/{name}")
            count += 1
        yield pa.RecordBatch.from_pydict({"files": [count]})

    return write


def read_files(spark: SparkSession, path: str, max_bytes: int = rules.MAX_BYTES) -> DataFrame:
    """``path``, ``length`` and ``content`` of files; a missing path is an error.

    The bytes of files beyond the limit are never read: their verdict needs none, so
    their content is NULL.
    """
    return _within(_files_below(spark, path), max_bytes)


def _files_below(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder and of the folders in it: listed once, no columns taken from folder names.

    Spark counts every file as 4 MB more than it has, so 32 small ones were a task. How files are dealt out
    is a setting of the session that lists them: a copy of this one, in which they count by their bytes.
    """
    copied = spark._jsparkSession.cloneSession()
    dealing = type(spark)(spark.sparkContext, copied)
    dealing.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST_BYTES))
    most = min(TASK_BYTES, copied.sessionState().conf().filesMaxPartitionBytes())
    dealing.conf.set("spark.sql.files.maxPartitionBytes", str(most))
    files = dealing.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # a union belongs to the session of its first part; the optimizer removes the empty one
    types = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in files.schema)
    return spark.sql(f"SELECT {types} WHERE false").unionByName(files)


def _within(files: DataFrame, max_bytes: int) -> DataFrame:
    small = files.filter(F.col("length") <= max_bytes).select("path", "length", "content")
    large = files.filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def read_listed_files(spark: SparkSession, path: str, listed: DataFrame, key: Column,
                      max_bytes: int = rules.MAX_BYTES) -> DataFrame:
    """Files below a folder, and the ones that a table lists but that aren't there.

    ``key`` takes from a ``path`` what ``listed`` (one column) names a file by. Returns that column,
    ``path``, ``length``, ``content`` and ``error``, which says what is missing: no file stops the
    others. Which files are there is found by their paths alone; contents are not moved.
    """
    name = listed.columns[0]
    kind = listed.schema[0].dataType
    below = _files_below(spark, path)
    files = _within(below, max_bytes).select(
        key.cast(kind).alias(name), "path", "length", "content", F.lit(None).cast("string").alias("error"))
    there = below.select(key.cast(kind).alias(name)).distinct()
    missing = listed.distinct().join(there, name, "left_anti")
    error = F.concat(F.lit(rules.FILE_MISSING_ERROR), F.col(name).cast("string"))
    return files.unionByName(missing.withColumn("error", error), allowMissingColumns=True)


def analyze_files(df: DataFrame, content: str = "content", *,
                  pdf_text: Expression | None = None,
                  embedded: Expression | None = None,
                  threshold: float | Column = rules.FILE_THRESHOLD,
                  error: Expression | None = None, available: Expression | None = None,
                  output: str = "analysis") -> DataFrame:
    """Analyse file bytes: PDFs by their extracted text, everything else as text.

    A PDF without extracted text is decoded as text. NULL bytes with a ``length`` are an
    oversized file. What can't be analysed stays in as a row: ``available`` tells where a file
    analyser is deployed (everywhere, if not given), and a non-NULL ``error`` why a file could not
    be read; the one issue of such rows is ``file_analysis_unavailable`` or ``file_analysis_error``.
    """
    kept = df.columns
    given = {"_gs_error": F.lit(None) if error is None else as_column(error),
             "_gs_available": F.lit(True) if available is None else as_column(available)}
    df = df.withColumns({"_gs_error": given["_gs_error"].cast("string"),
                         "_gs_available": F.coalesce(given["_gs_available"], F.lit(True))})
    extracted = F.lit(None) if pdf_text is None else as_column(pdf_text)
    staged = df.withColumn("_gs_pages", F.when(F.expr(P.is_pdf_sql(content)), extracted)
                           .cast("string"))
    staged = staged.selectExpr(
        "*", f"coalesce(_gs_pages, {P.decode_leniently_sql(content)}) AS _gs_text",
        "_gs_pages IS NOT NULL AS _gs_as_pdf")
    analysed = analyze(staged, "_gs_text", "true", is_pdf="_gs_as_pdf", embedded=embedded,
                       threshold=threshold, output="_gs_analysis")
    result = "_gs_analysis"
    if "length" in kept:
        result = (f"CASE WHEN {content} IS NULL AND length IS NOT NULL "
                  f"THEN {oversize_analysis_sql(rules.OVERSIZE_SUMMARY)} ELSE {result} END")
    done = F.when(~F.col("_gs_available"), unavailable_analysis()) \
            .when(F.col("_gs_error").isNotNull(), failed_analysis("_gs_error")).otherwise(F.expr(result))
    return analysed.select(*kept, done.alias(output))
