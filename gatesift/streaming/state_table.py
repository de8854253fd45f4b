"""A table that a stream keeps up to date: a snapshot and a short tail of changes.

Each micro-batch writes its own changes and a commit record; every ``every``-th one also merges
the last snapshot and the changes since into a new snapshot. So the table after batch b is one
snapshot and at most ``every`` - 1 change sets, which both follow from b alone: nothing is listed,
and neither a batch nor a read gets dearer as the stream grows older.

Folders are reused in turn. A batch that is repeated after a failure rewrites its own folders from
what batches before it left, and these are never the ones that it overwrites. Change sets stay for
another ``every`` batches after they are merged and a snapshot until the next but one, which is the
time that readers beside the stream have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

EVERY = 16


class StateTable:
    """``merge`` turns rows of snapshots and changes into the table's rows, in any grouping.

    ``ddl`` are its columns, which changes have too.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str,
                 merge: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.spark, self.path, self.ddl = spark, path.rstrip("/"), ddl
        self.merge, self.every = merge, every

    def _changes(self, batch_id: int) -> str:
        return f"{self.path}/changes/{batch_id % (2 * self.every)}"

    def _snapshot(self, number: int) -> str:
        return f"{self.path}/snapshots/{number % 2}"

    def parts(self, batch_id: int) -> list[str]:
        """The folders that make up the table after a batch."""
        number = (batch_id + 1) // self.every
        tail = [self._changes(b) for b in range(number * self.every, batch_id + 1)]
        return ([self._snapshot(number)] if number else []) + tail

    def after(self, batch_id: int) -> DataFrame:
        """The table after a batch; before the first (-1) it has no rows."""
        parts = self.parts(batch_id)
        if not parts:
            return self.spark.createDataFrame([], self.ddl)
        return self.merge(self.spark.read.schema(self.ddl).parquet(*parts))

    def write(self, batch_id: int, changes: DataFrame,
              keep: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Add a batch's changes, and take a snapshot when it is time to.

        ``keep`` chooses what goes into the snapshot, for rows that are of no more use.
        """
        columns = self.spark.createDataFrame([], self.ddl).columns
        changes.select(*columns).write.mode("overwrite").parquet(self._changes(batch_id))
        number = (batch_id + 1) // self.every
        if (batch_id + 1) % self.every == 0:
            # what the last snapshot and all changes since make up: the new one isn't there yet
            before = ([self._snapshot(number - 1)] if number > 1 else []) + [
                self._changes(b) for b in range(batch_id + 1 - self.every, batch_id + 1)]
            merged = self.merge(self.spark.read.schema(self.ddl).parquet(*before))
            merged = merged if keep is None else keep(merged)
            merged.select(*columns).write.mode("overwrite").parquet(self._snapshot(number))
        write_slot(self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id")),
                   f"{self.path}/commits", batch_id)

    def last_batch(self) -> int:
        """The last batch that was written whole, -1 before the first."""
        commits = read_slots(self.spark, f"{self.path}/commits", "batch_id BIGINT")
        found = commits and commits.agg(F.max("batch_id")).first()[0]
        return -1 if found is None else found

    def latest(self) -> DataFrame:
        """The table after the last batch that was written whole."""
        return self.after(self.last_batch())


def write_slot(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one of two folders in turn, so one is always whole."""
    rows.write.mode("overwrite").parquet(f"{path}/{batch_id % 2}")


def read_slots(spark: SparkSession, path: str, ddl: str) -> DataFrame | None:
    """Both folders of :func:`write_slot`, or None before the first."""
    try:
        return spark.read.schema(ddl).parquet(f"{path}/*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return None
