"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash of
the record's own values and, of equal ones, their number. Pass 2 puts each bucket into a canonical
order, shuffles it by a seeded Fisher-Yates permutation and writes it. The buckets one after
another are a random order of all records; shards are its even cuts, so their row counts differ by
one at most.

How many rows buckets have is counted before, from hashes alone, so a bucket's task knows the
positions of its rows and writes them straight into the one or few shards it spans: whole records
move once, and a shard is written by as many tasks as it has buckets.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatesift.llm.common import stored
from gatesift.session import shared_dir

SEED = 41
BUCKET_BYTES = 16_000_000
BROADCAST_ROWS = 1_000_000
RANGE_BUCKETS = 4_096


def _fisher_yates(seed: int, order: list[str]):
    def shuffle(batch: pa.Table, counted: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return batch.append_column("position", pa.array([], pa.int64()))
        bucket, offset = batch.column("__bucket")[0].as_py(), counted.column("__offset")[0].as_py()
        # arrival order depends on the cluster: start from one that does not
        batch = batch.take(pc.sort_indices(batch, [(c, "ascending") for c in order]))
        places = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(batch.num_rows)
        return batch.append_column("position", pa.array(offset + places, pa.int64()))
    return shuffle


def _offsets(buckets: DataFrame) -> DataFrame:
    """Rows in front of each bucket, from (__bucket, __n): sums in ranges of buckets, then of ranges."""
    def before(n: str, window) -> Column:
        return F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    buckets = buckets.withColumn("__range", F.floor(F.col("__bucket") / RANGE_BUCKETS))
    ranges = buckets.groupBy("__range").agg(F.sum("__n").alias("__sum")).select(
        "__range", before("__sum", Window.orderBy("__range")).alias("__first"))
    inside = before("__n", Window.partitionBy("__range").orderBy("__bucket"))
    return buckets.withColumn("__inside", inside).join(ranges, "__range").select(
        "__bucket", (F.col("__first") + F.col("__inside")).alias("__offset"))


def _bytes(records: DataFrame) -> Column:
    """Bytes of a record: its texts and binaries, and 8 for each other column."""
    sizes = [F.octet_length(F.col(f.name)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8)
             for f in records.schema.fields]
    return functools.reduce(lambda a, b: a + b, [F.coalesce(s.cast("long"), F.lit(0)) for s in sizes])


def _numbered(records: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Adds ``__copy``: 0, 1, 2 ... for the records that agree in ``key``, in no order of note.

    Copies are counted in slices of 8,192 rows, and the slices are added up, so no task gets
    all copies of a record.
    """
    hashed = F.xxhash64(F.lit(seed), *key)
    repeated = stored(records.groupBy(hashed.alias("__hash")).count().where("count > 1").select("__hash"), "repeated")
    if repeated.isEmpty():
        return records.withColumn("__copy", F.lit(0).cast("long"))
    # row ids of a written table: the same in both of its readings
    rows = stored(records, "records").withColumn("__row", F.monotonically_increasing_id())
    copies = rows.select("__row", hashed.alias("__hash"), F.shiftright("__row", 13).alias("__slice"))
    if repeated.count() <= BROADCAST_ROWS:
        copies = copies.join(F.broadcast(repeated), "__hash", "left_semi")
    else:
        copies = copies.join(repeated, "__hash", "left_semi")
    copies = stored(copies, "copies")
    before = Window.partitionBy("__hash").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = copies.groupBy("__hash", "__slice").agg(F.count("*").alias("__n")).select(
        "__hash", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__hash", "__slice").orderBy("__row")) - 1
    copies = stored(copies.withColumn("__place", place).join(slices, ["__hash", "__slice"])
                    .select("__row", (F.col("__first") + F.col("__place")).alias("__copy")), "numbers")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    return (rows.join(copies, "__row", "left").drop("__row")
            .withColumn("__copy", F.coalesce("__copy", F.lit(0).cast("long"))))


def shuffle_records(records: DataFrame, key: list[str], bucket_rows: int = 50_000,
                    seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Number all records by a random permutation: adds ``position``, gapless from 0.

    ``key`` names sortable columns that tell records apart; they decide bucket and place, so
    reruns agree. Records that agree in all of them are interchangeable; they are
    numbered, so that they spread over all buckets. Nulls in them are
    allowed. An empty table stays empty. Columns named like new ones are replaced. ``records``
    is read several times: give it a written table. A bucket holds ``bucket_rows`` or
    ``bucket_bytes`` on average, whichever is less.
    """
    records = records.drop("position", "shard", "slot")
    total = records.agg(F.count("*").alias("n"), F.coalesce(F.sum(_bytes(records)), F.lit(0)).alias("b")).first()
    n_buckets = max(1, -(-total["n"] // bucket_rows), -(-total["b"] // bucket_bytes))
    records = _numbered(records, key, seed)
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key, "__copy"), F.lit(n_buckets)).cast("long")
    scattered = records.withColumn("__bucket", bucket)
    offsets = stored(_offsets(scattered.groupBy("__bucket").agg(F.count("*").alias("__n"))), "offsets")
    schema = T.StructType([*scattered.schema.fields, T.StructField("position", T.LongType())])
    shuffled = scattered.groupBy("__bucket").cogroup(offsets.groupBy("__bucket")).applyInArrow(
        _fisher_yates(seed, key), schema)
    return shuffled.select(*[c for c in records.columns if c != "__copy"], "position")


def shard_records(records: DataFrame, key: list[str], shards: int, bucket_rows: int = 50_000,
                  seed: int = SEED) -> DataFrame:
    """Shuffle all records and cut them into shards: adds shard (int) and slot (long).

    The first ``rows mod shards`` shards hold one row more than the others. With fewer rows
    than shards, the last shards are empty. See :func:`shuffle_records` for the rest.
    """
    n = records.count()
    placed = shuffle_records(records, key, bucket_rows, seed)
    base, longer = divmod(n, shards)
    edge = longer * (base + 1)
    rest = F.col("position") - edge
    in_longer = F.col("position") < edge
    return placed.select(
        *[c for c in placed.columns if c != "position"],
        F.when(in_longer, F.floor(F.col("position") / (base + 1)))
         .otherwise(longer + F.floor(rest / max(base, 1))).cast("int").alias("shard"),
        F.when(in_longer, F.col("position") % (base + 1)).otherwise(rest % max(base, 1))
         .cast("long").alias("slot"))


def write_shards(records: DataFrame, path: str) -> None:
    """Write sharded records, a folder per shard, each file in slot order.

    The rows stay in the tasks they are in: a task of :func:`shard_records` has whole buckets, which
    are ranges of slots.
    """
    records.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def written_shards(records: DataFrame) -> DataFrame:
    """Sharded records, written into the shared folder as by :func:`write_shards` and read again."""
    spark = records.sparkSession
    path = f"{shared_dir(spark)}/llm-shards-{uuid.uuid4().hex}"
    write_shards(records, path)
    return spark.read.schema(records.schema).parquet(path)
