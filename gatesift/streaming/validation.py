"""Streaming twins of the batch operators.

Every function takes a streaming DataFrame; the ``run_*`` helpers start the query, wait
until the available input is done, and are exactly-once per micro-batch: a batch that
is repeated after a failure overwrites its own output. What a stream carries from batch to
batch is a :class:`~gatesift.streaming.state_table.StateTable`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gatesift import rules
from gatesift.operators.cache import cache_entries, latest_entries
from gatesift.operators.replay import ttl_replay
from gatesift.operators.sessions import life_slices, merge_lives
from gatesift.schemas import CACHE_DDL, CACHE_ENTRY
from gatesift.streaming.state_table import EVERY, StateTable, write_slot


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stateless or watermarked stream to a parquet table."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


# ------------------------------------------------------------- the cache replay

class ReplayStream:
    """The replay of a log whose rows may come in any order within a delay.

    A row is final when the watermark (the latest time seen less ``delay_seconds``) has passed its
    time; until then it waits. Each micro-batch replays its final rows by the batch operator, which
    spreads a hot key over tasks, from the entries that earlier batches left, and adds its writes.
    So it doesn't matter in which order rows come within the delay. A row that comes when the
    watermark has passed its time already is looked up in the entry known then: it hits only if
    that was written before it and is still live, and it writes nothing.

    Tables below ``path``: ``log`` (a folder a batch), the cache (a state table, without entries
    that died before the watermark), waiting rows and the clock.
    """

    _CACHE = "cache_key STRING, written_us BIGINT, expires_us BIGINT"

    def __init__(self, spark: SparkSession, path: str, schema: StructType, *, key: str = "cache_key",
                 ts: str = "ts", order: str = "request_id", delay_seconds: int = 0,
                 partitions: int | None = None, every: int = EVERY):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.ts, self.order = key, ts, order
        self.delay, self.partitions = delay_seconds * 1_000_000, partitions
        self.cache = StateTable(spark, f"{self.path}/cache", self._CACHE, _last_writes, every)

    def _entries(self, cache: DataFrame) -> DataFrame:
        return cache.select("cache_key", F.timestamp_micros("written_us").alias("written_at"),
                            F.timestamp_micros("expires_us").alias("expires_at"))

    def _replay(self, rows: DataFrame, cache: DataFrame) -> DataFrame:
        return ttl_replay(rows, self.key, self.ts, self.order, cache=self._entries(cache),
                          partitions=self.partitions)

    def _late(self, rows: DataFrame, cache: DataFrame, mark: int) -> DataFrame:
        """Rows behind the watermark, looked up in the entries written before them."""
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        known = cache.filter(F.col("expires_us") > mark).select(
            F.col("cache_key").alias("_gs_key"), "written_us", "expires_us")
        hit = F.coalesce((F.col("written_us") <= us) & (us < F.col("expires_us")), F.lit(False))
        return (rows.join(known, F.col(self.key) == F.col("_gs_key"), "left").select(
            *self.schema.names, hit.alias("cache_hit"),
            *[F.when(hit, F.timestamp_micros(f"{c}_us")).alias(f"{c}_at") for c in ("written", "expires")]))

    def _waiting(self, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/waiting/{batch_id % 2}")

    def _clock(self, batch_id: int) -> int | None:
        """The latest time seen up to a batch."""
        if batch_id < 0:
            return None
        return self.spark.read.schema("us BIGINT").parquet(f"{self.path}/clock/{batch_id % 2}").first()[0]

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        before = self._clock(batch_id - 1)
        seen = [t for t in (before, batch.agg(F.max(us)).first()[0]) if t is not None]
        now = max(seen) if seen else None
        behind = None if before is None else before - self.delay
        passed = F.lit(False) if behind is None else F.coalesce(us < behind, F.lit(False))
        mark = F.lit(None).cast("bigint") if now is None else F.lit(now - self.delay)
        cache = self.cache.after(batch_id - 1)

        rows = self._waiting(batch_id - 1).unionByName(batch.filter(~passed))
        final = us.isNull() | (us < mark) if self.delay else F.lit(True)
        replayed = self._replay(rows.filter(final), cache).withColumn("late", F.lit(False))
        write_slot(rows.filter(~final), f"{self.path}/waiting", batch_id)
        # a folder per batch: repeating a batch replaces exactly what it wrote before
        out = f"{self.path}/log/batch_id={batch_id}"
        if behind is not None:
            late = self._late(batch.filter(passed), cache, behind)
            replayed = replayed.unionByName(late.withColumn("late", F.lit(True)))
        replayed.write.mode("overwrite").parquet(out)
        # read back what was written, rather than replay twice
        done = self.spark.read.schema(replayed.schema).parquet(out)
        writes = done.filter("NOT late AND NOT cache_hit").select(
            F.col(self.key).alias("cache_key"), F.unix_micros("written_at").alias("written_us"),
            F.unix_micros("expires_at").alias("expires_us"))
        # rows that are still to come final are not before the mark, and neither is what they hit
        self.cache.write(batch_id, _last_writes(writes), lambda c: c if now is None else
                         c.filter(F.col("expires_us") > now - self.delay))
        write_slot(self.spark.range(1).select(F.lit(now).cast("bigint").alias("us")),
                   f"{self.path}/clock", batch_id)

    def read(self) -> DataFrame:
        """All rows so far with ``late`` and ``final``; those that wait are replayed as if no other
        row were to come."""
        last = self.cache.last_batch()
        if last < 0:
            return self._replay(self._waiting(-1), self.cache.after(-1)).withColumns(
                {"late": F.lit(False), "final": F.lit(False)})
        waiting = self._replay(self._waiting(last), self.cache.after(last)).withColumn("late", F.lit(False))
        done = _written(self.spark, f"{self.path}/log", waiting.schema, last)
        return done.withColumn("final", F.lit(True)).unionByName(waiting.withColumn("final", F.lit(False)))


def _written(spark: SparkSession, path: str, schema: StructType, last: int) -> DataFrame:
    """What batches up to the last whole one wrote, a folder each."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(path)
    return rows.filter(F.col("batch_id") <= last).drop("batch_id")


def _last_writes(writes: DataFrame) -> DataFrame:
    """The last write of each key."""
    return writes.groupBy("cache_key").agg(
        F.max("written_us").alias("written_us"),
        F.max_by("expires_us", F.struct("written_us", "expires_us")).alias("expires_us"))


def run_ttl_replay(stream: DataFrame, path: str, checkpoint: str, **options) -> ReplayStream:
    """Replay a log stream; the result is what :meth:`ReplayStream.read` gives."""
    replay = ReplayStream(stream.sparkSession, path, stream.schema, **options)
    _run_batches(stream, replay.handle, checkpoint)
    return replay


# ------------------------------------------------------------------- the cache

def stream_cache(spark: SparkSession, path: str, every: int = EVERY) -> StateTable:
    """The cache table that a verdict stream keeps up to date."""
    return StateTable(spark, path, CACHE_DDL, latest_entries, every)


def run_verdict_upsert(verdicts: DataFrame, path: str, checkpoint: str, ts: str = "ts",
                       every: int = EVERY) -> StateTable:
    """Write the verdicts of a stream to the cache table; see :func:`stream_cache`.

    The stream needs ``cache_key``, ``analysis_type``, ``security_level``, the result
    fields and a time column. A batch writes the latest entry of each of its keys and
    reads nothing; every ``every``-th one brings the snapshot up to date.
    """
    table = stream_cache(verdicts.sparkSession, path, every)

    def handle(batch: DataFrame, batch_id: int) -> None:
        entries = cache_entries(batch, F.col(ts)).select(*CACHE_ENTRY)
        table.write(batch_id, latest_entries(entries))

    _run_batches(verdicts, handle, checkpoint)
    return table


# -------------------------------------------------------------------- counters

class CounterStream:
    """Lives of inactivity counters, open ones included, from increments in any order.

    A micro-batch adds what its increments amount to per key and slice of the gap; lives are what
    these merge to, so it neither reads the state nor cares for order. With a snapshot, lives that
    ended more than ``delay_seconds`` before the latest increment leave the state for the table of
    closed ones (``None``: never); an increment that comes later than that starts a life of its own.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], *, ts: str = "ts",
                 gap_seconds: int = rules.COUNTER_TTL_SECONDS, delay_seconds: int | None = None,
                 every: int = EVERY):
        self.spark, self.path, self.keys, self.ts = spark, path.rstrip("/"), list(keys), ts
        self.gap, self.delay = gap_seconds, delay_seconds
        self.ddl = ", ".join([*(f"`{k}` {t}" for k, t in keys.items()),
                              "first_us BIGINT, last_us BIGINT, n BIGINT"])
        self.open = StateTable(spark, f"{self.path}/open", self.ddl,
                               lambda rows: merge_lives(rows, self.keys, self.gap), every)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        def close(lives: DataFrame) -> DataFrame:
            if self.delay is None:
                return lives
            ends = lives.agg(F.coalesce(F.max("last_us"), F.lit(0))).first()[0]
            over = F.col("last_us") < ends - (self.gap + self.delay) * 1_000_000
            lives.filter(over).write.mode("overwrite").parquet(f"{self.path}/closed/batch_id={batch_id}")
            return lives.filter(~over)

        self.open.write(batch_id, life_slices(batch, self.keys, self.ts, self.gap), close)

    def read(self) -> DataFrame:
        """A row a life, as :func:`~gatesift.operators.sessions.counter_sessions` gives them."""
        last = self.open.last_batch()
        lives = self.open.after(last)
        if self.delay is not None and last + 1 >= self.open.every:
            lives = lives.unionByName(_written(self.spark, f"{self.path}/closed", lives.schema, last))
        return lives.select(*self.keys, F.timestamp_micros("first_us").alias("session_start"),
                            F.timestamp_micros("last_us").alias("last_increment"),
                            F.col("n").alias("counter_value"))


def run_counters(stream: DataFrame, keys: list[str], path: str, checkpoint: str,
                 **options) -> CounterStream:
    """Count a stream of increments; the result is what :meth:`CounterStream.read` gives."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    counters = CounterStream(stream.sparkSession, path, {k: types[k] for k in keys}, **options)
    _run_batches(stream, counters.handle, checkpoint)
    return counters


def _run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None],
                 checkpoint: str) -> None:
    query = (stream.writeStream.foreachBatch(handle)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def distinct_requests(stream: DataFrame, key: str = "cache_key", ts: str = "ts",
                      delay: str = "1 hour", spread: int = 32,
                      spread_by: str = "request_id") -> DataFrame:
    """One request per key within the watermark delay: analyse-once on a stream.

    Two rounds: copies of a hot key are first removed in ``spread`` independent groups,
    and at most one row of each goes to the task that owns the key.
    """
    marked = stream.withWatermark(ts, delay)
    salted = marked.withColumn("_gs_salt", F.pmod(F.xxhash64(spread_by), F.lit(spread)))
    return (salted.dropDuplicatesWithinWatermark([key, "_gs_salt"])
            .dropDuplicatesWithinWatermark([key]).drop("_gs_salt"))


def session_counters(stream: DataFrame, keys: list[str], ts: str = "ts",
                     gap_seconds: int = rules.COUNTER_TTL_SECONDS,
                     delay: str = "1 hour") -> DataFrame:
    """Lives of inactivity counters; rows later than the watermark are dropped.

    For a sink of closed lives; :func:`run_counters` also has the open ones. The session's settings
    (:data:`gatesift.session.SETTINGS`) merge increments of one life within each task before the
    shuffle, which keeps hot counters small.
    """
    lives = (stream.withWatermark(ts, delay)
             .groupBy(*keys, F.session_window(F.col(ts), f"{gap_seconds} seconds").alias("s"))
             .agg(F.count("*").alias("counter_value")))
    return lives.select(
        *keys, F.col("s.start").alias("session_start"),
        (F.col("s.end") - F.make_dt_interval(secs=F.lit(gap_seconds))).alias("last_increment"),
        "counter_value")
