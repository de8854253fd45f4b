"""Counters that die of inactivity, and first sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatesift import rules


def life_slices(events: DataFrame, keys: list[str], ts: str = "ts",
                gap_seconds: int = rules.COUNTER_TTL_SECONDS,
                amount: Column | None = None) -> DataFrame:
    """Increments combined per key and slice of the gap: ``first_us``, ``last_us``, ``n``.

    Such a slice never spans two lives, so what is left of a key is bounded by time, not by rows.
    """
    width = max(gap_seconds * 1_000_000 // 24, 1)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return (
        events.select(*keys, us.alias("_gs_us"),
                      (F.lit(1) if amount is None else amount).cast("bigint").alias("_gs_n"))
        .filter("_gs_us IS NOT NULL")
        .groupBy(*keys, F.floor(F.col("_gs_us") / width).alias("_gs_slice"))
        .agg(F.min("_gs_us").alias("first_us"), F.max("_gs_us").alias("last_us"),
             F.sum("_gs_n").alias("n")).drop("_gs_slice")
    )


def merge_lives(lives: DataFrame, keys: list[str],
                gap_seconds: int = rules.COUNTER_TTL_SECONDS) -> DataFrame:
    """The lives that parts of lives (``first_us``, ``last_us``, ``n``) make up.

    Parts may overlap and come in any order and grouping: merging merged ones again changes nothing.
    """
    gap = gap_seconds * 1_000_000
    before = Window.partitionBy(*keys).orderBy("first_us").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = F.coalesce(F.col("first_us") - F.max("last_us").over(before) > gap, F.lit(True))
    in_order = Window.partitionBy(*keys).orderBy("first_us").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    numbered = lives.withColumn("_gs_new", starts.cast("int")) \
                    .withColumn("session_no", F.sum("_gs_new").over(in_order))
    return numbered.groupBy(*keys, "session_no").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.sum("n").alias("n"))


def counter_sessions(events: DataFrame, keys: list[str], ts: str = "ts",
                     gap_seconds: int = rules.COUNTER_TTL_SECONDS,
                     amount: Column | None = None) -> DataFrame:
    """Lives of counters whose time to live restarts with every increment.

    One row per life: ``session_start``, ``last_increment``, ``counter_value``. A life
    ends where the next increment comes more than the gap later. Increments without time count
    for nothing.
    """
    lives = merge_lives(life_slices(events, keys, ts, gap_seconds, amount), keys, gap_seconds)
    return lives.select(
        *keys, "session_no", F.timestamp_micros("first_us").alias("session_start"),
        F.timestamp_micros("last_us").alias("last_increment"), F.col("n").alias("counter_value"))


def counter_values(sessions: DataFrame, keys: list[str], as_of: Column,
                   gap_seconds: int = rules.COUNTER_TTL_SECONDS) -> DataFrame:
    """Counter values at a moment; counters that are dead by then read 0.

    The sessions must come from increments up to that moment.
    """
    expires = F.unix_micros("last_increment") + gap_seconds * 1_000_000
    live = expires >= F.unix_micros(as_of.cast("timestamp"))
    return sessions.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(live, F.col("counter_value"))), F.lit(0))
         .alias("counter_value"))


def first_sightings(log: DataFrame, key: str = "cache_key", ts: str = "ts",
                    order: str = "request_id") -> DataFrame:
    """Add ``is_duplicate``: False for the first request of each key, True for the rest.

    The first request is a combinable minimum joined back, not a ranking: no task has to
    sort all requests of a hot key.
    """
    first = log.groupBy(F.col(key).alias("_gs_key")).agg(
        F.min(F.struct(F.col(ts), F.col(order))).alias("_gs_first"))
    return (
        log.join(first, F.col(key).eqNullSafe(F.col("_gs_key")), "left")
        .withColumn("is_duplicate", F.struct(F.col(ts), F.col(order)) > F.col("_gs_first"))
        .drop("_gs_key", "_gs_first")
    )
