import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gatesift.operators import replay

NEVER = -(2 ** 62)


def brute_force(rows, ttl, seeds=None):
    """Sequential replay: {id: (hit, write time)} in microseconds."""
    out, live = {}, dict(seeds or {})
    for key, us, ident in sorted(rows):
        entry = live.get(key)
        if entry and us < entry[1]:
            out[ident] = (True, entry[0])
        else:
            live[key] = (us, us + ttl * 1_000_000)
            out[ident] = (False, us)
    return out


def log(spark, rows):
    df = spark.createDataFrame(rows, "cache_key STRING, us LONG, request_id LONG")
    return df.select("cache_key", F.timestamp_micros("us").alias("ts"), "request_id")


def replayed(df, ttl, **options):
    out = replay.ttl_replay(df, ttl=F.lit(ttl), **options)
    return {r.request_id: (r.cache_hit, r.w)
            for r in out.withColumn("w", F.unix_micros("written_at")).collect()}


def random_log(gap, hot, n=3000, seed=1):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.expovariate(1 / gap)
        key = "hot" if rng.random() < hot else f"k{rng.randrange(200)}"
        rows.append((key, int(t * 1e6), i))
    return rows


def test_expiry_runs_from_the_write(spark):
    rows = [("k", s * 1_000_000, i) for i, s in enumerate([0, 1799, 1800, 1801, 3599, 3600])]
    got = replayed(log(spark, rows), 1800)
    assert [got[i][0] for i in range(6)] == [False, True, False, True, True, False]


# dense and sparse logs; a fan of 2 takes several rounds over a hot key's partitions
@pytest.mark.parametrize("gap,ttl,fan", [
    (60, 1800, 32), (1, 100, 2), (5, 7, 2), (2000, 1800, 3), (0.01, 1800, 2), (20, 100, 4)])
def test_hot_keys_match_sequential_replay(spark, monkeypatch, gap, ttl, fan):
    monkeypatch.setattr(replay, "_FAN", fan)
    rows = random_log(gap, 0.6)
    assert replayed(log(spark, rows).repartition(4), ttl, partitions=12) == \
        brute_force(rows, ttl)


@pytest.mark.parametrize("partitions", [1, 2, 4, 32])
def test_many_keys_and_a_hot_one_over_any_number_of_partitions(spark, monkeypatch, partitions):
    monkeypatch.setattr(replay, "_FAN", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # steps go on over batches
    rng, rows, t = random.Random(6), [], 0.0
    for i in range(6000):
        t += rng.expovariate(1 / 3)
        key = "k0500" if rng.random() < 0.4 else f"k{rng.randrange(1500):04}"
        rows.append((key, int(t * 1e6) if i % 5 else int(t) * 1_000_000, i))
    try:
        assert replayed(log(spark, rows), 40, partitions=partitions) == brute_force(rows, 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lifetimes_of_each_row_in_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(replay, "_FAN", 2)
    rng, rows, live, expected = random.Random(9), [], -1, {}
    for i in range(1500):
        us, ttl = i // 3 * 1_000_000, rng.choice([0, 1, 2, 5, 40, -3])
        rows.append((i, "hot", us, ttl))
        expected[i] = us < live
        if us >= live:
            live = us + ttl * 1_000_000
    df = spark.createDataFrame(rows, "request_id LONG, cache_key STRING, us LONG, ttl INT") \
        .withColumn("ts", F.timestamp_micros("us"))
    out = replay.ttl_replay(df, ttl=F.col("ttl"), partitions=20)
    assert {r.request_id: r.cache_hit for r in out.collect()} == expected


def test_equal_times_follow_the_order_column(spark):
    rows = [("k", 5_000_000 * (i // 40), 200 - i) for i in range(200)]
    assert replayed(log(spark, rows), 7, partitions=8) == brute_force(rows, 7)


def test_entries_that_are_live_beforehand(spark):
    rows = random_log(30, 0.5, n=800)
    seeds = {"hot": (-5, 900_000_000), "k1": (-7, 10_000_000_000_000), "k2": (-9, -1)}
    cache = spark.createDataFrame(
        [(k, w, x) for k, (w, x) in seeds.items()], "cache_key STRING, w LONG, x LONG") \
        .select("cache_key", F.timestamp_micros("w").alias("written_at"),
                F.timestamp_micros("x").alias("expires_at"))
    assert replayed(log(spark, rows), 100, cache=cache, partitions=6) == \
        brute_force(rows, 100, seeds)


def test_ttl_of_the_analysis_type_and_kept_columns(spark):
    df = spark.createDataFrame(
        [("a", t, i, kind) for i, (t, kind) in enumerate(
            [(0, "text"), (1800, "text"), (0, "file"), (7199, "file"), (7200, "file")])],
        "k STRING, t LONG, request_id LONG, analysis_type STRING")
    df = df.select(F.concat("k", "analysis_type").alias("cache_key"),
                   F.timestamp_seconds("t").alias("ts"), "request_id", "analysis_type",
                   F.lit(dt.date(2024, 1, 1)).alias("day"))
    rows = replay.ttl_replay(df).orderBy("request_id").collect()
    assert [r.cache_hit for r in rows] == [False, False, False, True, False]
    assert rows[0].day == dt.date(2024, 1, 1)


def test_empty_log(spark):
    assert replayed(log(spark, []), 10) == {}


@pytest.mark.parametrize("partitions", [1, 2, 4, 32])
def test_null_keys_and_times_take_no_part_and_dead_entries_never_hit(spark, partitions):
    rows = [(i, None, 1000 + i, 60) for i in range(6)] + [(10 + i, "a", None, 60) for i in range(3)]
    rows += [(20, "a", 1001, 60), (21, "a", 1002, 60), (22, "a", 1003, None)]
    rows += [(30 + i, "b", 2000 + i // 2, 0) for i in range(5)] + [(40 + i, "c", 3000, -5) for i in range(3)]
    log = spark.createDataFrame(rows, "request_id INT, cache_key STRING, s INT, ttl INT") \
        .withColumn("ts", F.timestamp_seconds("s"))
    out = {r.request_id: r.cache_hit
           for r in replay.ttl_replay(log, ttl=F.col("ttl"), partitions=partitions).collect()}
    assert {i for i, hit in out.items() if hit is None} == {*range(6), 10, 11, 12, 22}
    assert {i for i, hit in out.items() if hit} == {21} and len(out) == len(rows)
