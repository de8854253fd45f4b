import json

from pyspark.sql import functions as F

from gatesift.operators import sessions as W
from gatesift.operators import stats as ST

HOUR = 3600


def log(spark, rows):
    return spark.createDataFrame(
        rows, "cache_hit BOOLEAN, analysis_type STRING, status STRING, latency_ms DOUBLE")


ROWS = [(False, "text", "safe", 40.0), (True, "text", "safe", 4.0), (True, "text", "unsafe", 6.0),
        (False, "file", "unsafe", 60.0), (False, "file", "error", 80.0)]


def test_counters_count_validations_on_misses_only(spark):
    got = {r.counter: r.value for r in ST.event_counters(log(spark, ROWS)).collect()}
    assert got == {"cache_hits": 2, "cache_misses": 3, "validations_text": 1,
                   "validations_text_safe": 1, "validations_file": 2,
                   "validations_file_unsafe": 1, "validations_file_error": 1}


def test_rollup_report_and_snapshot(spark):
    rollup = ST.stats_rollup(log(spark, ROWS))
    row = rollup.first()
    assert row.asDict() == {"total_hits": 2, "total_misses": 3, "hit_rate": 40.0,
                            "text_validations": 1, "file_validations": 2, "safe_results": 1,
                            "unsafe_results": 1}
    keys = spark.createDataFrame([("validation:a",), ("counter:b",), ("other",)], "cache_key STRING")
    report = ST.stats_report(rollup, ST.key_totals(keys)).first()
    assert report.cache_info.asDict() == {
        "total_keys": 3, "validation_cache_keys": 1, "counter_keys": 1}
    assert report.validation_stats.unsafe_results == 1
    stored = ST.stats_snapshot(rollup, F.timestamp_seconds(F.lit(100)))
    assert json.loads(stored.first().value)["cache_performance"]["total_hits"] == 2
    assert ST.read_snapshot(stored, F.timestamp_seconds(F.lit(3699))).first() == row
    assert ST.read_snapshot(stored, F.timestamp_seconds(F.lit(3700))).isEmpty()
    assert {r.kind: r.n_keys for r in ST.key_census(keys).collect()} == \
        {"validation": 1, "counter": 1, "other": 1}


def test_empty_log_gives_zeros(spark):
    assert set(ST.stats_rollup(log(spark, [])).first()) == {0, 0.0}


def test_latencies(spark):
    row = ST.hit_miss_latency(log(spark, ROWS)).first()
    assert (row.avg_hit_ms, row.avg_miss_ms) == (5.0, 60.0)
    assert row.improvement_pct == (60.0 - 5.0) / 60.0 * 100
    assert set(ST.hit_miss_latency(log(spark, ROWS[:1])).first()) == {None}
    summary = ST.latency_summary(log(spark, ROWS)).first()
    assert tuple(summary) == (5, 38.0, 4.0, 80.0)


def increments(spark, hours, key="c"):
    df = spark.createDataFrame([(key, h * HOUR) for h in hours], "counter STRING, s DOUBLE")
    return df.select("counter", F.timestamp_seconds("s").alias("ts"))


def test_counter_dies_of_inactivity(spark):
    df = increments(spark, [0.0, 23.0, 46.0, 71.0, 95.0, 119.5])
    lives = W.counter_sessions(df, ["counter"]).orderBy("session_start").collect()
    assert [r.counter_value for r in lives] == [3, 2, 1]
    at = F.timestamp_seconds(F.lit(int(100 * HOUR)))
    now = W.counter_values(W.counter_sessions(df.filter(F.col("ts") <= at), ["counter"]),
                           ["counter"], at).first()
    assert now.counter_value == 2
    dead = F.timestamp_seconds(F.lit(int(500 * HOUR)))
    assert W.counter_values(W.counter_sessions(df, ["counter"]), ["counter"], dead) \
        .first().counter_value == 0


def test_sessions_match_session_windows(spark):
    import random
    rng, t, hours = random.Random(2), 0.0, []
    for _ in range(800):
        t += rng.choice([0.001, 0.4, 5.0, 23.9, 24.0, 24.1, 60.0])
        hours.append(round(t, 4))
    df = increments(spark, hours)
    got = {(r.session_start, r.counter_value) for r in
           W.counter_sessions(df, ["counter"]).collect()}
    windows = df.groupBy("counter", F.session_window("ts", "24 hours").alias("w")) \
                .agg(F.count("*").alias("n"))
    assert got == {(r.w.start, r.n) for r in windows.collect()}


def test_amounts(spark):
    df = increments(spark, [0.0, 1.0]).withColumn("by", F.lit(5))
    assert W.counter_sessions(df, ["counter"], amount=F.col("by")).first().counter_value == 10


def test_issue_frequency(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("b", []), ("b", None)],
                               "lang STRING, detected_issues ARRAY<STRING>")
    assert {tuple(r) for r in ST.issue_frequency(df).collect()} == {("x", 2), ("y", 1)}
    assert {tuple(r) for r in ST.issue_frequency(df, "lang").collect()} == \
        {("a", "x", 1), ("a", "y", 1), ("b", "x", 1)}
