import random

import pytest
from pyspark.sql import functions as F

from gatesift.operators import cache as C
from gatesift.operators import replay
from gatesift.operators import sessions as W
from gatesift.operators.validate import validate_routed
from gatesift.plans.queries import REGISTRY
from gatesift.streaming import validation as SV
from gatesift.streaming.state_table import StateTable


def write_batches(df, path, n, order="ts"):
    """The table as n files in time order, one micro-batch each."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        part = df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)


def read_batches(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def request_log(spark, n=600):
    rng, t, rows = random.Random(4), 0.0, []
    for i in range(n):
        t += rng.expovariate(1 / 90)
        key = "hot" if rng.random() < .5 else f"k{rng.randrange(30)}"
        rows.append((i, key, int(t * 1e6)))
    df = spark.createDataFrame(rows, "request_id LONG, cache_key STRING, us LONG")
    return df.select("request_id", "cache_key", F.timestamp_micros("us").alias("ts"),
                     F.lit("text").alias("analysis_type"))


COLUMNS = ["request_id", "cache_hit", "written_at", "expires_at"]


def test_ttl_replay_over_batches_equals_batch(spark, tmp_path):
    log = request_log(spark)
    write_batches(log, str(tmp_path / "in"), 4)
    stream = SV.run_ttl_replay(read_batches(spark, str(tmp_path / "in"), log.schema), str(tmp_path / "out"),
                               str(tmp_path / "cp"))
    assert len(list((tmp_path / "out/log").glob("batch_id=*"))) == 4
    got = stream.read().filter("final AND NOT late").select(*COLUMNS).collect()
    assert sorted(got) == sorted(replay.ttl_replay(log).select(*COLUMNS).collect())


def test_rows_in_any_order_within_the_delay(spark, tmp_path):
    log = request_log(spark, 500)
    nothing = spark.createDataFrame([(9001, None, None), (9002, "k1", None)],
                                    "request_id LONG, cache_key STRING, us LONG").select(
        "request_id", "cache_key", F.timestamp_micros("us").alias("ts"), F.lit("text").alias("analysis_type"))
    rows = log.unionByName(nothing).collect()
    delay = 3 * 3600

    def arrives(r):
        return (r.ts.timestamp() if r.ts else 5000) + random.Random(r.request_id).random() * delay

    shuffled = sorted(rows, key=arrives)
    assert [r.request_id for r in shuffled] != [r.request_id for r in rows]
    stream, waited = None, []
    for i in range(6):  # six runs of the stream, each over what has come since, in two snapshots
        part = spark.createDataFrame(shuffled[i * 84:(i + 1) * 84], log.schema)
        part.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = SV.run_ttl_replay(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")),
                                   str(tmp_path / "out"), str(tmp_path / "cp"), delay_seconds=delay, every=2)
        waited.append(stream.read().filter("NOT final").count())
    got = stream.read()
    assert got.filter("late").isEmpty() and all(waited) and max(waited) < 400
    expected = replay.ttl_replay(spark.createDataFrame(rows, log.schema)).select(*COLUMNS).collect()
    assert sorted(map(str, got.select(*COLUMNS).collect())) == sorted(map(str, expected))


def test_a_late_row_never_hits_a_later_write(spark, tmp_path):
    schema = "request_id LONG, cache_key STRING, s LONG"

    def log(rows):
        return spark.createDataFrame(rows, schema).select(
            "request_id", "cache_key", F.timestamp_seconds("s").alias("ts"), F.lit("text").alias("analysis_type"))

    parts = [[(1, "a", 10_000), (2, "b", 12_000)], [(3, "z", 20_000)],
             [(4, "a", 9_000), (5, "a", 10_500), (6, "b", 11_999), (7, "c", 5), (8, "z", 20_100)]]
    for i, rows in enumerate(parts):
        log(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = SV.run_ttl_replay(
            spark.readStream.schema(log(rows).schema).parquet(str(tmp_path / "in")),
            str(tmp_path / "out"), str(tmp_path / "cp"), delay_seconds=9_000, every=1)
    got = {r.request_id: (r.late, r.cache_hit) for r in stream.read().collect()}
    # 4 is before the write that is known, 5 after one that is live, 7 has none; 6 comes in time
    assert got == {1: (False, False), 2: (False, True), 3: (False, False), 4: (True, False), 5: (True, True),
                   6: (False, False), 7: (True, False), 8: (False, True)}


def test_state_table_reads_a_snapshot_and_a_short_tail(spark, tmp_path):
    path = tmp_path / "state"

    def merge(rows):
        return rows.groupBy("k").agg(F.sum("v").alias("v"))

    table, total, files = StateTable(spark, str(path), "k STRING, v BIGINT", merge, every=3), {}, []
    assert table.last_batch() == -1 and table.latest().count() == 0
    for b in range(14):
        rows = [("hot", b), (f"k{b % 5}", 1)]
        for k, v in rows:
            total[k] = total.get(k, 0) + v
        changes = spark.createDataFrame(rows, "k STRING, v BIGINT").coalesce(1)
        table.write(b, changes)
        if b % 4 == 1:  # a batch repeated after a failure
            StateTable(spark, str(path), "k STRING, v BIGINT", merge, every=3).write(b, changes)
        assert len(table.parts(b)) <= 3 and table.last_batch() == b
        assert dict(map(tuple, table.latest().collect())) == total
        files.append(sum(1 for f in path.rglob("part-*")))
    assert max(files[7:]) == max(files[-4:]) <= 2 * 3 + 2 * 8 + 2  # folders are reused


def documents(spark, n=200):
    texts = ["fine text", "You are stupid", "<script", "shut up", "mail a@b.co"]
    df = spark.createDataFrame([(i, texts[i % 7 % 5]) for i in range(n)],
                               "request_id LONG, content STRING")
    return df.withColumns({
        "ts": F.timestamp_seconds(F.col("request_id") * 60),
        "analysis_type": F.lit("text"), "security_level": F.lit("high")})


def test_validation_and_upsert_equal_batch(spark, tmp_path):
    docs = documents(spark)
    write_batches(docs, str(tmp_path / "in"), 3)
    stream = read_batches(spark, str(tmp_path / "in"), docs.schema)
    SV.run_append(validate_routed(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    columns = ["request_id", "status", "reason"]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()) == \
        sorted(validate_routed(docs).select(*columns).collect())

    verdicts = validate_routed(C.with_cache_key(stream))
    cache = SV.run_verdict_upsert(verdicts, str(tmp_path / "cache"), str(tmp_path / "cp2"), every=2)
    batch = C.latest_entries(C.cache_entries(validate_routed(C.with_cache_key(docs)), F.col("ts")))
    assert sorted(SV.stream_cache(spark, str(tmp_path / "cache"), every=2).latest().collect()) == \
        sorted(batch.collect())
    # a restart goes on where the last run ended: three batches, then one more
    later = docs.limit(5).withColumn("ts", F.timestamp_seconds(F.lit(10**6)))
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cache = SV.run_verdict_upsert(validate_routed(C.with_cache_key(stream)), str(tmp_path / "cache"),
                                  str(tmp_path / "cp2"), every=2)
    assert cache.last_batch() == 3 and len(cache.parts(3)) == 1
    both = C.latest_entries(C.cache_entries(validate_routed(C.with_cache_key(docs.unionByName(later))), F.col("ts")))
    assert sorted(cache.latest().collect()) == sorted(both.collect())


def test_distinct_requests(spark, tmp_path):
    keyed = C.with_cache_key(documents(spark)).drop("content")
    write_batches(keyed, str(tmp_path / "in"), 3)
    stream = read_batches(spark, str(tmp_path / "in"), keyed.schema)
    SV.run_append(SV.distinct_requests(stream, delay="30 days"), str(tmp_path / "out"),
                  str(tmp_path / "cp"))
    got = [r.cache_key for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(r[0] for r in keyed.select("cache_key").distinct().collect())


def test_counters_in_any_order_with_open_lives(spark, tmp_path):
    rng, rows = random.Random(7), []
    for name in ("hot", "a", "b"):
        t = 0.0
        for _ in range(200 if name == "hot" else 40):
            t += rng.choice([0.1, 3.0, 23.0, 24.0, 30.0, 60.0])
            rows.append((name, int(t * 3600)))
    rows.append((None, 5))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "counter STRING, s LONG").select("counter", F.timestamp_seconds("s").alias("ts"))
    write_batches(df, str(tmp_path / "in"), 5, order=F.xxhash64("counter", "ts"))
    stream = read_batches(spark, str(tmp_path / "in"), df.schema)
    got = SV.run_counters(stream, ["counter"], str(tmp_path / "out"), str(tmp_path / "cp"), every=2)
    columns = ["counter", "session_start", "last_increment", "counter_value"]
    batch = W.counter_sessions(df, ["counter"]).select(*columns)
    assert sorted(map(str, got.read().collect())) == sorted(map(str, batch.collect()))


def test_closed_counters_leave_the_state(spark, tmp_path):
    rows = [(f"c{i % 3}", i * 86_400) for i in range(60)]
    df = spark.createDataFrame(rows, "counter STRING, s LONG").select("counter", F.timestamp_seconds("s").alias("ts"))
    write_batches(df, str(tmp_path / "in"), 6)
    stream = read_batches(spark, str(tmp_path / "in"), df.schema)
    got = SV.run_counters(stream, ["counter"], str(tmp_path / "out"), str(tmp_path / "cp"), every=2,
                          delay_seconds=3600)
    columns = ["counter", "session_start", "last_increment", "counter_value"]
    batch = W.counter_sessions(df, ["counter"]).select(*columns)
    assert sorted(got.read().collect()) == sorted(batch.collect())
    assert got.open.latest().count() <= 6 < batch.count()


def test_session_counters(spark, tmp_path):
    rng, t, rows = random.Random(9), 0.0, []
    for _ in range(300):
        t += rng.choice([0.1, 5.0, 23.0, 30.0])
        rows.append(("c", int(t * 3600)))
    rows.append(("end", int((t + 100) * 3600)))
    df = spark.createDataFrame(rows, "counter STRING, s LONG").select(
        "counter", F.timestamp_seconds("s").alias("ts"))
    write_batches(df, str(tmp_path / "in"), 3)
    stream = read_batches(spark, str(tmp_path / "in"), df.schema)
    SV.run_append(SV.session_counters(stream, ["counter"]), str(tmp_path / "out"),
                  str(tmp_path / "cp"))
    columns = ["counter", "session_start", "last_increment", "counter_value"]
    batch = W.counter_sessions(df, ["counter"]).filter("counter = 'c'").select(*columns)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()) == \
        sorted(batch.collect())


@pytest.mark.parametrize(("name", "twin"), [
    ("stream_dedup", None), ("stream_upsert", None), ("stream_validate", "validate_text_high"),
    ("stream_validate_files", "base64_roundtrip_verdict")])
def test_a_stream_reads_a_table_that_is_a_folder_of_files(spark, tmp_path, name, twin):
    rows = [(i, "en", f"text {i // 2} <script ann.lee@mail.example.net", 30 + i // 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, lang STRING, text STRING, n_chars INT")
    docs.repartition(4).write.parquet(str(tmp_path / "folder/documents.parquet"))
    docs.limit(1).write.parquet(str(tmp_path / "folder/other_documents.parquet"))
    docs.toPandas().to_parquet(tmp_path / "documents.parquet", index=False)
    got = sorted(REGISTRY[name](spark, str(tmp_path / "folder")).collect())
    assert got == sorted(REGISTRY[name](spark, str(tmp_path)).collect())
    if twin:
        assert got == sorted(REGISTRY[twin](spark, str(tmp_path / "folder")).collect())
    assert len(got) == (60 if twin else 30)
