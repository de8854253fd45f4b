import fnmatch
import hashlib

from pyspark.sql import functions as F

from gatesift.functions.keys import glob_segments, glob_to_regex
from gatesift.operators import cache as C
from gatesift.operators import sessions as W
from gatesift.schemas import RESULT_FIELDS, VERDICT
from gatesift.sources.cache_store import read_cache, write_cache

# seven requests, two of them repeats
TEXTS = ["Hello world", "another safe text", "please process", "Hello world", "You are stupid",
         "<script", "You are stupid"]


def routed(spark, texts=TEXTS, level="high"):
    df = spark.createDataFrame(list(enumerate(texts)), "request_id INT, content STRING")
    return df.withColumns({
        "ts": F.timestamp_seconds(F.col("request_id") * 10),
        "analysis_type": F.lit("text"), "security_level": F.lit(level)})


def entries(spark, texts, at=0):
    df = C.validate_routed(C.with_cache_key(routed(spark, texts)))
    return C.cache_entries(df, F.timestamp_seconds(F.lit(at)))


def test_key_format(spark):
    row = C.with_cache_key(routed(spark, ["é "], "low")).first()
    assert row.cache_key == \
        "validation:text:low:" + hashlib.sha256("é ".encode()).hexdigest()
    rejected = routed(spark).withColumn("analysis_type", F.lit(None).cast("string"))
    assert C.with_cache_key(rejected).filter("cache_key IS NOT NULL").isEmpty()


def test_hits_come_from_the_cache(spark):
    cache = entries(spark, ["Hello world", "You are stupid"], at=-1000)
    out = C.validate_with_cache(routed(spark, level="high"), cache, F.timestamp_seconds(F.lit(0)))
    rows = out.orderBy("request_id").collect()
    assert [r.cache_hit for r in rows] == [True, False, False, True, True, False, True]
    assert [r.cached_at for r in rows] == [-1000, None, None, -1000, -1000, None, -1000]
    assert [r.analysis_type for r in rows] == ["text", None, None, "text", "text", None, "text"]
    fresh = C.validate_routed(routed(spark)).orderBy("request_id").collect()
    for name in RESULT_FIELDS:
        assert [r[name] for r in rows] == [r[name] for r in fresh]


def test_stored_verdict_wins_and_level_is_overwritten(spark):
    cache = entries(spark, ["Hello world"]).withColumn(
        "result", F.col("result").withField("reason", F.lit("from the store")))
    requests = C.with_cache_key(routed(spark, ["Hello world"])) \
        .withColumn("security_level", F.lit("low"))
    row = C.cache_lookup(requests, cache, F.timestamp_seconds(F.lit(1))).first()
    assert (row.reason, row.security_level, row.cache_hit) == ("from the store", "low", True)


def test_expiry_and_degraded_mode(spark):
    cache = entries(spark, ["Hello world"])
    keyed = C.with_cache_key(routed(spark, ["Hello world", "x"]))
    for at, n in [(1799, 1), (1800, 0)]:
        moment = F.timestamp_seconds(F.lit(at))
        assert C.live_entries(cache, moment).count() == n
        assert C.cached_requests(keyed, cache, moment).count() == n
        assert C.uncached_requests(keyed, cache, moment).count() == 2 - n
    off = C.validate_with_cache(routed(spark, ["Hello world"]), None).first()
    assert (off.status, off.cache_hit) == ("safe", False)


def test_upsert_keeps_the_latest(spark):
    merged = C.upsert(entries(spark, ["a", "b"], 0), entries(spark, ["b", "c"], 60))
    assert sorted(r.cached_at for r in merged.collect()) == [0, 60, 60]


def test_error_verdicts_are_stored_but_rejects_are_not(spark):
    df = routed(spark, ["a", "b"]).withColumns({
        "content": F.when(F.col("request_id") == 0, "!!!!"),
        "analysis_type": F.when(F.col("request_id") == 0, "file")})
    stored = C.cache_entries(C.validate_routed(C.with_cache_key(df)), F.col("ts")).collect()
    assert [(r.result.status, r.analysis_type) for r in stored] == [("error", "file")]
    assert (stored[0].expires_at.timestamp() - stored[0].cached_at) == 7200


def test_json_and_storage_round_trip(spark, tmp_path):
    cache = entries(spark, TEXTS)
    back = C.entries_from_json(C.entries_to_json(cache))
    assert sorted(back.select(*cache.columns).collect()) == sorted(cache.collect())
    write_cache(cache, str(tmp_path / "cache"))
    assert sorted(read_cache(spark, str(tmp_path / "cache")).collect()) == sorted(cache.collect())


def test_globs():
    keys = ["validation:text:high:ab", "validation:file:low:ab", "counter:cache_hits", "a.b",
            "axb", "a*b", "[x]"]
    import re
    for pattern in ["*", "validation:*", "validation:text:*", "counter:?ache*", "a.b", "a?b",
                    "*[a-c]b", "valid*:low:*", "nothing"]:
        got = [k for k in keys if re.search(glob_to_regex(pattern), k)]
        assert got == [k for k in keys if fnmatch.fnmatchcase(k, pattern)], pattern
    assert re.search(glob_to_regex(r"a\*b"), "a*b") and not re.search(glob_to_regex(r"a\*b"), "axb")
    assert re.search(glob_to_regex("a[^x]b"), "a.b") and not re.search(glob_to_regex("a[^x]b"), "axb")
    assert glob_segments("validation:text:high:a*") == \
        {"analysis_type": "text", "security_level": "high"}
    assert glob_segments("validation:t*:high:*") == {}
    assert glob_segments("validation:text*") == {}


def test_clears(spark):
    cache = entries(spark, ["a", "b"]).unionByName(
        entries(spark, ["c"]).withColumns({
            "cache_key": F.lit("validation:file:low:00"), "analysis_type": F.lit("file"),
            "security_level": F.lit("low")}))
    assert C.clear_matching(cache, "validation:file:*").count() == 2
    assert C.clear_matching(cache, "validation:text:high:*").count() == 1
    assert C.clear_matching(cache, "*").count() == 0
    assert C.clear_matching(cache, "counter:*").count() == 3
    assert [d.count() for d in C.clear_all(cache, spark.range(3))] == [0, 0]


def test_analyse_once_equals_plain_validation(spark):
    requests = routed(spark, TEXTS * 20)
    plain = C.with_cache_key(C.validate_routed(requests.withColumn("c", F.col("content"))))
    once = C.analyse_once(requests)
    columns = ["request_id", *RESULT_FIELDS]
    assert sorted(once.select(*columns).collect()) == sorted(plain.select(*columns).collect())


def test_demo_requests_have_two_repeats(spark):
    keyed = C.with_cache_key(routed(spark)).drop("content")
    rows = W.first_sightings(keyed).orderBy("request_id").collect()
    assert [r.is_duplicate for r in rows] == [False, False, False, True, False, False, True]


def test_verdict_schema(spark):
    out = C.to_verdict(C.validate_with_cache(routed(spark), None), "request_id")
    assert out.columns == ["request_id", *VERDICT]
    assert [f.dataType.simpleString() for f in out.schema.fields[1:]] == list(VERDICT.values())


def test_rejected_requests_do_not_meet_in_one_task(spark):
    requests = routed(spark, ["a"] * 400).withColumn("analysis_type", F.lit(None).cast("string"))
    once = C.analyse_once(requests)
    assert once.count() == 400 and once.filter("status IS NOT NULL").isEmpty()
    looked_up = C.cache_lookup(C.with_cache_key(requests), entries(spark, ["a"]))
    assert looked_up.count() == 400 and looked_up.filter("cache_hit").isEmpty()
    assert "_gs_join" not in looked_up.columns
