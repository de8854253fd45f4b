"""The plans are the ones that scale: checked on the physical plan."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from gatesift.operators import cache as C
from gatesift.operators import model as MV
from gatesift.operators import sessions as W
from gatesift.operators import stats as ST
from gatesift.operators import validate as V
from gatesift.sources.cache_store import read_cache, write_cache
from test_cache import entries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet")


def test_validation_has_no_shuffle_and_no_python(spark):
    text = plan(V.validate_text(documents(spark)))
    assert not any(node in text for node in ("Exchange", "EvalPython", "InArrow", "Join"))


def test_pruning_reaches_the_scan(spark):
    verdicts = V.validate_text(documents(spark))
    text = plan(verdicts.filter("doc_id < 10").select("doc_id", "status"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "LessThan(doc_id,10)" in text


def test_filter_on_verdict_scans_the_text_once(spark):
    verdicts = V.validate_text(documents(spark)).filter("status = 'unsafe'")
    # each signature occurs in one projection only
    assert plan(verdicts).count("Contains(_gs_lower#") == plan(
        V.validate_text(documents(spark))).count("Contains(_gs_lower#")


def requests(spark):
    return documents(spark).select(
        F.col("doc_id").alias("request_id"), F.lit("text").alias("analysis_type"),
        F.lit("high").alias("security_level"), F.col("text").alias("content"),
        F.timestamp_seconds(F.col("doc_id")).alias("ts"))


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are planned for large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def operators(df, name):
    """The input columns of each physical operator of a name, in the planned (not yet run) query."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return re.findall(rf"\n\(\d+\) {name}[^\n]*\nInput \[\d+\]: (.*)", text)


def test_winners_are_chosen_without_sorting_or_aggregating_texts(spark, tmp_path, no_broadcast):
    write_cache(entries(spark, ["a"]), str(tmp_path / "c"))
    cache = read_cache(spark, str(tmp_path / "c"))
    for df in (C.analyse_once(requests(spark)), C.latest_entries(cache),
               C.upsert(cache, cache.limit(1))):
        assert not operators(df, "SortAggregate") and operators(df, "HashAggregate")
        for columns in operators(df, "Sort"):
            assert "content#" not in columns and "text#" not in columns


def test_hits_carry_no_content(spark, tmp_path):
    write_cache(entries(spark, ["a"]), str(tmp_path / "c"))
    cache = read_cache(spark, str(tmp_path / "c"))
    df = C.validate_with_cache(requests(spark), C.latest_entries(cache))
    assert not operators(df, "SortAggregate")
    assert not any("text#" in c or "content#" in c for c in operators(df, "Exchange"))


def test_model_verdicts_meet_findings_not_texts(spark, no_broadcast):
    docs = documents(spark).select("doc_id", "text")
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet").select("doc_id", "toxic")
    known = labels.select("doc_id", (F.col("toxic") == 1).alias("blocked"))
    scorer = lambda texts: texts.select("doc_id", (1 / F.length("text")).alias("llm_score"))
    risky = V.risk_findings(docs).join(labels, "doc_id", "left")
    for df in (MV.decide_with_verdicts(V.text_findings(docs), known, "doc_id"),
               MV.decide_with_scorer(docs, scorer, "doc_id"),
               V.risk_verdicts(risky, F.lit("high"), "cast(toxic AS double)")):
        moved = operators(df, "Exchange")
        assert moved and not any("text#" in columns for columns in moved)
        text = plan(df)
        assert text.count("FileScan") == 2


def test_first_sightings_and_sessions_rank_nothing_by_row(spark):
    events = spark.read.parquet(f"{TESTDATA}/events.parquet")
    text = plan(W.first_sightings(events, "user_id", "ts", "event_id"))
    assert "Window" not in text and "partial_min" in text
    lives = plan(W.counter_sessions(events, ["user_id"]))
    assert "partial_min" in lives and lives.count("Exchange hashpartitioning") == 2


def test_clear_prunes_partitions(spark, tmp_path):
    write_cache(entries(spark, ["a"]), str(tmp_path / "c"))
    kept = C.clear_matching(read_cache(spark, str(tmp_path / "c")), "validation:file:low:*")
    assert kept.count() == 1
    live = plan(read_cache(spark, str(tmp_path / "c")).filter("analysis_type = 'file'"))
    assert "PartitionFilters: [isnotnull(analysis_type" in live


def test_report_has_no_cross_join(spark):
    log = spark.createDataFrame([], "cache_hit BOOLEAN, analysis_type STRING, status STRING")
    keys = spark.createDataFrame([], "cache_key STRING")
    text = plan(ST.stats_report(ST.stats_rollup(log), ST.key_totals(keys)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
