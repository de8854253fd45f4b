"""Statistics over validation logs and cache tables.

All of them combine within each task before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions.keys import key_kind


def event_counters(log: DataFrame) -> DataFrame:
    """(``counter``, ``value``): hits, misses, and validations per type and status.

    Validations count misses only. Needs ``cache_hit``, ``analysis_type``, ``status``.
    """
    grouped = log.groupBy("cache_hit", "analysis_type", "status").agg(
        F.count("*").alias("_gs_n"))
    names = F.when(F.col("cache_hit"), F.array(F.lit("cache_hits"))).otherwise(F.array(
        F.lit("cache_misses"),
        F.concat(F.lit("validations_"), F.col("analysis_type")),
        F.concat(F.lit("validations_"), F.col("analysis_type"), F.lit("_"), F.col("status"))))
    return (grouped.select(F.explode(names).alias("counter"), "_gs_n")
            .groupBy("counter").agg(F.sum("_gs_n").alias("value")))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Hits in percent of all lookups, 0.0 without any."""
    total = hits + misses
    return F.when(total > 0, hits / total * F.lit(100)).otherwise(F.lit(0.0))


def stats_rollup(log: DataFrame) -> DataFrame:
    """The statistics report as one row; an empty log gives zeros."""
    hit = F.coalesce(F.col("cache_hit"), F.lit(False))
    kind, status = F.col("analysis_type"), F.col("status")
    counted = log.agg(
        F.count_if(hit).alias("total_hits"),
        F.count_if(~hit).alias("total_misses"),
        F.count_if(~hit & (kind == "text")).alias("text_validations"),
        F.count_if(~hit & (kind == "file")).alias("file_validations"),
        F.count_if(~hit & (status == "safe")).alias("safe_results"),
        F.count_if(~hit & (status == "unsafe")).alias("unsafe_results"),
    )
    return counted.select("total_hits", "total_misses",
                          hit_rate(F.col("total_hits"), F.col("total_misses"))
                          .alias("hit_rate"),
                          "text_validations", "file_validations", "safe_results",
                          "unsafe_results")


def stats_from_counters(counters: DataFrame) -> DataFrame:
    """The same report from (``counter``, ``value``) rows; a counter that isn't there reads 0."""
    names = {"total_hits": "cache_hits", "total_misses": "cache_misses",
             "text_validations": "validations_text", "file_validations": "validations_file"}
    results = {f"{status}_results": [f"validations_{kind}_{status}" for kind in ("text", "file")]
               for status in ("safe", "unsafe")}
    chosen = {**{k: [v] for k, v in names.items()}, **results}
    read = counters.agg(*[
        F.coalesce(F.sum(F.when(F.col("counter").isin(c), F.col("value"))), F.lit(0)).alias(name)
        for name, c in chosen.items()])
    return read.select("total_hits", "total_misses",
                       hit_rate(F.col("total_hits"), F.col("total_misses")).alias("hit_rate"),
                       "text_validations", "file_validations", *results)


def stats_report(rollup: DataFrame, key_counts: DataFrame | None = None) -> DataFrame:
    """The report in its nested form: cache info, performance, validations."""
    groups = [
        F.struct("total_hits", "total_misses", "hit_rate").alias("cache_performance"),
        F.struct("text_validations", "file_validations", "safe_results", "unsafe_results")
         .alias("validation_stats"),
    ]
    if key_counts is None:
        return rollup.select(*groups)
    # two rows of different columns become one
    columns = [*rollup.columns, *key_counts.columns]
    merged = rollup.unionByName(key_counts, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in columns])
    return merged.select(F.struct(*key_counts.columns).alias("cache_info"), *groups)


def stats_snapshot(rollup: DataFrame, at: Column,
                   ttl_seconds: int = rules.STATS_TTL_SECONDS) -> DataFrame:
    """The report as a stored document: ``key``, ``value`` JSON and ``expires_at``."""
    return stats_report(rollup).select(
        F.lit("analysis_stats").alias("key"),
        F.to_json(F.struct("cache_performance", "validation_stats")).alias("value"),
        F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + ttl_seconds * 1_000_000)
         .alias("expires_at"))


def read_snapshot(stored: DataFrame, as_of: Column) -> DataFrame:
    """The stored report if it is live, back in columns."""
    ddl = ("cache_performance STRUCT<total_hits: BIGINT, total_misses: BIGINT, "
           "hit_rate: DOUBLE>, validation_stats STRUCT<text_validations: BIGINT, "
           "file_validations: BIGINT, safe_results: BIGINT, unsafe_results: BIGINT>")
    live = stored.filter((F.col("key") == "analysis_stats") & (F.col("expires_at") > as_of))
    report = live.select(F.from_json("value", ddl).alias("r"))
    return report.select("r.cache_performance.*", "r.validation_stats.*")


def key_census(keys: DataFrame, key: str = "cache_key") -> DataFrame:
    """Live keys per kind, the part before the first colon."""
    return keys.groupBy(key_kind(F.col(key)).alias("kind")).agg(F.count("*").alias("n_keys"))


def key_totals(keys: DataFrame, key: str = "cache_key") -> DataFrame:
    """Total, validation and counter keys as one row."""
    kind = key_kind(F.col(key))
    return keys.agg(F.count("*").alias("total_keys"),
                    F.count_if(kind == "validation").alias("validation_cache_keys"),
                    F.count_if(kind == "counter").alias("counter_keys"))


def latency_summary(log: DataFrame, ms: str = "latency_ms") -> DataFrame:
    return log.agg(F.count("*").alias("n_requests"), F.avg(ms).alias("avg_ms"),
                   F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))


def hit_miss_latency(log: DataFrame, ms: str = "latency_ms") -> DataFrame:
    """Average latency of hits and misses, and the improvement in percent.

    All NULL unless there are both.
    """
    hit = F.col("cache_hit")
    averages = log.agg(F.avg(F.when(hit, F.col(ms))).alias("h"),
                       F.avg(F.when(~hit, F.col(ms))).alias("m"))
    both = F.col("h").isNotNull() & F.col("m").isNotNull()
    return averages.select(
        F.when(both, F.col("h")).alias("avg_hit_ms"),
        F.when(both, F.col("m")).alias("avg_miss_ms"),
        F.when(both, (F.col("m") - F.col("h")) / F.col("m") * F.lit(100))
         .alias("improvement_pct"))


def issue_frequency(verdicts: DataFrame, *by: str) -> DataFrame:
    """How often each shown issue occurs, in all or per ``by`` columns.

    An extension: it rolls up the ``detected_issues`` that verdicts only list.
    """
    return (verdicts.select(*by, F.explode("detected_issues").alias("issue"))
            .groupBy(*by, "issue").agg(F.count("*").alias("n")))
