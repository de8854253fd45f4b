"""The verdict cache as a table: keys, lookups, upserts and clears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions.keys import cache_key, glob_segments, glob_to_regex, ttl_seconds
from gatesift.operators.validate import validate_routed
from gatesift.schemas import CACHE_ENTRY, RESULT, RESULT_FIELDS, VERDICT


def with_cache_key(df: DataFrame) -> DataFrame:
    """Add ``cache_key`` to routed requests; rejected ones get NULL."""
    return df.withColumn("cache_key", cache_key(
        F.col("content"), F.col("analysis_type"), F.col("security_level")))


def _with_join_key(df: DataFrame) -> DataFrame:
    """Add ``_gs_join``, the key to join by. Rejected requests have no key: they would all meet
    in one task, so each goes where a hash of its other columns sends it."""
    others = [f.name for f in df.schema.fields
              if f.name not in ("cache_key", "content")
              and not f.dataType.simpleString().startswith("map")]
    spread = F.concat(F.lit("rejected:"), F.hex(F.xxhash64(*others)))
    return df.withColumn("_gs_join", F.coalesce("cache_key", spread))


def join_by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on ``cache_key``."""
    return (_with_join_key(left)
            .join(right.withColumnRenamed("cache_key", "_gs_join"), "_gs_join", "left")
            .drop("_gs_join"))


def result_struct() -> Column:
    return F.struct(*[F.col(n).cast(t).alias(n) for n, t in RESULT_FIELDS.items()])


def cache_entries(verdicts: DataFrame, written_at: Column,
                  ttl: Column | None = None) -> DataFrame:
    """Cache entries of verdict rows, for every outcome, errors included."""
    expires = F.timestamp_micros(
        F.unix_micros(written_at.cast("timestamp"))
        + ttl_seconds(F.col("analysis_type"), ttl).cast("bigint") * 1_000_000)
    return verdicts.filter(F.col("cache_key").isNotNull()).select(
        "cache_key", "analysis_type", "security_level",
        result_struct().alias("result"),
        F.unix_seconds(written_at.cast("timestamp")).alias("cached_at"),
        expires.alias("expires_at"),
    )


def live_entries(cache: DataFrame, as_of: Column) -> DataFrame:
    """Entries that have not expired at ``as_of``."""
    return cache.filter(F.col("expires_at") > as_of)


# When an entry was written and how long it lives, as one number of fixed width.
_WRITTEN = ("coalesce(cast(cached_at AS decimal(18,0)), -9999999999BD) * 10000000000000000000BD "
            "+ coalesce(unix_micros(expires_at), -1)")


def latest_entries(cache: DataFrame) -> DataFrame:
    """The latest entry of each key; of those written in one second, that which lives longest.

    The choice is made on keys and times alone, a hash aggregation that combines before it
    shuffles; then the rows that won are picked. Verdicts are neither sorted nor aggregated, and
    the entries of a hot key are dealt out by their times. Equal entries are one.
    """
    written = F.expr(_WRITTEN)
    last = cache.groupBy(F.col("cache_key").alias("_gs_key")).agg(F.max(written).alias("_gs_last"))
    won = F.col("cache_key").eqNullSafe(F.col("_gs_key")) & (F.col("_gs_written") == F.col("_gs_last"))
    return (cache.select(*CACHE_ENTRY).withColumn("_gs_written", written)
            .join(last.hint("shuffle_hash"), won, "left_semi").drop("_gs_written").distinct())


def upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache after writing ``entries`` to it."""
    return latest_entries(cache.unionByName(entries))


def clear_matching(cache: DataFrame, pattern: str, key: str = "cache_key") -> DataFrame:
    """The cache without the keys that match a glob.

    Partitions that the glob cannot reach are kept without looking at their keys.
    """
    hit = F.col(key).rlike(glob_to_regex(pattern))
    for name, value in glob_segments(pattern).items():
        if name in cache.columns:
            hit = (F.col(name) == value) & hit
    return cache.filter(~F.coalesce(hit, F.lit(False)))


def clear_all(cache: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty cache and counters: both live in the same store."""
    return cache.filter(F.lit(False)), counters.filter(F.lit(False))


def entries_to_json(cache: DataFrame) -> DataFrame:
    """Entries as (``cache_key``, ``value`` JSON, ``expires_at``)."""
    body = F.struct("result.*", "cached_at", "analysis_type", "security_level")
    return cache.select("cache_key", F.to_json(body).alias("value"), "expires_at")


def entries_from_json(stored: DataFrame) -> DataFrame:
    """The inverse of :func:`entries_to_json`."""
    fields = {**RESULT_FIELDS, "cached_at": "bigint", "analysis_type": "string",
              "security_level": "string"}
    ddl = ", ".join(f"{n} {t}" for n, t in fields.items())
    body = stored.select("cache_key", "expires_at", F.from_json("value", ddl).alias("v"))
    return body.select(
        "cache_key", "v.analysis_type", "v.security_level",
        F.struct(*[F.col(f"v.{n}").alias(n) for n in RESULT_FIELDS]).cast(RESULT)
         .alias("result"),
        "v.cached_at", "expires_at")


def cache_lookup(requests: DataFrame, cache: DataFrame | None,
                 as_of: Column | None = None) -> DataFrame:
    """Add ``cache_hit`` and the stored verdict to keyed requests.

    ``cache`` has one row per key. Entries must be live at ``as_of``, by default the
    request's ``ts``. Hits carry the request's own level. ``cache=None`` is the cache
    switched off: every lookup misses.
    """
    if cache is None:
        return requests.withColumns({
            **{n: F.lit(None).cast(t) for n, t in RESULT_FIELDS.items()},
            "cached_at": F.lit(None).cast("bigint"),
            "cache_hit": F.lit(False),
        })
    moment = F.col("ts").cast("timestamp") if as_of is None else as_of
    entry = cache.select("cache_key", F.struct("result", "cached_at", "expires_at").alias("_gs_e"))
    joined = join_by_key(requests, entry)
    hit = F.coalesce(F.col("_gs_e.expires_at") > moment, F.lit(False))
    return joined.select(
        *requests.columns,
        *[F.when(hit, F.col(f"_gs_e.result.{n}")).alias(n) for n in RESULT_FIELDS],
        F.when(hit, F.col("_gs_e.cached_at")).alias("cached_at"),
        hit.alias("cache_hit"),
    )


def cached_requests(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    return requests.join(live_entries(cache, as_of).select("cache_key"), "cache_key",
                         "left_semi")


def uncached_requests(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Requests whose key has no live entry: the ones to analyse."""
    return requests.join(live_entries(cache, as_of).select("cache_key"), "cache_key",
                         "left_anti")


def validate_with_cache(requests: DataFrame, cache: DataFrame | None,
                        as_of: Column | None = None, **options) -> DataFrame:
    """Verdicts of routed requests: from the cache on a hit, else by analysis.

    ``analysis_type`` and ``cached_at`` are those of the stored verdict, so they are
    NULL for fresh verdicts; the request's own type is ``request_type``. Which requests miss is
    found by key and expiry alone; hits get their verdicts without their content.
    """
    kept = [c for c in requests.columns if c not in ("content", "analysis_type")]
    keyed = with_cache_key(requests)
    moment = F.col("ts").cast("timestamp") if as_of is None else as_of
    missed = keyed
    if cache is not None:
        live = cache.select(F.col("cache_key").alias("_gs_live"), F.col("expires_at").alias("_gs_until"))
        missed = _with_join_key(keyed).join(
            live, (F.col("_gs_join") == F.col("_gs_live")) & (F.col("_gs_until") > moment),
            "left_anti").drop("_gs_join")
    fresh = validate_routed(missed.withColumn("request_type", F.col("analysis_type")), **options)
    columns = [*kept, "cache_key", "request_type", *RESULT_FIELDS]
    fresh = fresh.select(
        *columns, F.when(F.col("request_type").isNotNull(), F.lit(False)).alias("cache_hit"),
        F.lit(None).cast("bigint").alias("cached_at"), F.lit(None).cast("string").alias("analysis_type"))
    if cache is None:
        return fresh
    entry = cache.select("cache_key", F.struct("result", "cached_at", "expires_at").alias("_gs_e"))
    hits = (keyed.drop("content").withColumnRenamed("analysis_type", "request_type")
            .join(entry, "cache_key").filter(F.col("_gs_e.expires_at") > moment))
    result = {n: F.col(f"_gs_e.result.{n}").alias(n) for n in RESULT_FIELDS}
    return fresh.unionByName(hits.select(
        *[result.get(c, F.col(c)) for c in columns], F.lit(True).alias("cache_hit"),
        F.col("_gs_e.cached_at").alias("cached_at"), F.col("request_type").alias("analysis_type")))


def to_verdict(df: DataFrame, *extra: str) -> DataFrame:
    """Exactly the verdict columns, missing ones as NULL, behind ``extra`` columns."""
    return df.select(*extra, *[
        (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n)
        for n, t in VERDICT.items()])


def analyse_once(requests: DataFrame, order: str = "request_id", **options) -> DataFrame:
    """Verdicts of routed requests, analysing equal content of a type and level once.

    The request with the least ``order`` (a fixed-width column) stands for its content. It is chosen
    by keys and ids alone, a hash aggregation that combines before it shuffles, and picked by a
    join that deals even a hot content out by id; contents are neither sorted nor aggregated.
    Verdicts come back by key, and adaptive execution splits the keys that are hot on the request
    side. Worth it only where copies are common; otherwise validating every row needs no shuffle.
    """
    keyed = with_cache_key(requests)
    first = keyed.filter(F.col("cache_key").isNotNull()).groupBy(F.col("cache_key").alias("_gs_key")).agg(
        F.min(order).alias("_gs_first"))
    stands = (F.col("cache_key") == F.col("_gs_key")) & F.col(order).eqNullSafe(F.col("_gs_first"))
    once = keyed.select("cache_key", order, "content", "analysis_type", "security_level").join(
        first.hint("shuffle_hash"), stands, "left_semi")
    # requests that share an id have their verdict once
    verdicts = validate_routed(once, **options).select("cache_key", *RESULT_FIELDS).distinct()
    return join_by_key(keyed.drop("content"), verdicts)
