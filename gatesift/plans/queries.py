"""The registered queries: each operator over whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions import detectors as D
from gatesift.functions import payload as P
from gatesift.functions import routing as R
from gatesift.functions import scoring as S
from gatesift.operators import analyze as A
from gatesift.operators import cache as C
from gatesift.operators import matches as M
from gatesift.operators import model as MV
from gatesift.operators import replay
from gatesift.operators import sessions as W
from gatesift.operators import stats as ST
from gatesift.operators import validate as V
from gatesift.plans import inputs as I
from gatesift.schemas import CORRUPT
from gatesift.session import shared_dir
from gatesift.sources.cache_store import read_cache, write_cache
from gatesift.sources.dictionaries import keywords_table, rules_table
from gatesift.sources.files import analyze_files, read_listed_files
from gatesift.sources.pages import analyze_pages
from gatesift.sources.requests import read_requests, read_verdicts, stream_requests, write_verdicts
from gatesift.streaming import validation as SV

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def register(function: Query) -> Query:
        REGISTRY[name] = function
        return function
    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def joined(issues: str | Column) -> Column:
    return F.array_join(issues, ", ")


def micros(column: str | Column) -> Column:
    return F.unix_micros(column)


VERDICT = ["status", "reason", "llm_score", "rule_score", "overall_score"]


def shown(df: DataFrame, *ids: str) -> DataFrame:
    """Verdict columns with the issue list as text."""
    return df.select(*ids, *VERDICT, joined("detected_issues").alias("issues"))


# ------------------------------------------------------------------- texts

def _validate_text(level: str) -> Query:
    return lambda spark, sf: shown(V.validate_text(I.corpus(spark, sf), level=level), "doc_id")


for _level in rules.LEVELS:
    REGISTRY[f"validate_text_{_level}"] = _validate_text(_level)


@query("validate_pages")
def validate_pages(spark, sf):
    pages = I.texts(spark, sf, "pages", "page_id", "html")
    return shown(V.validate_text(pages, "html"), "page_id")


@query("validate_conversations")
def validate_conversations(spark, sf):
    turns = I.texts(spark, sf, "conversations", "conv_id", "turn", "text")
    return shown(V.validate_text(turns, level="medium"), "conv_id", "turn")


@query("validate_benchmark")
def validate_benchmark(spark, sf):
    items = I.table(spark, sf, "benchmark").select("item_id", "text")
    return shown(V.validate_text(items, level="low"), "item_id")


@query("unsafe_documents_by_language")
def unsafe_documents_by_language(spark, sf):
    verdicts = V.validate_text(I.corpus(spark, sf))
    return verdicts.groupBy("lang", "status").agg(F.count("*").alias("n_docs"))


@query("verdict_summary_text")
def verdict_summary_text(spark, sf):
    one = A.analyze_text(I.corpus(spark, sf))
    return one.groupBy(F.col("analysis.analysis_summary").alias("analysis_summary"),
                       F.col("analysis.is_safe").alias("is_safe")) \
              .agg(F.count("*").alias("n_docs"))


# --------------------------------------------------------------- detectors

def _detect(family: str) -> Query:
    return lambda spark, sf: I.corpus(spark, sf).select(
        "doc_id", joined(D.detect_family("text", family)).alias("issues"))


for _name, _key in {"sql": "sql", "xss": "xss", "command": "cmd", "nosql": "nosql",
                    "ldap": "ldap", "path": "path", "xml": "xml", "template": "template",
                    "code": "code_exec", "suspicious": "suspicious"}.items():
    REGISTRY[f"detect_{_key}"] = _detect(_name)


@query("detect_nosql_file")
def detect_nosql_file(spark, sf):
    return I.corpus(spark, sf).select(
        "doc_id", joined(D.detect_family("text", "nosql", "file")).alias("issues"))


@query("detect_keyword")
def detect_keyword(spark, sf):
    return I.corpus(spark, sf).select(
        "doc_id", D.has_harmful_keyword("text").alias("has_keyword"))


@query("detect_email")
def detect_email(spark, sf):
    return I.corpus(spark, sf).select("doc_id", D.has_email("text").alias("hit"))


@query("detect_phone")
def detect_phone(spark, sf):
    return I.corpus(spark, sf).select("doc_id", D.has_phone("text").alias("hit"))


@query("detect_ssn")
def detect_ssn(spark, sf):
    return I.corpus(spark, sf).select("doc_id", D.has_ssn("text").alias("hit"))


@query("detect_pii")
def detect_pii(spark, sf):
    return I.corpus(spark, sf).select(
        "doc_id", joined(D.detect_pii("text")).alias("issues"))


@query("injection_issues")
def injection_issues(spark, sf):
    found, names = D.scan(I.corpus(spark, sf), "text", "false")
    return found.select("doc_id", joined(names.injection).alias("issues"))


@query("rule_matches_long")
def rule_matches_long(spark, sf):
    return M.rule_matches(I.corpus(spark, sf).select("doc_id", "text"))


@query("rule_matches_pages")
def rule_matches_pages(spark, sf):
    pages = I.texts(spark, sf, "pages", "page_id", "html").withColumnRenamed("html", "text")
    return M.rule_matches(pages, profile="file").groupBy("family", "pattern") \
            .agg(F.count("*").alias("n_pages"))


@query("rule_table_matches")
def rule_table_matches(spark, sf):
    return M.rule_table_matches(I.corpus(spark, sf).select("doc_id", "text"), rules_table(spark))


@query("keyword_matches")
def keyword_matches(spark, sf):
    return M.keyword_matches(I.corpus(spark, sf).select("doc_id", "text"))


@query("keyword_table_matches")
def keyword_table_matches(spark, sf):
    return M.keyword_table_matches(I.corpus(spark, sf).select("doc_id", "text"),
                                   keywords_table(spark))


# ---------------------------------------------------------------- profiles

def _analysis(df: DataFrame, *ids: str) -> DataFrame:
    return df.select(*ids, F.col("analysis.is_safe").alias("is_safe"),
                     F.col("analysis.confidence_score").alias("confidence_score"),
                     joined("analysis.detected_issues").alias("issues"),
                     F.col("analysis.analysis_summary").alias("analysis_summary"))


@query("analyze_text_profile")
def analyze_text_profile(spark, sf):
    return _analysis(A.analyze_text(I.corpus(spark, sf)), "doc_id")


@query("analyze_file_profile")
def analyze_file_profile(spark, sf):
    return _analysis(A.analyze_file_text(I.corpus(spark, sf)), "doc_id")


@query("analyze_file_profile_half")
def analyze_file_profile_half(spark, sf):
    return _analysis(A.analyze_file_text(I.corpus(spark, sf), threshold=0.5, max_bytes=20_000),
                     "doc_id")


@query("file_safety_score")
def file_safety_score(spark, sf):
    found, names = D.scan(I.corpus(spark, sf), "text", "true")
    score = S.file_safety_score(names.injection, names.pii)
    return found.select("doc_id", score.alias("score"))


@query("is_content_safe_text")
def is_content_safe_text(spark, sf):
    return A.with_content_safety(I.corpus(spark, sf)).filter("is_content_safe").select("doc_id")


@query("is_content_safe_file")
def is_content_safe_file(spark, sf):
    safe = A.with_content_safety(I.corpus(spark, sf), profile="file", threshold=0.5)
    return safe.filter("is_content_safe").select("doc_id")


@query("paged_document_verdict")
def paged_document_verdict(spark, sf):
    pages = I.table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", (F.col("conv_id") % 4 == 0).alias("has_embedded_files"))
    docs = analyze_pages(pages, "conv_id", "turn")
    verdict = S.verdict_columns("analysis", "'high'")
    docs = docs.withColumns({n: verdict[n] for n in ("status", "overall_score")})
    return _analysis(docs, "conv_id", "n_pages", "status", "overall_score")


# ------------------------------------------------------------------- files

@query("base64_roundtrip_verdict")
def base64_roundtrip_verdict(spark, sf):
    return shown(V.validate_file(I.document_payloads(spark, sf)), "doc_id")


@query("unread_pdf_verdict")
def unread_pdf_verdict(spark, sf):
    verdicts = V.validate_file(I.document_payloads(spark, sf), decode_unread_pdf=False)
    return verdicts.groupBy("status", "reason").agg(F.count("*").alias("n_files"))


@query("extracted_pdf_verdict")
def extracted_pdf_verdict(spark, sf):
    verdicts = V.validate_file(I.document_payloads(spark, sf), level="medium",
                               pdf_text=F.col("text"), embedded=F.col("doc_id") % 2 == 0)
    return verdicts.select("doc_id", "status", "reason", "overall_score", "analysis_summary")


@query("file_source_analysis")
def file_source_analysis(spark, sf):
    folder = _folder(spark, "files")
    I.document_files(spark, sf, folder)
    # every file is listed, and of every seventh another one that nobody wrote
    bundles = I.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / I.BUNDLE).alias("bundle"))
    missing = bundles.filter("bundle % 7 = 2").select((-1 - F.col("bundle")).alias("bundle"))
    number = F.regexp_extract("path", "bundle=([0-9]+)", 1)
    found = read_listed_files(spark, folder, bundles.union(missing), number)
    return _analysis(analyze_files(found, error="error", available=F.col("bundle") % 10 != 9), "bundle")


@query("file_type_census")
def file_type_census(spark, sf):
    data = P.with_decoded_base64(I.document_payloads(spark, sf), "file", "data")
    kinds = P.with_file_kind(data, "data", "kind").select(F.coalesce(
        F.when(F.col("data").isNull(), F.lit("invalid")), "kind", F.lit("other")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n_files"))


@query("size_guard")
def size_guard(spark, sf):
    verdicts = V.validate_file(I.document_payloads(spark, sf), max_bytes=5_000)
    return verdicts.select("doc_id", "status", "reason", "overall_score")


@query("display_error")
def display_error(spark, sf):
    verdicts = V.validate_file(I.document_payloads(spark, sf))
    return verdicts.select(
        "doc_id", S.display_error("status", "reason").alias("message"))


# ---------------------------------------------------------------- requests

def _routed(df: DataFrame) -> DataFrame:
    return df.select("request_id", "security_level", "request_error", "analysis_type",
                     F.sha2("content", 256).alias("content_hash"))


@query("route_requests")
def route_requests(spark, sf):
    return _routed(V.route_requests(I.mixed_requests(spark, sf)))


def _read_routed(requests: DataFrame) -> DataFrame:
    """Routed requests; of malformed ones, the line in place of the content."""
    routed = V.route_requests(requests)
    return _routed(routed.withColumn("content", F.coalesce("content", CORRUPT)))


@query("read_json_requests")
def read_json_requests(spark, sf):
    folder = _folder(spark, "requests")
    I.request_lines(spark, sf).write.text(folder)
    return _read_routed(read_requests(spark, folder, "json"))


@query("stream_json_requests")
def stream_json_requests(spark, sf):
    folder = _folder(spark, "requests")
    I.request_lines(spark, sf).write.text(f"{folder}/in")
    SV.run_append(_read_routed(stream_requests(spark, f"{folder}/in", "json")),
                  f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@query("verdict_sink")
def verdict_sink(spark, sf):
    folder = _folder(spark, "verdicts")
    verdicts = V.validate_requests(I.mixed_requests(spark, sf))
    for batch in (0, 1, 0):  # the first again, as after a failure
        write_verdicts(verdicts.filter(F.col("request_id") % 2 == batch), folder, "request_id", batch=str(batch))
    back = read_verdicts(spark, folder, "request_id BIGINT").filter("status = 'unsafe'")
    return back.select("request_id", "batch", "status", "reason", "overall_score")


@query("gateway_requests")
def gateway_requests(spark, sf):
    return _routed(V.route_requests(I.mixed_requests(spark, sf), policy="gateway"))


@query("resolve_level")
def resolve_level(spark, sf):
    level = "security_level"
    return I.mixed_requests(spark, sf).select(
        "request_id", R.resolve_level(level, "medium").alias("strict_level"),
        R.resolve_level(level, "medium", strict=False).alias("lenient_level"))


@query("validate_requests")
def validate_requests(spark, sf):
    return shown(V.validate_requests(I.mixed_requests(spark, sf)),
                 "request_id", "request_error", "analysis_type", "security_level")


@query("validate_requests_fixed_level")
def validate_requests_fixed_level(spark, sf):
    verdicts = V.validate_requests(I.mixed_requests(spark, sf), fixed_level="high")
    return verdicts.groupBy("security_level", "status", "llm_score").agg(
        F.count("*").alias("n_requests"))


# ----------------------------------------------------------- model verdicts

def _with_labels(df: DataFrame, spark, sf) -> DataFrame:
    return df.join(I.table(spark, sf, "labels").select("doc_id", "toxic", "quality"), "doc_id", "left")


@query("model_verdict_join")
def model_verdict_join(spark, sf):
    labels = I.table(spark, sf, "labels").select(
        "doc_id", (F.col("toxic") == 1).alias("blocked"))
    verdicts = MV.decide_with_verdicts(V.text_findings(I.corpus(spark, sf)), labels, "doc_id",
                                       level=I.level_of(F.col("doc_id")))
    return shown(verdicts, "doc_id")


@query("model_scorer")
def model_scorer(spark, sf):
    def scorer(texts):
        """Stands in for a model: the share of a text that is not vowels, in tenths."""
        vowels = F.length(F.regexp_replace("text", "[^aeiou]", ""))
        return texts.select("doc_id", F.round(1 - vowels / F.length("text"), 1)
                            .alias("llm_score"))
    verdicts = MV.decide_with_scorer(I.corpus(spark, sf), scorer, "doc_id")
    return verdicts.select("doc_id", "status", "reason",
                           F.round("overall_score", 6).alias("overall_score"))


@query("weighted_overall")
def weighted_overall(spark, sf):
    score = F.when(F.col("quality") == 0, F.lit(0.75)).when(F.col("quality") == 1, F.lit(0.95))
    labelled = _with_labels(V.text_findings(I.corpus(spark, sf)), spark, sf)
    verdicts = V.decide(labelled, I.level_of(F.col("doc_id")), llm_score=score)
    return verdicts.select("doc_id", "status", "reason", F.round("llm_score", 6)
                           .alias("llm_score"), F.round("overall_score", 6)
                           .alias("overall_score"))


@query("risk_score_legacy")
def risk_score_legacy(spark, sf):
    labelled = _with_labels(V.risk_findings(I.corpus(spark, sf)), spark, sf)
    scored = V.risk_verdicts(labelled, I.level_of(F.col("doc_id")), "cast(toxic AS double)")
    return scored.select("doc_id", "status", "reason",
                         *[F.round(c, 6).alias(c)
                           for c in ("rule_score", "llm_score", "overall_score")])


# ------------------------------------------------------------------- cache

def as_of() -> Column:
    return F.timestamp_micros(F.lit(I.START_US + 2_200 * 1_000_000))


def _document_cache(spark, sf, labelled_only: bool = False) -> DataFrame:
    """Entries of all documents, written at their request times; or of the labelled ones, for
    look-ups that are to hit and to miss."""
    requests = I.document_requests(spark, sf)
    if labelled_only:
        labelled = I.table(spark, sf, "labels").select(F.col("doc_id").alias("request_id"))
        requests = requests.join(labelled, "request_id", "left_semi")
    entries = C.cache_entries(V.validate_routed(C.with_cache_key(requests)), F.col("ts"))
    path = _folder(spark, "cache")
    write_cache(entries, path)
    return read_cache(spark, path)


@query("cache_keys")
def cache_keys(spark, sf):
    return C.with_cache_key(I.document_requests(spark, sf)).select("request_id", "cache_key")


@query("cache_entries")
def cache_entries(spark, sf):
    return _document_cache(spark, sf).select(
        "cache_key", "security_level", F.col("result.status").alias("status"),
        F.col("result.reason").alias("reason"), "cached_at",
        micros("expires_at").alias("expires_us"))


@query("latest_entry")
def latest_entry(spark, sf):
    return C.latest_entries(_document_cache(spark, sf)).select(
        "cache_key", "cached_at", F.col("result.status").alias("status"))


@query("upsert_entries")
def upsert_entries(spark, sf):
    cache = _document_cache(spark, sf)
    later = cache.withColumns({
        "cached_at": F.col("cached_at") + 600,
        "expires_at": F.timestamp_micros(micros("expires_at") + 600_000_000),
    }).filter(F.col("security_level") == "high")
    return C.upsert(cache, later).select(
        "cache_key", "cached_at", micros("expires_at").alias("expires_us"))


@query("live_entries")
def live_entries(spark, sf):
    return C.live_entries(C.latest_entries(_document_cache(spark, sf)), as_of()).select("cache_key")


@query("clear_by_glob")
def clear_by_glob(spark, sf):
    kept = C.clear_matching(C.latest_entries(_document_cache(spark, sf)),
                            "validation:text:high:[0-7]*")
    return kept.select("cache_key")


@query("entry_json_roundtrip")
def entry_json_roundtrip(spark, sf):
    stored = C.entries_to_json(C.latest_entries(_document_cache(spark, sf)))
    back = C.entries_from_json(stored)
    return back.select("cache_key", "analysis_type", "security_level", "cached_at",
                       F.col("result.reason").alias("reason"),
                       F.col("result.overall_score").alias("overall_score"),
                       joined("result.detected_issues").alias("issues"))


@query("cache_lookup")
def cache_lookup(spark, sf):
    requests = C.with_cache_key(I.document_requests(spark, sf)).drop("content")
    looked_up = C.cache_lookup(requests, C.latest_entries(_document_cache(spark, sf, labelled_only=True)), as_of())
    return looked_up.select("request_id", "cache_hit", "status", "reason", "cached_at")


@query("uncached_requests")
def uncached_requests(spark, sf):
    requests = C.with_cache_key(I.document_requests(spark, sf)).drop("content")
    cache = C.latest_entries(_document_cache(spark, sf, labelled_only=True))
    return C.uncached_requests(requests, cache, as_of()).select("request_id", "cache_key")


@query("cached_requests")
def cached_requests(spark, sf):
    requests = C.with_cache_key(I.document_requests(spark, sf)).drop("content")
    cache = C.latest_entries(_document_cache(spark, sf, labelled_only=True))
    return C.cached_requests(requests, cache, as_of()).select("request_id", "cache_key")


@query("validate_with_cache")
def validate_with_cache(spark, sf):
    cache = C.latest_entries(_document_cache(spark, sf, labelled_only=True))
    verdicts = C.validate_with_cache(I.document_requests(spark, sf), cache, as_of())
    return verdicts.select("request_id", "security_level", "cache_hit", "status", "reason",
                           "overall_score", "cached_at", "analysis_type")


@query("validate_without_cache")
def validate_without_cache(spark, sf):
    verdicts = C.validate_with_cache(I.document_requests(spark, sf), None)
    return verdicts.select("request_id", "security_level", "cache_hit", "status", "reason",
                           "overall_score", "cached_at", "analysis_type")


@query("analyse_once")
def analyse_once(spark, sf):
    verdicts = C.analyse_once(I.document_requests(spark, sf))
    return shown(verdicts, "request_id", "cache_key")


# ----------------------------------------------------------------- the log

def _log_keys(spark, sf) -> DataFrame:
    keyed = C.with_cache_key(I.request_log(spark, sf))
    return keyed.select("request_id", "ts", "cache_key", "analysis_type", "latency_ms")


def _replayed(spark, sf) -> DataFrame:
    return replay.ttl_replay(_log_keys(spark, sf))


def _replayed_verdicts(spark, sf) -> DataFrame:
    """The replayed log with the status of each request, analysed once per key."""
    verdicts = C.analyse_once(I.request_log(spark, sf)).select("request_id", "status")
    return _replayed(spark, sf).join(verdicts, "request_id")


@query("ttl_replay")
def ttl_replay(spark, sf):
    return _replayed(spark, sf).select(
        "request_id", "cache_key", "cache_hit", micros("written_at").alias("written_us"),
        micros("expires_at").alias("expires_us"))


@query("replay_stats")
def replay_stats(spark, sf):
    return _replayed(spark, sf).groupBy("analysis_type").agg(
        F.count_if("cache_hit").alias("n_hits"),
        F.count_if(~F.col("cache_hit")).alias("n_misses"))


@query("event_counters")
def event_counters(spark, sf):
    return ST.event_counters(_replayed_verdicts(spark, sf))


@query("hit_rate")
def hit_rate(spark, sf):
    rollup = ST.stats_rollup(_replayed_verdicts(spark, sf))
    return rollup.withColumn("hit_rate", F.round("hit_rate", 6))


@query("empty_log_stats")
def empty_log_stats(spark, sf):
    log = I.request_log(spark, sf).filter(F.col("latency_ms") < 0).select(
        "analysis_type", F.lit(False).alias("cache_hit"), F.lit("safe").alias("status"))
    return ST.stats_rollup(log)


@query("missing_counter_stats")
def missing_counter_stats(spark, sf):
    log = _replayed_verdicts(spark, sf).filter("analysis_type = 'text' AND status = 'safe'")
    rollup = ST.stats_from_counters(ST.event_counters(log))
    return rollup.withColumn("hit_rate", F.round("hit_rate", 6))


@query("stats_snapshot")
def stats_snapshot(spark, sf):
    rollup = ST.stats_rollup(_replayed_verdicts(spark, sf))
    stored = ST.stats_snapshot(rollup, as_of())
    back = ST.read_snapshot(stored, as_of())
    return back.withColumn("hit_rate", F.round("hit_rate", 6))


@query("key_census")
def key_census(spark, sf):
    validation = C.latest_entries(_document_cache(spark, sf)).select("cache_key")
    counters = ST.event_counters(_replayed_verdicts(spark, sf)).select(
        F.concat(F.lit("counter:"), "counter").alias("cache_key"))
    return ST.key_census(validation.unionByName(counters))


@query("cache_info")
def cache_info(spark, sf):
    log = _replayed_verdicts(spark, sf)
    validation = C.latest_entries(_document_cache(spark, sf)).select("cache_key")
    counters = ST.event_counters(log).select(
        F.concat(F.lit("counter:"), "counter").alias("cache_key"))
    report = ST.stats_report(ST.stats_rollup(log),
                             ST.key_totals(validation.unionByName(counters)))
    return report.select("cache_info.*", "cache_performance.total_hits",
                         "validation_stats.safe_results")


@query("first_sighting")
def first_sighting(spark, sf):
    return W.first_sightings(_log_keys(spark, sf)).select(
        "request_id", "cache_key", "is_duplicate")


@query("first_sighting_documents")
def first_sighting_documents(spark, sf):
    requests = C.with_cache_key(I.document_requests(spark, sf)).drop("content")
    return W.first_sightings(requests).groupBy("is_duplicate").agg(
        F.count("*").alias("n_requests"))


def _increments(spark, sf) -> DataFrame:
    return I.table(spark, sf, "events").select("user_id", "event_type",
                                               I.utc(F.col("ts")).alias("ts"))


@query("counter_sessions")
def counter_sessions(spark, sf):
    lives = W.counter_sessions(_increments(spark, sf), ["user_id", "event_type"])
    return lives.select("user_id", "event_type", micros("session_start").alias("start_us"),
                        micros("last_increment").alias("last_us"), "counter_value")


@query("counter_values")
def counter_values(spark, sf):
    at = F.timestamp_micros(F.lit(I.START_US + 15 * 86_400 * 1_000_000))
    before = _increments(spark, sf).filter(F.col("ts") <= at)
    lives = W.counter_sessions(before, ["user_id", "event_type"])
    return W.counter_values(lives, ["user_id", "event_type"], at)


@query("latency_summary")
def latency_summary(spark, sf):
    summary = ST.latency_summary(_log_keys(spark, sf))
    return summary.withColumn("avg_ms", F.round("avg_ms", 6))


@query("hit_miss_latency")
def hit_miss_latency(spark, sf):
    compared = ST.hit_miss_latency(_replayed(spark, sf))
    return compared.select(*[F.round(c, 6).alias(c) for c in compared.columns])


@query("issue_frequency")
def issue_frequency(spark, sf):
    return ST.issue_frequency(V.validate_text(I.corpus(spark, sf)))


@query("issue_by_lang")
def issue_by_lang(spark, sf):
    return ST.issue_frequency(V.validate_text(I.corpus(spark, sf)), "lang")


# --------------------------------------------------------------- streaming

def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # a table is a file or a folder of files; a stream takes a file only by a pattern
    schema = I.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}.parquet}}")


class _Streams:
    """A session whose ``read`` is a stream: inputs become their streaming twins."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        folder, name = path.rsplit("/", 1)
        return _stream(self._spark, folder, name.removesuffix(".parquet"))

    def pieces(self, folder: str, name: str) -> int:
        """How many tasks read the table that a stream takes its rows from."""
        return I.table(self._spark, folder, name).rdd.getNumPartitions()


@query("stream_validate")
def stream_validate(spark, sf):
    verdicts = V.validate_text(I.corpus(_Streams(spark), sf)).drop("text")
    out = _folder(spark, "stream-validate")
    SV.run_append(verdicts, f"{out}/verdicts", f"{out}/checkpoint")
    return shown(spark.read.parquet(f"{out}/verdicts"), "doc_id")


@query("stream_validate_files")
def stream_validate_files(spark, sf):
    verdicts = V.validate_file(I.document_payloads(_Streams(spark), sf)).drop("text", "file")
    out = _folder(spark, "stream-files")
    SV.run_append(verdicts, f"{out}/verdicts", f"{out}/checkpoint")
    return shown(spark.read.parquet(f"{out}/verdicts"), "doc_id")


def _shown_replay(replayed: DataFrame) -> DataFrame:
    return replayed.select(
        "request_id", "cache_key", "cache_hit", micros("written_at").alias("written_us"),
        micros("expires_at").alias("expires_us"))


@query("stream_ttl_replay")
def stream_ttl_replay(spark, sf):
    out = _folder(spark, "stream-replay")
    replay_stream = SV.run_ttl_replay(_log_keys(_Streams(spark), sf), out, f"{out}/checkpoint",
                                      delay_seconds=0)
    return _shown_replay(replay_stream.read())


# Events arrive up to two days after they happened, in this many runs of a stream.
ARRIVALS, ARRIVAL_DAYS, LATEST_DAYS = 4, 8, 2


def _arriving(spark: SparkSession, log: DataFrame, order: str,
              run: Callable[[DataFrame, str], object]) -> object:
    """Write a log in parts, by the time its rows arrive, and run a stream after each of them.

    Within a part rows have no order, and parts overlap by up to two days of event time.
    """
    day = 86_400 * 1_000_000
    arrival = micros("ts") + F.pmod(F.xxhash64(order), F.lit(LATEST_DAYS * day)) - I.START_US
    part = F.least(F.greatest(F.floor(arrival / (ARRIVAL_DAYS * day)), F.lit(0)), F.lit(ARRIVALS - 1))
    out = _folder(spark, "stream-arrivals")
    result = None
    for k in range(ARRIVALS):
        log.filter(part == k).write.mode("append").parquet(f"{out}/in")
        result = run(spark.readStream.schema(log.schema).parquet(f"{out}/in"), out)
    return result


@query("stream_replay_unordered")
def stream_replay_unordered(spark, sf):
    replay_stream = _arriving(spark, _log_keys(spark, sf), "request_id", lambda stream, out: SV.run_ttl_replay(
        stream, f"{out}/replay", f"{out}/checkpoint", delay_seconds=(LATEST_DAYS + 1) * 86_400))
    return _shown_replay(replay_stream.read())


COUNTER_KEYS = ["user_id", "event_type"]


def _streamed_counters(spark, sf) -> DataFrame:
    increments = I.table(spark, sf, "events").select("event_id", *COUNTER_KEYS, I.utc(F.col("ts")).alias("ts"))
    counters = _arriving(spark, increments, "event_id", lambda stream, out: SV.run_counters(
        stream, COUNTER_KEYS, f"{out}/counters", f"{out}/checkpoint", every=2,
        delay_seconds=(LATEST_DAYS + 1) * 86_400))
    return counters.read()


@query("stream_counters")
def stream_counters(spark, sf):
    return _streamed_counters(spark, sf).select(
        *COUNTER_KEYS, micros("session_start").alias("start_us"),
        micros("last_increment").alias("last_us"), "counter_value")


@query("stream_counter_values")
def stream_counter_values(spark, sf):
    lives = _streamed_counters(spark, sf)
    now = lives.agg(F.max(micros("last_increment"))).first()[0]
    return W.counter_values(lives, COUNTER_KEYS, F.timestamp_micros(F.lit(now)))


@query("stream_dedup")
def stream_dedup(spark, sf):
    requests = C.with_cache_key(I.document_requests(_Streams(spark), sf)) \
                .select("request_id", "ts", "cache_key")
    out = _folder(spark, "stream-dedup")
    SV.run_append(SV.distinct_requests(requests, delay="30 days").select("cache_key"),
                  f"{out}/keys", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/keys").select("cache_key")


@query("stream_upsert")
def stream_upsert(spark, sf):
    requests = C.with_cache_key(I.document_requests(_Streams(spark), sf))
    verdicts = V.validate_routed(requests).drop("content")
    out = _folder(spark, "stream-upsert")
    cache = SV.run_verdict_upsert(verdicts, f"{out}/cache", f"{out}/checkpoint")
    return cache.latest().select(
        "cache_key", "cached_at", F.col("result.status").alias("status"))


