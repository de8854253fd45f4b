"""Inputs of the registered queries, derived from the given tables.

Prose hits few detectors, so attack payloads are appended to part of the documents.
All rows of a table take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions.text import string_array
from gatesift.sources.files import write_files
from gatesift.sources.tables import spread

# Texts that the rules' entries are dealt out over.
RULE_PROBES = 60


def _rule_probes() -> list[str]:
    """Every signature and every keyword, a few of different families in each text."""
    entries = [p for family in rules.FAMILIES for p in family.patterns] + list(rules.KEYWORDS)
    entries = list(dict.fromkeys(entries))
    return [" then ".join(entries[i::RULE_PROBES]) for i in range(RULE_PROBES)]


# Personal data in and just outside the patterns, and words next to keywords.
PII_PROBES = [
    "write to ann.lee@mail.example.net", "write to ann.lee at mail.example.net",
    "ring 415-555-0199 soon", "555.010.4477", "(415) 555-0123", "+14155550123",
    "number 321-54-9876", "number 9321-54-98765",
    "skillful overkill", "kill_it", "jane.roe@mail.example.org, 415-555-0188, 321-54-9877",
]
PROBES = _rule_probes() + PII_PROBES
# The texts that the users of the request log send: plain ones, a signature, a keyword, an address.
REQUEST_TEXTS = [
    "Minutes of the weekly meeting.",
    "The parcel is due on Monday.",
    f"a page with {rules.FAMILIES[1].patterns[0]} inside",
    f"what a {rules.KEYWORDS[0]} plan",
    PII_PROBES[0],
]

SHARED_TEXT_EVENTS = ["view", "click"]

# Payload i goes to the documents whose id leaves this remainder; the rest stay as is.
PROBE_STRIDE = 97
# Of the lines of requests, which are broken; and how many documents make up a file.
BROKEN_STRIDE = 11
BUNDLE = 5
LEVEL_CYCLE = ["high", "medium", "low"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose texts are to be analysed, over all cores."""
    given = table(spark, sf_dir, name).select(*columns)
    return spread(given, spark.pieces(sf_dir, name) if given.isStreaming else None)


def pick(values: list, index: Column) -> Column:
    """A constant by position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def level_of(index: Column) -> Column:
    return pick(LEVEL_CYCLE, index % 3)


def with_probe(index: str) -> Column:
    """The text, with the payload of its index at the end where there is one."""
    probe = F.col(index) % PROBE_STRIDE
    payload = F.get(F.expr(string_array(PROBES)), probe.cast("int"))
    return F.when(probe < len(PROBES), F.concat("text", F.lit(" "), payload)) \
            .otherwise(F.col("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, part of them with a payload at the end."""
    return texts(spark, sf_dir, "documents", "doc_id", "lang", "text").select(
        "doc_id", "lang", with_probe("doc_id").alias("text"))


def utc(ts: Column) -> Column:
    """A timestamp without zone as the same moment in UTC, whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz")))


def clean_base64(content: Column) -> Column:
    """Base64 without the line breaks that the built-in function inserts."""
    return F.replace(F.base64(content.cast("binary")), F.lit("\r\n"), F.lit(""))


def document_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as base64 payloads: clean, broken into lines, damaged, or not text."""
    case = F.col("doc_id") % 9
    encoded = F.col("encoded")
    with_case = corpus(spark, sf_dir).withColumn("encoded", clean_base64(F.col("text")))
    file = (
        F.when(case == 1, F.concat(F.substr(encoded, F.lit(1), F.lit(10)), F.lit("\n"),
                                   F.substr(encoded, F.lit(11))))
        .when(case == 2, F.substr(encoded, F.lit(1), F.length(encoded) - 1))
        .when(case == 3, F.concat(encoded, F.lit("\u00e9")))
        .when(case == 4, F.lit("!!!!"))
        .when(case == 5, clean_base64(F.concat(F.lit("%PDF-1.4\n"), F.col("text"))))
        .when(case == 6, clean_base64(F.concat(F.repeat(F.lit("\x01\x02"), F.lit(600)),
                                               F.col("text"))))
        .when(case == 7, F.concat(F.lit("!?"), encoded))
        .otherwise(encoded)
    )
    return with_case.select("doc_id", "text", file.alias("file"))


def mixed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests: texts, files, both, neither, blanks, odd levels."""
    levels = ["high", "medium", "low", "HIGH", None, "", "extreme"]
    shape = F.col("doc_id") % 5
    base = corpus(spark, sf_dir)
    return base.select(
        F.col("doc_id").alias("request_id"),
        F.when(shape.isin(0, 1), F.col("text")).when(shape == 2, F.lit(""))
         .when((shape == 4) & (F.col("doc_id") % 2 == 0), F.lit(" \u00a0\t"))
         .alias("text"),
        F.when(shape.isin(1, 2), clean_base64(F.col("text"))).alias("file"),
        F.get(F.array(*[F.lit(v) for v in levels]), (F.col("doc_id") % 7).cast("int"))
         .alias("security_level"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed requests as lines of JSON, some of them broken off or with a wrong kind of field."""
    requests = mixed_requests(spark, sf_dir)
    fields = F.to_json(F.struct("request_id", "text", "file", "security_level"))
    number = F.col("request_id").cast("string")
    case = F.col("request_id") % BROKEN_STRIDE
    return requests.select(
        F.when(case == 0, F.concat(F.lit('{"request_id":'), number, F.lit(',"text":"')))
         .when(case == 1, F.concat(F.lit('{"request_id":"no '), number, F.lit('","text":"x"}')))
         .otherwise(fields).alias("value"))


def document_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Files of a few documents each, a line a document, with ``bundle=<number>`` in their paths; some PDFs."""
    bundle = F.floor(F.col("doc_id") / BUNDLE)
    pdf = (F.col("doc_id") % BUNDLE == 0) & (bundle % 3 == 0)
    lines = corpus(spark, sf_dir).select(
        "doc_id", bundle.alias("bundle"),
        F.when(pdf, F.concat(F.lit("%PDF-1.4 "), F.col("text"))).otherwise(F.col("text")).alias("value"))
    write_files(lines.repartition("bundle").sortWithinPartitions("bundle", "doc_id").select("bundle", "value"), path)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as routed requests: purchases send files, all else texts.

    Views and clicks all send one text, so few keys are hot; others send one of their user's.
    """
    is_file = F.col("event_type") == "purchase"
    own = F.concat(pick(REQUEST_TEXTS, F.col("user_id") % len(REQUEST_TEXTS)),
                   F.lit(" ("), F.col("user_id").cast("string"), F.lit(")"))
    text = F.when(F.col("event_type").isin(SHARED_TEXT_EVENTS), F.lit(REQUEST_TEXTS[0])).otherwise(own)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        utc(F.col("ts")).alias("ts"),
        F.when(is_file, F.lit("file")).otherwise(F.lit("text")).alias("analysis_type"),
        level_of(F.col("user_id")).alias("security_level"),
        F.when(is_file, clean_base64(text)).otherwise(text).alias("content"),
        F.col("value").alias("latency_ms"))


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as routed text requests, one second apart; copies stay copies."""
    return texts(spark, sf_dir, "documents", "doc_id", "n_chars", "text").select(
        F.col("doc_id").alias("request_id"),
        F.timestamp_micros(F.lit(START_US) + F.col("doc_id") * 1_000_000).alias("ts"),
        F.lit("text").alias("analysis_type"),
        level_of(F.col("n_chars")).alias("security_level"),
        with_probe("n_chars").alias("content"))


# 2024-01-01 00:00:00 UTC
START_US = 1_704_067_200_000_000
