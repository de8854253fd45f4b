"""Fixed schemas of the tables the library reads and writes."""

from __future__ import annotations

REQUEST = (
    "request_id BIGINT, ts TIMESTAMP, text STRING, file STRING, security_level STRING"
)

# What a line that is not a request is kept in.
CORRUPT = "corrupt_request"

# The fields of a verdict, as stored in a cache entry.
RESULT_FIELDS = {
    "status": "string",
    "reason": "string",
    "llm_score": "double",
    "rule_score": "double",
    "overall_score": "double",
    "error": "string",
    "analysis_summary": "string",
    "detected_issues": "array<string>",
}
RESULT = "struct<" + ",".join(f"{n}:{t}" for n, t in RESULT_FIELDS.items()) + ">"

VERDICT = {
    "status": "string",
    "reason": "string",
    "llm_score": "double",
    "rule_score": "double",
    "overall_score": "double",
    "security_level": "string",
    "error": "string",
    "analysis_summary": "string",
    "cache_hit": "boolean",
    "processing_time_ms": "double",
    "detected_issues": "array<string>",
    "cached_at": "bigint",
    "analysis_type": "string",
}

CACHE_ENTRY = {
    "cache_key": "string",
    "analysis_type": "string",
    "security_level": "string",
    "result": RESULT,
    "cached_at": "bigint",
    "expires_at": "timestamp",
}
CACHE_DDL = ", ".join(f"{n} {t}" for n, t in CACHE_ENTRY.items())

PAGE = "doc_id BIGINT, page_no INT, text STRING, has_embedded_files BOOLEAN"
MODEL_VERDICT = "key STRING, blocked BOOLEAN, llm_score DOUBLE"
