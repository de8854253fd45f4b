"""Verdicts for texts, file payloads and mixed requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions import payload as P
from gatesift.functions import routing as R
from gatesift.functions import scoring as S
from gatesift.functions import text as T
from gatesift.functions.detectors import scan
from gatesift.functions.text import has_content_sql
from gatesift.operators.analyze import (
    Expression,
    analyze,
    as_column,
    text_analysis_sql,
    text_issues_sql,
)
from gatesift.schemas import CORRUPT, RESULT_FIELDS


def _level(level: str | Column) -> Column:
    return level if isinstance(level, Column) else F.lit(level)


def _verdicts(df: DataFrame, content: str, is_file: str, level: Column, *,
              llm_score: Expression | None = None, blocked: Expression | None = None,
              pdf_text: Expression | None = None, embedded: Expression | None = None,
              decode_unread_pdf: bool = True, error: Expression | None = None,
              threshold: float | Column = rules.FILE_THRESHOLD,
              max_bytes: int = rules.MAX_BYTES,
              keywords: Sequence[str] = rules.KEYWORDS, skip: str = "false") -> DataFrame:
    """Add the result fields. Guards come first and replace the analysis.

    ``is_file`` and ``skip`` are SQL conditions; skipped rows get NULL results.
    """
    kept = df.columns
    given = F.lit(None) if error is None else as_column(error)
    staged = df.withColumns({"_gs_level": level, "_gs_error": given.cast("string")})
    staged = P.with_decoded_base64(staged, f"CASE WHEN {is_file} THEN {content} END", "_gs_bytes")
    too_large = P.too_large_sql("_gs_bytes", max_bytes)
    staged = P.with_file_kind(staged, "_gs_bytes", "_gs_kind",
                              f"{is_file} AND NOT {too_large}")
    staged = staged.selectExpr("*", (
        f"CASE WHEN {skip} THEN 'rejected' "
        "WHEN _gs_error IS NOT NULL THEN 'validation_error' "
        f"WHEN NOT {is_file} AND NOT {has_content_sql(content)} THEN 'empty_input' "
        f"WHEN {is_file} AND _gs_bytes IS NULL THEN 'invalid_base64' "
        f"WHEN {is_file} AND {too_large} THEN 'file_too_large' "
        f"WHEN {is_file} AND _gs_kind IS NULL THEN 'unsupported_file_type' END AS _gs_guard"))

    decoded = P.decode_leniently_sql("_gs_bytes")
    as_pdf = f"_gs_kind = 'pdf' AND {str(not decode_unread_pdf).lower()}"
    if pdf_text is not None:
        staged = staged.withColumn("_gs_pages", as_column(pdf_text))
        decoded = (f"CASE WHEN _gs_kind = 'pdf' AND _gs_pages IS NOT NULL THEN _gs_pages "
                   f"WHEN NOT ({as_pdf}) THEN {decoded} END")
        as_pdf = f"({as_pdf}) OR (_gs_kind = 'pdf' AND _gs_pages IS NOT NULL)"
    elif not decode_unread_pdf:
        decoded = f"CASE WHEN NOT ({as_pdf}) THEN {decoded} END"
    staged = staged.selectExpr(
        "*",
        f"CASE WHEN _gs_guard IS NULL THEN CASE WHEN {is_file} THEN {decoded} "
        f"ELSE {content} END END AS _gs_text",
        f"({as_pdf}) AS _gs_as_pdf")
    staged = analyze(staged, "_gs_text", is_file,
                     is_pdf=None if is_file == "false" else "_gs_as_pdf",
                     embedded=embedded, llm_score=llm_score, blocked=blocked,
                     threshold=threshold, max_bytes=max_bytes, keywords=keywords,
                     output="_gs_analysis")

    return _guarded(staged, kept)


def _guarded(staged: DataFrame, kept: list[str]) -> DataFrame:
    """The result fields of ``_gs_analysis`` under ``_gs_level``, or of what ``_gs_guard`` found."""
    analysed = "_gs_guard IS NULL"
    result = S.verdict_sql("_gs_analysis", "_gs_level")
    guarded = {name: f"CASE WHEN {analysed} THEN {sql} END" for name, sql in result.items()}
    guarded["status"] = (
        f"CASE WHEN {analysed} THEN {result['status']} WHEN _gs_guard = 'rejected' THEN NULL "
        "WHEN _gs_guard IN ('validation_error', 'unsupported_file_type') THEN 'error' "
        "ELSE 'unsafe' END")
    guarded["reason"] = (
        f"CASE WHEN {analysed} THEN {result['reason']} "
        "WHEN _gs_guard <> 'rejected' THEN _gs_guard END")
    guarded["overall_score"] = (
        f"CASE WHEN {analysed} THEN {result['overall_score']} "
        "WHEN _gs_guard NOT IN ('rejected', 'validation_error') THEN 0.0D END")
    guarded["error"] = "CASE WHEN _gs_guard = 'validation_error' THEN _gs_error END"
    return staged.select(*[c for c in kept if c not in RESULT_FIELDS], *[
        F.expr(f"cast({guarded[name]} AS {kind})").alias(name)
        for name, kind in RESULT_FIELDS.items()])


def validate_text(df: DataFrame, text: str = "text",
                  level: str | Column = rules.DEFAULT_LEVEL, *,
                  llm_score: Expression | None = None, blocked: Expression | None = None,
                  error: Expression | None = None,
                  keywords: Sequence[str] = rules.KEYWORDS) -> DataFrame:
    """Add a verdict for each text. A non-NULL ``error`` makes it an error verdict."""
    return _verdicts(df, text, "false", _level(level), llm_score=llm_score, blocked=blocked,
                     error=error, keywords=keywords)


def text_findings(df: DataFrame, text: str = "text", *,
                  keywords: Sequence[str] = rules.KEYWORDS, output: str = "findings") -> DataFrame:
    """What a verdict needs to know of each text, in place of the text.

    For verdicts that also take a model's score from another table: the texts are read in one
    pass, the narrow findings are joined, and :func:`decide` makes the verdicts.
    """
    found, names = scan(df.withColumn("_gs_filled", F.expr(has_content_sql(text))), text, "false", keywords)
    return found.select(*[c for c in df.columns if c != text], F.struct(
        F.col("_gs_filled").alias("has_content"), F.col(names.injection).alias("injection"),
        F.col(names.keyword).alias("keyword")).alias(output))


def decide(df: DataFrame, level: str | Column = rules.DEFAULT_LEVEL, *,
           llm_score: Expression | None = None, blocked: Expression | None = None,
           error: Expression | None = None, findings: str = "findings") -> DataFrame:
    """Verdicts from :func:`text_findings`, the same as :func:`validate_text` gives for the texts."""
    kept = [c for c in df.columns if c != findings]
    given = F.lit(None) if error is None else as_column(error)
    model = F.lit(1.0) if llm_score is None else F.coalesce(as_column(llm_score).cast("double"), F.lit(1.0))
    flagged = F.lit(False) if blocked is None else F.coalesce(as_column(blocked), F.lit(False))
    staged = df.withColumns({"_gs_level": _level(level), "_gs_error": given.cast("string"),
                             "_gs_model": model, "_gs_blocked": flagged})
    staged = staged.selectExpr(
        "*", f"{text_issues_sql(f'{findings}.injection', f'{findings}.keyword', '_gs_blocked')} AS _gs_issues",
        "CASE WHEN _gs_error IS NOT NULL THEN 'validation_error' "
        f"WHEN NOT {findings}.has_content THEN 'empty_input' END AS _gs_guard")
    staged = staged.selectExpr("*", f"{text_analysis_sql('_gs_issues', '_gs_model', '_gs_blocked')} AS _gs_analysis")
    return _guarded(staged, kept)


def validate_file(df: DataFrame, file: str = "file",
                  level: str | Column = rules.DEFAULT_LEVEL, **options) -> DataFrame:
    """Add a verdict for each base64 payload.

    Options: ``pdf_text`` is the extracted text of PDF payloads (see
    :func:`gatesift.sources.pages.assemble_pages`) and ``embedded`` their embedded-file
    flag. A PDF without text is decoded as text, or with ``decode_unread_pdf=False``
    reported as corrupted. ``error``, ``threshold`` and ``max_bytes`` as elsewhere.
    """
    return _verdicts(df, file, "true", _level(level), **options)


def route_requests(df: DataFrame, policy: str = "service",
                   default_level: str = rules.DEFAULT_LEVEL) -> DataFrame:
    """Add ``security_level``, ``request_error``, ``analysis_type`` and ``content``.

    Rejected requests stay in as rows with a ``request_error``, those among them that were no
    request at all (:func:`gatesift.sources.requests.read_requests`) with the line as it came.
    """
    if policy == "service":
        checks = R.service_sql("text", "file", "security_level", default_level)
    elif policy == "gateway":
        checks = R.gateway_sql("text", "file", "security_level")
    else:
        raise ValueError(f"unknown policy {policy!r}")
    if CORRUPT in df.columns:
        malformed = f"{CORRUPT} IS NOT NULL"
        checks = {"security_level": f"CASE WHEN NOT ({malformed}) THEN {checks['security_level']} END",
                  "request_error": f"CASE WHEN {malformed} THEN {T.quote(rules.MALFORMED_ERROR)} "
                                   f"ELSE {checks['request_error']} END"}
    checked = df.withColumns({name: F.expr(sql) for name, sql in checks.items()})
    routed = R.content_sql("text", "file", "request_error")
    return checked.withColumns({name: F.expr(sql) for name, sql in routed.items()})


def validate_routed(df: DataFrame, *, fixed_level: str | None = None, **options) -> DataFrame:
    """Verdicts for rows with ``analysis_type``, ``content`` and ``security_level``.

    Both profiles run in one pass over the rows. Rows without a type (rejected
    requests) keep NULL verdicts. ``fixed_level`` scores every row under one level,
    as a service with one global level does; ``security_level`` is still echoed.
    Options are those of :func:`validate_text` and :func:`validate_file`.
    """
    level = F.col("security_level") if fixed_level is None else F.lit(fixed_level)
    return _verdicts(df, "content", "coalesce(analysis_type = 'file', false)", level,
                     skip="analysis_type IS NULL", **options)


def validate_requests(df: DataFrame, policy: str = "service",
                      default_level: str = rules.DEFAULT_LEVEL, **options) -> DataFrame:
    """Route requests and validate them; see :func:`validate_routed` for options."""
    return validate_routed(route_requests(df, policy, default_level), **options)


def risk_findings(df: DataFrame, text: str = "text") -> DataFrame:
    """The rule issues of each text, ``risk_issues``, in place of the text."""
    issues = S.risk_parts_sql(text, "''", "0.0D")["risk_issues"]
    return T.barrier(df, [c for c in df.columns if c != text], {"risk_issues": issues})


def risk_verdicts(df: DataFrame, level: Column, toxicity: Expression,
                  threshold: float = rules.RISK_THRESHOLD) -> DataFrame:
    """Add the verdict of the rule-density risk score to :func:`risk_findings`."""
    staged = df.withColumns({"_gs_level": level, "_gs_toxic": as_column(toxicity)})
    model = S.risk_model_sql("_gs_level", "_gs_toxic")
    staged = staged.selectExpr("*", f"{model} AS risk_model", f"{S.risk_rule_sql('risk_issues')} AS _gs_rule")
    verdict = S.risk_verdict_sql("risk_issues", "_gs_rule", "risk_model", "_gs_level", threshold)
    return staged.select(*df.columns, *[F.expr(sql).alias(name) for name, sql in verdict.items()])


def risk_scores(df: DataFrame, text: str, level: Column, toxicity: Expression,
                threshold: float = rules.RISK_THRESHOLD) -> DataFrame:
    """Add the verdict of the rule-density risk score."""
    staged = df.withColumns({"_gs_level": level, "_gs_toxic": as_column(toxicity)})
    parts = S.risk_parts_sql(text, "_gs_level", "_gs_toxic")
    staged = staged.selectExpr("*", *[f"{sql} AS {name}" for name, sql in parts.items()])
    staged = staged.selectExpr("*", f"{S.risk_rule_sql('risk_issues')} AS _gs_rule")
    verdict = S.risk_verdict_sql("risk_issues", "_gs_rule", "risk_model", "_gs_level", threshold)
    return staged.select(*df.columns, "risk_issues",
                         *[F.expr(sql).alias(name) for name, sql in verdict.items()])


