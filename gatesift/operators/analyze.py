"""Analysis of texts, files and paged documents.

Each operator is a chain of projections: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions import scoring as S
from gatesift.functions.detectors import scan
from gatesift.functions.text import NO_STRINGS, quote

# A column given by its name, as a SQL expression or as a Column.
Expression = str | Column


def as_column(value: Expression) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def analyze(df: DataFrame, text: str, is_file: str, *,
            is_pdf: Expression | None = None,
            embedded: Expression | None = None,
            llm_score: Expression | None = None,
            blocked: Expression | None = None,
            threshold: float | Column = rules.FILE_THRESHOLD,
            max_bytes: int = rules.MAX_BYTES,
            keywords: Sequence[str] = rules.KEYWORDS,
            output: str = "analysis") -> DataFrame:
    """Add an analysis struct; ``is_file`` is a SQL condition that picks the profile.

    A NULL text is an unreadable document in the file profile. In the text profile,
    ``blocked`` is the model verdict and ``llm_score`` its score, 1.0 where missing.
    """
    kept = df.columns
    # options become columns; those not given stay literals, so Catalyst folds them away
    given = {"_gs_pdf": is_pdf, "_gs_embedded": embedded, "_gs_blocked": blocked}
    options = {name: F.coalesce(as_column(value), F.lit(False))
               for name, value in given.items() if value is not None}
    if llm_score is not None:
        options["_gs_model"] = F.coalesce(as_column(llm_score).cast("double"), F.lit(1.0))
    if isinstance(threshold, Column):
        options["_gs_limit"] = threshold
    pdf, with_files, flagged = (name if name in options else "false" for name in given)
    model = "_gs_model" if "_gs_model" in options else "1.0D"
    limit = "_gs_limit" if "_gs_limit" in options else f"{threshold!r}D"

    staged = df.withColumns(options) if options else df
    # an oversized text gets its verdict from its size alone
    staged = staged.selectExpr(
        "*", f"{is_file} AND coalesce(octet_length({text}) > {max_bytes}, false) AS _gs_oversize")
    staged = staged.selectExpr(
        "*", f"CASE WHEN _gs_oversize THEN '' ELSE {text} END AS _gs_scanned")
    staged, found = scan(staged, "_gs_scanned", is_file, keywords)

    staged = staged.selectExpr("*", (
        f"CASE WHEN _gs_oversize OR {text} IS NULL THEN 0.0D "
        f"ELSE {S.file_safety_score_sql(found.injection, found.pii)} END AS _gs_first"))
    passed = f"_gs_first >= {limit}"
    penalised = f"({pdf} AND {with_files} AND {passed})"
    file_issues = (
        f"CASE WHEN {text} IS NULL THEN array({quote(rules.BAD_PDF_ISSUE)}) "
        f"WHEN _gs_oversize THEN array({quote(rules.OVERSIZE_ISSUE)}) "
        f"ELSE concat({found.pii}, {found.injection}, CASE WHEN {penalised} "
        f"THEN array({quote(rules.EMBEDDED_ISSUE)}) ELSE {NO_STRINGS} END) END")
    text_issues = text_issues_sql(found.injection, found.keyword, flagged)
    staged = staged.selectExpr(
        "*",
        f"CASE WHEN {is_file} THEN {file_issues} ELSE {text_issues} END AS _gs_issues",
        f"CASE WHEN {penalised} THEN _gs_first * {rules.EMBEDDED_FACTOR}D ELSE _gs_first END "
        "AS _gs_score")

    summary = (
        f"CASE WHEN NOT {is_file} THEN {quote(rules.TEXT_SUMMARY)} "
        f"WHEN {text} IS NULL THEN '' "
        f"WHEN {pdf} AND {passed} THEN {quote(rules.PDF_SAFE_SUMMARY)} "
        f"WHEN {pdf} THEN {quote(rules.PDF_UNSAFE_SUMMARY)} "
        f"WHEN _gs_oversize THEN {quote(rules.OVERSIZE_SUMMARY)} "
        f"WHEN {passed} THEN {quote(rules.FILE_TEXT_SAFE_SUMMARY)} "
        f"ELSE {quote(rules.FILE_TEXT_UNSAFE_SUMMARY)} END")
    model = f"CASE WHEN {flagged} THEN 0.0D ELSE {model} END"
    result = S.analysis_sql(
        f"CASE WHEN {is_file} THEN {text} IS NOT NULL AND _gs_score >= {limit} "
        "ELSE size(_gs_issues) = 0 END",
        f"CASE WHEN {is_file} THEN _gs_score "
        f"ELSE {S.text_confidence_sql('_gs_issues', model)} END",
        "_gs_issues",
        summary)
    return staged.select(*kept, F.expr(result).alias(output))


def text_issues_sql(injection: str, keyword: str, blocked: str) -> str:
    """Issues of the text profile: injections, a keyword, the model verdict."""
    return (f"concat({injection}, CASE WHEN {keyword} "
            f"THEN array({quote(rules.KEYWORD_ISSUE)}) ELSE {NO_STRINGS} END, "
            f"CASE WHEN {blocked} THEN array({quote(rules.MODEL_ISSUE)}) ELSE {NO_STRINGS} END)")


def text_analysis_sql(issues: str, llm_score: str, blocked: str) -> str:
    """The analysis struct of the text profile."""
    model = f"CASE WHEN {blocked} THEN 0.0D ELSE {llm_score} END"
    return S.analysis_sql(f"size({issues}) = 0", S.text_confidence_sql(issues, model), issues,
                          quote(rules.TEXT_SUMMARY))


def analyze_text(df: DataFrame, text: str = "text", *, llm_score: Expression | None = None,
                 blocked: Expression | None = None, keywords: Sequence[str] = rules.KEYWORDS,
                 output: str = "analysis") -> DataFrame:
    """Text profile: injection signatures, harmful keywords, model verdict."""
    return analyze(df, text, "false", llm_score=llm_score, blocked=blocked,
                   keywords=keywords, output=output)


def analyze_file_text(df: DataFrame, text: str = "text", *,
                      threshold: float | Column = rules.FILE_THRESHOLD,
                      max_bytes: int = rules.MAX_BYTES, output: str = "analysis") -> DataFrame:
    """File profile: PII, injection signatures, safety score."""
    return analyze(df, text, "true", threshold=threshold, max_bytes=max_bytes, output=output)


def analyze_pdf_text(df: DataFrame, text: str = "text",
                     embedded: str | None = "has_embedded_files", *,
                     threshold: float | Column = rules.FILE_THRESHOLD,
                     max_bytes: int = rules.MAX_BYTES, output: str = "analysis") -> DataFrame:
    """File profile over extracted text, with the embedded-file penalty."""
    return analyze(df, text, "true", is_pdf="true", embedded=embedded, threshold=threshold,
                   max_bytes=max_bytes, output=output)


def oversize_analysis_sql(summary: str) -> str:
    """The analysis of content that is known by its size only."""
    return S.analysis_sql("false", "0.0D", f"array({quote(rules.OVERSIZE_ISSUE)})",
                          quote(summary))


def unavailable_analysis() -> Column:
    """The analysis of a file where no file analyser is deployed."""
    return F.expr(S.analysis_sql(
        "false", "0.0D", f"array({quote(rules.FILE_UNAVAILABLE_ISSUE)})",
        quote(rules.FILE_UNAVAILABLE_SUMMARY)))


def failed_analysis(error: str) -> Column:
    """The analysis of a file that could not be read; the error is its summary."""
    return F.expr(S.analysis_sql(
        "false", "0.0D", f"array({quote(rules.FILE_ERROR_ISSUE)})", error))


def with_content_safety(df: DataFrame, text: str = "text", profile: str = "text",
                        threshold: float = 0.8, *, llm_score: Expression | None = None,
                        blocked: Expression | None = None,
                        output: str = "is_content_safe") -> DataFrame:
    """Add "safe, and confident enough"; use it as ``filter("is_content_safe")``."""
    if profile == "text":
        staged = analyze_text(df, text, llm_score=llm_score, blocked=blocked,
                              output="_gs_analysis")
    elif profile == "file":
        staged = analyze_file_text(df, text, output="_gs_analysis")
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return staged.select(*df.columns, F.expr(
        f"_gs_analysis.is_safe AND _gs_analysis.confidence_score >= {threshold!r}D")
        .alias(output))
