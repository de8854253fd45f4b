"""Request checks: which content is analysed, or why a request is rejected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions.text import quote

_LEVELS = "(" + ", ".join(quote(name) for name in rules.LEVELS) + ")"


def present_sql(value: str) -> str:
    """True unless NULL or empty; white space counts as present."""
    return f"coalesce({value} <> '', false)"


def resolve_level_sql(level: str, default: str = rules.DEFAULT_LEVEL,
                      strict: bool = True) -> str:
    chosen = f"coalesce(nullif({level}, ''), {quote(default)})"
    if strict:
        return chosen
    return (f"CASE WHEN lower({chosen}) IN {_LEVELS} THEN lower({chosen}) "
            f"ELSE {quote(rules.DEFAULT_LEVEL)} END")


def resolve_level(level: str, default: str = rules.DEFAULT_LEVEL,
                  strict: bool = True) -> Column:
    """The level a request asks for, or the default.

    Strict keeps unknown levels as they are, for the request check to reject.
    Lenient ignores case and turns unknown levels into ``high``.
    """
    return F.expr(resolve_level_sql(level, default, strict))


def service_sql(text: str, file: str, level: str,
                default: str = rules.DEFAULT_LEVEL) -> dict[str, str]:
    """Routing of the service: level, then ambiguity, then presence."""
    resolved = resolve_level_sql(level, default)
    has_text, has_file = present_sql(text), present_sql(file)
    error = (f"CASE WHEN {resolved} NOT IN {_LEVELS} THEN {quote(rules.BAD_LEVEL_ERROR)} "
             f"WHEN {has_text} AND {has_file} THEN {quote(rules.AMBIGUOUS_ERROR)} "
             f"WHEN NOT {has_text} AND NOT {has_file} THEN {quote(rules.MISSING_ERROR)} END")
    return {"security_level": resolved, "request_error": error}


def gateway_sql(text: str, file: str, level: str) -> dict[str, str]:
    """Checks of the gateway: presence, then level; both contents at once pass.

    The level defaults when it is missing. An empty one is present, and unknown.
    """
    resolved = f"coalesce({level}, {quote(rules.DEFAULT_LEVEL)})"
    error = (f"CASE WHEN NOT {present_sql(text)} AND NOT {present_sql(file)} "
             f"THEN {quote(rules.MISSING_ERROR)} "
             f"WHEN {resolved} NOT IN {_LEVELS} THEN {quote(rules.GATEWAY_LEVEL_ERROR)} END")
    return {"security_level": resolved, "request_error": error}


def content_sql(text: str, file: str, error: str) -> dict[str, str]:
    """What an accepted request has analysed; a text comes before a file."""
    return {
        "analysis_type": f"CASE WHEN {error} IS NULL THEN "
                         f"CASE WHEN {present_sql(text)} THEN 'text' ELSE 'file' END END",
        "content": f"CASE WHEN {error} IS NULL THEN "
                   f"CASE WHEN {present_sql(text)} THEN {text} ELSE {file} END END",
    }
