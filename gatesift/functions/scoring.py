"""Analysis structs, level weights and verdicts, as Spark SQL expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions.text import contains_any_sql, quote


def _double(value: float) -> str:
    return f"{value!r}D"


def _by_level(level: str, values: dict[str, str]) -> str:
    """A level-dependent value as a CASE, so that no join is needed."""
    cases = " ".join(f"WHEN {quote(name)} THEN {sql}" for name, sql in values.items())
    return f"CASE {level} {cases} END"


def analysis_sql(is_safe: str, confidence: str, issues: str, summary: str) -> str:
    return (f"named_struct('is_safe', {is_safe}, 'confidence_score', "
            f"cast({confidence} AS double), 'detected_issues', {issues}, "
            f"'analysis_summary', {summary})")


def text_confidence_sql(issues: str, llm_score: str) -> str:
    """The model score of an issue-free text, else 0.0."""
    return f"CASE WHEN size({issues}) = 0 THEN {llm_score} ELSE 0.0D END"


def file_safety_score_sql(malicious: str, pii: str) -> str:
    """1.0 less a fixed penalty per kind of issue present."""
    return (f"(1.0D - CASE WHEN size({malicious}) > 0 "
            f"THEN {_double(rules.MALICIOUS_PENALTY)} ELSE 0.0D END"
            f" - CASE WHEN size({pii}) > 0 THEN {_double(rules.PII_PENALTY)} ELSE 0.0D END)")


def file_safety_score(malicious: str, pii: str) -> Column:
    return F.expr(file_safety_score_sql(malicious, pii))


def shown_issues_sql(issues: str) -> str:
    """Issue names as shown to callers; only the keyword issue is renamed."""
    return (f"transform({issues}, i -> CASE WHEN i = {quote(rules.KEYWORD_ISSUE)} "
            f"THEN {quote(rules.KEYWORD_ISSUE_SHOWN)} ELSE i END)")


def model_score_sql(confidence: str, level: str) -> str:
    """The score a level takes from the analysis: all but ``high`` ignore it."""
    return _by_level(level, {
        name: confidence if lv.deep_analysis else "1.0D" for name, lv in rules.LEVELS.items()})


def overall_score_sql(rule_score: str, llm_score: str, level: str) -> str:
    """Weighted score of an issue-free record."""
    def weighted(lv: rules.Level) -> str:
        rule_part = f"({rule_score} * {_double(lv.rule_weight)})"
        if lv.llm_weight == 0.0:
            return rule_part
        return f"{rule_part} + ({llm_score} * {_double(lv.llm_weight)})"

    return _by_level(level, {name: weighted(lv) for name, lv in rules.LEVELS.items()})


def level_threshold_sql(level: str) -> str:
    return _by_level(level, {n: _double(lv.threshold) for n, lv in rules.LEVELS.items()})


def verdict_sql(result: str, level: str) -> dict[str, str]:
    """Verdict columns of an analysis struct under a level."""
    issues = f"{result}.detected_issues"
    flagged = f"size({issues}) > 0"
    llm = model_score_sql(f"{result}.confidence_score", level)
    overall = (f"CASE WHEN {flagged} THEN 0.0D "
               f"ELSE {overall_score_sql('1.0D', llm, level)} END")
    passed = f"NOT ({flagged}) AND ({overall}) >= {level_threshold_sql(level)}"
    return {
        "status": f"CASE WHEN {passed} THEN 'safe' ELSE 'unsafe' END",
        "reason": f"CASE WHEN {flagged} THEN array_join({issues}, ', ') "
                  f"WHEN {passed} THEN 'safe' ELSE 'unspecified_issue' END",
        "llm_score": llm,
        "rule_score": f"CASE WHEN {flagged} THEN 0.0D ELSE 1.0D END",
        "overall_score": overall,
        "analysis_summary": f"{result}.analysis_summary",
        "detected_issues": shown_issues_sql(issues),
    }


def verdict_columns(result: str, level: str) -> dict[str, Column]:
    return {name: F.expr(sql) for name, sql in verdict_sql(result, level).items()}


def display_error(status: str, reason: str) -> Column:
    """The sentence shown for an ``error`` verdict, NULL for all others."""
    cases = " ".join(f"WHEN {reason} = {quote(code)} THEN {quote(sentence)}"
                     for code, sentence in rules.DISPLAY_ERRORS.items())
    unknown = quote(rules.UNKNOWN_ERROR_DISPLAY)
    return F.expr(f"CASE WHEN {status} = 'error' THEN CASE WHEN coalesce({reason}, '') = '' "
                  f"THEN {unknown} {cases} ELSE {reason} END END")


def _java(pattern: str) -> str:
    """A risk pattern in the regex dialect of Spark, with Unicode classes and case."""
    return (pattern.replace("(?i)", "(?iu)")
            .replace(r"\w", r"[\p{L}\p{N}_]")
            .replace(r"\s", r"[\s\p{Z}\x1C-\x1F\x85]"))


def risk_parts_sql(text: str, level: str, toxicity: str) -> dict[str, str]:
    """The parts of the rule-density risk score: issues, rule score, model score."""
    # Words are searched for in the lower-cased text, which is exact but for letters that
    # equal an ASCII letter in case-insensitive matching only; texts with such letters,
    # and no others, need the regular expression.
    words = re.search(r"\((.*)\)", rules.RISK_SQL_REGEX.replace("(?i)", ""))[1].split("|")
    folds = "[\u0130\u0131\u017f\u212a]"
    sql = (f"({contains_any_sql(f'lower({text})', words)} OR ({text} RLIKE {quote(folds)} "
           f"AND {text} RLIKE {quote(_java(rules.RISK_SQL_REGEX))}))")
    # each alternative of the last pattern has one of these characters
    xss = f"({text} RLIKE '[=<:]' AND {text} RLIKE {quote(_java(rules.RISK_XSS_REGEX))})"
    checks = [
        (f"{text} RLIKE {quote(rules.RISK_CHARACTERS_REGEX)}", rules.RISK_CHARACTERS_ISSUE),
        (sql, rules.RISK_SQL_ISSUE),
        (xss, rules.RISK_XSS_ISSUE),
    ]
    found = ", ".join(f"CASE WHEN {hit} THEN {quote(issue)} END" for hit, issue in checks)
    return {
        "risk_issues": f"array_compact(array({found}))",
        "risk_model": risk_model_sql(level, toxicity),
    }


def risk_model_sql(level: str, toxicity: str) -> str:
    """The model's part of the risk score: level ``low`` ignores it."""
    return f"CASE WHEN {level} IN ('high', 'medium') THEN coalesce({toxicity}, 0.0D) ELSE 0.0D END"


def risk_rule_sql(issues: str) -> str:
    # the score grows one step per issue: the sum of three steps is not 0.9 exactly
    totals = [0.0]
    for _ in range(3):
        totals.append(totals[-1] + rules.RISK_STEP)
    return f"element_at(array({', '.join(_double(t) for t in totals)}), size({issues}) + 1)"


def risk_verdict_sql(issues: str, rule: str, model: str, level: str,
                     threshold: float = rules.RISK_THRESHOLD) -> dict[str, str]:
    """The rule-density verdict: higher is worse, safe below the threshold."""
    def weighted(weights: tuple[float, float]) -> str:
        if weights[1] == 0.0:
            return rule
        return f"({rule} * {_double(weights[0])}) + ({model} * {_double(weights[1])})"

    cases = _by_level(level, {n: weighted(w) for n, w in rules.RISK_WEIGHTS.items()})
    overall = f"coalesce({cases}, {rule})"
    safe = f"{overall} < {_double(threshold)}"
    return {
        "status": f"CASE WHEN {safe} THEN 'safe' ELSE 'unsafe' END",
        "reason": f"CASE WHEN {safe} THEN 'safe' WHEN size({issues}) > 0 "
                  f"THEN array_join({issues}, ', ') ELSE {quote(rules.RISK_OTHER_REASON)} END",
        "rule_score": f"least(1.0D, {rule})",
        "llm_score": model,
        "overall_score": f"least(1.0D, {overall})",
    }
