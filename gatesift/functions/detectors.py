"""Detectors: injection signatures, harmful keywords and PII.

The Column functions work on any string column or SQL expression. :func:`scan` does
the same for a whole DataFrame in stages, so that the lower-cased text and the anchor
flags are computed once per row and shared by all families.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions import text as T

# Boundaries, digits and white space of the PII patterns are ASCII; \b is spelled
# out because the engine's own notion of a word differs between Java versions.
_ASCII_WORD = "[A-Za-z0-9_]"
_ASCII_BOUNDARY = f"(?:(?<={_ASCII_WORD})(?!{_ASCII_WORD})|(?<!{_ASCII_WORD})(?={_ASCII_WORD}))"
# An address is there if one with a single character before the sign is; runs of such characters cost their square.
_EMAIL_ENOUGH = rules.EMAIL_REGEX.replace("]+@", "]@", 1)
# Every phone number ends like this; a cheap test before the full pattern.
_PHONE_TAIL = r"[0-9]{3}[\s\-.][0-9]{4}"
# What a phone number begins with: looked for first, boundaries cost far more at every character.
_PHONE_HEAD = "(?=[0-9(+])"
# A social security number without its boundaries; a cheap test before the full pattern.
_SSN_DIGITS = "[0-9]{3}-[0-9]{2}-[0-9]{4}"


def _ascii_regex(pattern: str) -> str:
    return pattern.replace(r"\b", _ASCII_BOUNDARY).replace(r"\d", "[0-9]")


def one_issue_sql(hit: str, message: str) -> str:
    return f"CASE WHEN {hit} THEN array({T.quote(message)}) ELSE {T.NO_STRINGS} END"


def every_issue_sql(target: str, family: rules.Family, hit: str | None = None) -> str:
    """One issue per matching signature; the list is walked only if one matches."""
    hit = hit or T.contains_any_sql(target, family.patterns)
    issues = (f"transform({T.matching_sql(target, family.patterns)}, "
              f"p -> concat({T.quote(family.message)}, p))")
    return f"CASE WHEN {hit} THEN {issues} ELSE {T.NO_STRINGS} END"


def family_sql(text: str, name: str, profile: str) -> str:
    family = rules.families(profile)[name]
    target = text if family.raw else T.fold_sql(text, profile)
    if family.every:
        return every_issue_sql(target, family)
    return one_issue_sql(T.contains_any_sql(target, family.patterns), family.message)


def detect_family(text: str, name: str, profile: str = "text") -> Column:
    """Issues of one signature family as ``array<string>``."""
    return F.expr(family_sql(text, name, profile))


def detect_code_injection(text: str, profile: str = "text") -> Column:
    """Issues of all ten signature families in report order."""
    parts = [family_sql(text, name, profile) for name in rules.families(profile)]
    return F.expr(f"concat({', '.join(parts)})")


def has_harmful_keyword(text: str, keywords: Sequence[str] = rules.KEYWORDS) -> Column:
    """True if a dictionary keyword occurs as a whole word, ignoring case."""
    found = T.contains_keyword_sql(T.unicode_lower_sql(text), keywords)
    return F.expr(f"coalesce({found}, false)")


def email_sql(text: str) -> str:
    return f"(contains({text}, '@') AND {text} RLIKE {T.quote(_EMAIL_ENOUGH)})"


def phone_sql(text: str) -> str:
    return (f"({text} RLIKE {T.quote(_PHONE_TAIL)} "
            f"AND {text} RLIKE {T.quote(f'{_PHONE_HEAD}(?:{_ascii_regex(rules.PHONE_REGEX)})')})")


def ssn_sql(text: str) -> str:
    return (f"(contains({text}, '-') AND {text} RLIKE {T.quote(_SSN_DIGITS)} "
            f"AND {text} RLIKE {T.quote(_ascii_regex(rules.SSN_REGEX))})")


def has_email(text: str) -> Column:
    return F.expr(email_sql(text))


def has_phone(text: str) -> Column:
    return F.expr(phone_sql(text))


def has_ssn(text: str) -> Column:
    return F.expr(ssn_sql(text))


def pii_sql(email: str, phone: str, ssn: str) -> str:
    """PII issues of three conditions, led by a general one if any holds."""
    return "concat(" + ", ".join([
        one_issue_sql(f"{email} OR {phone} OR {ssn}", rules.PII_ISSUE),
        one_issue_sql(email, rules.EMAIL_ISSUE),
        one_issue_sql(phone, rules.PHONE_ISSUE),
        one_issue_sql(ssn, rules.SSN_ISSUE),
    ]) + ")"


def detect_pii(text: str) -> Column:
    """PII issues, led by a general one if there are any."""
    return F.expr(pii_sql(email_sql(text), phone_sql(text), ssn_sql(text)))


@dataclass(frozen=True)
class Findings:
    """Names of the columns that :func:`scan` adds."""

    injection: str = "_gs_injection"
    pii: str = "_gs_pii"
    keyword: str = "_gs_keyword"


@dataclass(frozen=True)
class Staged:
    """A DataFrame with the lower-cased text, anchor flags and family hits as columns."""

    df: DataFrame
    folded: str
    raw: str
    flags: dict[str, str]

    def hit(self, family: str) -> str:
        return f"_gs_f_{family}"

    def target(self, family: rules.Family) -> str:
        return self.raw if family.raw else self.folded


def stage(df: DataFrame, text: str, is_file: str, keywords: Sequence[str] = ()) -> Staged:
    """Add the columns that all detectors share.

    One projection per step: an expression that later steps use several times stays in
    its own projection and is computed once per row. ``is_file`` is a SQL condition.
    """
    by_name = rules.families("text")
    common = rules.families("file")
    extra = [p for p in by_name["nosql"].patterns if p in rules.TEXT_ONLY_SIGNATURES]
    searched = [p for f in by_name.values() for p in f.patterns] + T.split_keywords(keywords)[1]
    marks = T.anchors_of(searched)
    # lower-casing neither adds nor removes punctuation: the flags hold for both texts
    flags = {mark: f"_gs_a{ord(mark)}" for mark in marks}
    folded = "_gs_lower"

    staged = df.withColumn(folded, F.expr(
        f"CASE WHEN {is_file} THEN {T.ascii_lower_sql(text)} "
        f"ELSE {T.unicode_lower_sql(text)} END"))
    staged = staged.withColumn(
        "_gs_rare", F.expr(f"{folded} RLIKE {T.quote(T.rare_regex(marks))}"))
    staged = staged.selectExpr("*", *[
        ("" if mark == T.DOT else "_gs_rare AND ")
        + f"{T.anchor_test_sql(folded, mark)} AS {flag}" for mark, flag in flags.items()])

    hits = []
    for name, family in common.items():
        hit = T.contains_any_sql(text if family.raw else folded, family.patterns, flags)
        if name == "nosql" and extra:
            hit = f"({hit} OR (NOT {is_file} AND {T.contains_any_sql(folded, extra, flags)}))"
        hits.append(f"{hit} AS _gs_f_{name}")
    return Staged(staged.selectExpr("*", *hits), folded, text, flags)


def scan(df: DataFrame, text: str, is_file: str,
         keywords: Sequence[str] = rules.KEYWORDS) -> tuple[DataFrame, Findings]:
    """Add the findings of both profiles; ``is_file`` picks the profile per row.

    No shuffle and no Python: a chain of projections over the text column. With a
    literal ``is_file`` the other profile's detectors are folded away.
    """
    out = Findings()
    staged = stage(df, text, is_file, keywords)
    injection = ", ".join(
        every_issue_sql(staged.target(f), f, staged.hit(f.name)) if f.every
        else one_issue_sql(staged.hit(f.name), f.message)
        for f in rules.families("file").values())
    keyword = T.contains_keyword_sql(staged.folded, keywords, staged.flags)
    with_pii = staged.df.selectExpr(
        "*",
        f"{is_file} AND {email_sql(text)} AS _gs_email",
        f"{is_file} AND {phone_sql(text)} AS _gs_phone",
        f"{is_file} AND {ssn_sql(text)} AS _gs_ssn")
    found = T.barrier(with_pii, df.columns, {
        out.injection: f"concat({injection})",
        out.pii: pii_sql("_gs_email", "_gs_phone", "_gs_ssn"),
        out.keyword: f"NOT {is_file} AND coalesce({keyword}, false)",
    })
    return found, out
