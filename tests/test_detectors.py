import random
import re

import pytest
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions import detectors as D
from gatesift.operators import analyze as A
from gatesift.operators import matches as M
from gatesift.plans.inputs import PROBES

def column(df, expression):
    return [r[0] for r in df.orderBy("id").select(expression).collect()]


def expected_injection(text, profile="text"):
    """The rules in plain Python."""
    low = text.lower() if profile == "text" else "".join(
        c.lower() if c.isascii() else c for c in text)
    out = []
    for family in rules.families(profile).values():
        target = text if family.raw else low
        hits = [p for p in family.patterns if p in target]
        if family.every:
            out += [family.message + p for p in hits]
        elif hits:
            out.append(family.message)
    return out


def expected_keyword(text):
    low = text.lower()
    return any(re.search(r"\b" + re.escape(k) + r"\b", low) for k in rules.KEYWORDS)


EDGES = PROBES + [
    "", "   ", "skill", "kill", "KILL!", "kill_x", "ékill", "kill yourself", "shut up",
    "shut  up", "eval(x)", "eval('x')", "mkdir(é", "mkdir( x", "self-harm", "myself-harmed",
    "base64_decode", "xbase64_decode", "KKill", "Kill", "x.bind(y)", "{{X}}", "EVAL(",
    '{"$elemMatch": 1}', "a.env", ". env", "İframe <İframe", "ONİCLICK=",
    "100% sure; id est", "price is $in total", "<<>>", "a\nb; id\n", "ſcript <ſcript",
    "dié", "1die", "die2", "the end.htaccess", "x`y", "??=", "\\..\\", "....\\\\",
    "\U0001f600 hate \U0001f600", "hate​you", "hate you", "evil\u0001",
]


@pytest.mark.parametrize("profile", ["text", "file"])
def test_injection_matches_plain_rules(texts, profile):
    df = texts(EDGES)
    assert column(df, D.detect_code_injection("text", profile)) == \
        [expected_injection(t, profile) for t in EDGES]
    found, names = D.scan(df, "text", str(profile == "file").lower())
    assert column(found, names.injection) == [expected_injection(t, profile) for t in EDGES]


def test_every_signature_fires_its_family(texts):
    for family in rules.families("text").values():
        probes = [f"about {p} then" for p in family.patterns]
        assert all(column(texts(probes), D.detect_family("text", family.name))), family.name


def test_every_keyword_fires_and_the_probes_hold_all_entries(texts):
    probes = [f"about {k} then" for k in rules.KEYWORDS]
    assert column(texts(probes), D.has_harmful_keyword("text")) == [expected_keyword(p) for p in probes]
    entries = [p for f in rules.FAMILIES for p in f.patterns] + list(rules.KEYWORDS)
    assert all(any(e in probe for probe in PROBES) for e in entries)


def test_keywords_match_word_boundaries(texts):
    df = texts(EDGES)
    expected = [expected_keyword(t) for t in EDGES]
    assert column(df, D.has_harmful_keyword("text")) == expected
    found, names = D.scan(df, "text", "false")
    assert column(found, names.keyword) == expected
    assert sum(expected) > 10


def test_keyword_matches_lists_every_keyword(texts):
    got = {(r.id, r.keyword) for r in M.keyword_matches(texts(EDGES)).collect()}
    assert got == {(i, k) for i, t in enumerate(EDGES) for k in rules.KEYWORDS
                   if re.search(r"\b" + re.escape(k) + r"\b", t.lower())}


def test_custom_dictionary(texts):
    df = texts(["a Foo b", "foo-bar", "c++ rocks", "c++", "food"])
    assert column(df, D.has_harmful_keyword("text", ["FOO", "c++ r"])) == \
        [True, True, False, False, False]
    assert column(df, D.has_harmful_keyword("text", [])) == [False] * 5


def test_duplicates_overlaps_and_case(texts):
    df = texts(["x.bind(y)", "shell_exec(", "{{X}}", "EVAL(", '{"$elemMatch": 1}'])
    code = column(df, D.detect_family("text", "code"))
    prefix = rules.CODE_EXECUTION_PREFIX
    assert code[0] == [prefix + "bind(", prefix + "bind("]
    assert code[1] == [prefix + "exec(", prefix + "shell_exec("]
    assert column(df, D.detect_family("text", "template")) == [
        [], [rules.TEMPLATE_ISSUE], [rules.TEMPLATE_ISSUE], [], []]
    assert column(df, D.detect_family("text", "xss"))[3] == [rules.XSS_ISSUE]
    assert column(df, D.detect_family("text", "nosql"))[4] == [rules.NOSQL_ISSUE]
    assert column(df, D.detect_family("text", "nosql", "file"))[4] == []


def test_pii(texts):
    cases = {
        "call 212-555-1234 now": [rules.PHONE_ISSUE],
        "555.123.4567": [rules.PHONE_ISSUE],
        "+1 212 555 1234 x+44 123-456-7890": [rules.PHONE_ISSUE],
        "(212) 555-1234": [],
        "x(212) 555-1234": [rules.PHONE_ISSUE],
        "+1234567890": [],
        "123-45-6789": [rules.SSN_ISSUE],
        "1123-45-6789": [],
        "é123-45-6789": [rules.SSN_ISSUE],
        "john.doe@example.com": [rules.EMAIL_ISSUE],
        "john@example": [],
        "a@b.co 212-555-1234 123-45-6789":
            [rules.EMAIL_ISSUE, rules.PHONE_ISSUE, rules.SSN_ISSUE],
    }
    got = column(texts(list(cases)), D.detect_pii("text"))
    assert got == [[rules.PII_ISSUE, *v] if v else [] for v in cases.values()]


def test_cheap_pii_tests_give_what_the_patterns_give(texts):
    draw = random.Random(4)
    pieces = ["415-555-0199", "(415) 555-0199", "+1 415.555.0199", "555 010 4477", "321-54-9876", "a.b@c.de",
              "x@y.z", "@", "+", "(", ")", "-", ".", " ", "\n", "_", "1", "22", "333", "4444", "a", "\u00e9", "+12 "]
    values = ["".join(draw.choices(pieces, k=draw.randint(1, 7))) for _ in range(4000)]
    # a long run of the characters that addresses may begin with
    values += ["a" * 300_000 + " @ " + "b" * 300_000, "a" * 300_000 + "@b.cc"]
    rows = texts(values).select("id", D.has_email("text"), D.has_phone("text"), D.has_ssn("text")).collect()
    patterns = [re.compile(p, re.ASCII) for p in (rules.EMAIL_REGEX, rules.PHONE_REGEX, rules.SSN_REGEX)]
    for i, *got in rows:
        expected = [bool(p.search(values[i])) for p in patterns] if i < 4000 else [i == 4001, False, False]
        assert got == expected, values[i][:80]
    assert all(200 < sum(r[k] for r in rows) < 3800 for k in (1, 2, 3))


def test_profiles_differ(texts):
    df = texts(["You are stupid", "mail a@b.co", "eval('x')"])
    text = column(A.analyze_text(df), "analysis.detected_issues")
    file = column(A.analyze_file_text(df), "analysis.detected_issues")
    assert text[0] == [rules.KEYWORD_ISSUE] and file[0] == []
    assert text[1] == [] and file[1] == [rules.PII_ISSUE, rules.EMAIL_ISSUE]
    assert text[2] == file[2] == expected_injection("eval('x')")


def test_file_order_scores_and_threshold(texts):
    df = texts(["fine", "mail a@b.co", "<script", "mail a@b.co <script", "x" * 100])
    rows = A.analyze_file_text(df, max_bytes=99).orderBy("id").collect()
    got = [r.analysis for r in rows]
    assert [a.confidence_score for a in got] == [1.0, 0.5, 0.5, 0.0, 0.0]
    assert [a.is_safe for a in got] == [True, False, False, False, False]
    assert got[3].detected_issues == [rules.PII_ISSUE, rules.EMAIL_ISSUE, rules.XSS_ISSUE]
    assert got[4].detected_issues == [rules.OVERSIZE_ISSUE]
    assert got[4].analysis_summary == rules.OVERSIZE_SUMMARY
    lenient = A.analyze_file_text(df, threshold=0.5).orderBy("id").collect()
    assert [r.analysis.is_safe for r in lenient] == [True, True, True, False, True]
    per_row = A.analyze_file_text(df, threshold=F.when(F.col("id") == 1, 0.5).otherwise(0.8))
    assert [r.analysis.is_safe for r in per_row.orderBy("id").collect()] == \
        [True, True, False, False, True]


def test_content_safety(texts):
    df = texts(["fine", "You are stupid", "mail a@b.co"])
    assert column(A.with_content_safety(df), "is_content_safe") == [True, False, True]
    assert column(A.with_content_safety(df, profile="file"), "is_content_safe") == \
        [True, True, False]
    scored = A.with_content_safety(df, llm_score=F.lit(0.7))
    assert column(scored, "is_content_safe") == [False, False, False]


def test_adding_text_keeps_issues(texts):
    base = column(texts(PROBES), D.detect_code_injection("text"))
    more = column(texts([f"before {p} after" for p in PROBES]), D.detect_code_injection("text"))
    assert all(set(a) <= set(b) for a, b in zip(base, more))


def test_fixed_analyses(spark):
    row = spark.range(1).select(A.unavailable_analysis().alias("a"),
                                A.failed_analysis("'disk error'").alias("b")).first()
    assert row.a.detected_issues == [rules.FILE_UNAVAILABLE_ISSUE]
    assert (row.b.is_safe, row.b.analysis_summary) == (False, "disk error")
