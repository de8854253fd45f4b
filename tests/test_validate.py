import base64

import pytest
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions import scoring as S
from gatesift.operators import validate as V
from gatesift.operators.model import with_model_verdicts, with_scorer
from gatesift.schemas import REQUEST, RESULT_FIELDS


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def test_text_verdicts_and_nulls(texts):
    df = texts(["Hello", "You are stupid", "", "  ", None])
    rows = V.validate_text(df).orderBy("id").collect()
    safe, unsafe, *blank = rows
    assert (safe.status, safe.reason, safe.detected_issues) == ("safe", "safe", [])
    assert (safe.llm_score, safe.rule_score, safe.overall_score) == (1.0, 1.0, 1.0)
    assert safe.analysis_summary == rules.TEXT_SUMMARY
    assert (unsafe.status, unsafe.reason) == ("unsafe", rules.KEYWORD_ISSUE)
    assert unsafe.detected_issues == [rules.KEYWORD_ISSUE_SHOWN]
    assert (unsafe.llm_score, unsafe.rule_score, unsafe.overall_score) == (0.0, 0.0, 0.0)
    for row in blank:
        assert (row.status, row.reason, row.overall_score) == ("unsafe", "empty_input", 0.0)
        assert row.detected_issues is None and row.llm_score is None


def test_error_rows(texts):
    df = texts(["Hello", "You are stupid"])
    row = V.validate_text(df, error=F.when(F.col("id") == 1, "boom")).orderBy("id").collect()[1]
    assert (row.status, row.reason, row.error) == ("error", "validation_error", "boom")
    assert row.overall_score is None and row.detected_issues is None


@pytest.mark.parametrize("level,llm,status,reason,overall", [
    ("high", 0.75, "unsafe", "unspecified_issue", 0.4 + 0.75 * 0.6),
    ("high", 0.9, "safe", "safe", 0.4 + 0.9 * 0.6),
    ("medium", 0.1, "safe", "safe", 0.7 + 0.3),
    ("low", 0.1, "safe", "safe", 1.0),
])
def test_fractional_scores(texts, level, llm, status, reason, overall):
    row = V.validate_text(texts(["Hello"]), level=level, llm_score=F.lit(llm)).first()
    assert (row.status, row.reason, row.overall_score) == (status, reason, overall)
    assert row.llm_score == (llm if level == "high" else 1.0)


def test_levels_per_row_and_blocked(texts):
    df = texts(["Hello"] * 3).withColumn(
        "level", F.element_at(F.array(*[F.lit(x) for x in rules.LEVELS]), F.col("id") + 1))
    rows = V.validate_text(df, level=F.col("level"), blocked=F.lit(True)).orderBy("id").collect()
    assert [r.reason for r in rows] == [rules.MODEL_ISSUE] * 3
    assert [r.llm_score for r in rows] == [0.0, 1.0, 1.0]
    missing = V.validate_text(df, blocked=F.lit(None).cast("boolean")).collect()
    assert {r.status for r in missing} == {"safe"}


FILES = {
    "text": b64("Hello there"),
    "pii": b64("mail a@b.co"),
    "bad": "VGhpcw",
    "large": b64(b"x" * 101),
    "binary": b64(bytes(range(32)) * 2),
    "nothing": "!!!!",
    "pdf": b64(b"%PDF-1.4 \xff body <script"),
}


def verdicts(spark, **options):
    df = spark.createDataFrame(list(FILES.items()), "name STRING, file STRING")
    return {r.name: r for r in V.validate_file(df, max_bytes=100, **options).collect()}


def test_file_guards(spark):
    got = verdicts(spark)
    assert {n: (r.status, r.reason) for n, r in got.items()} == {
        "text": ("safe", "safe"),
        "pii": ("unsafe", f"{rules.PII_ISSUE}, {rules.EMAIL_ISSUE}"),
        "bad": ("unsafe", "invalid_base64"),
        "large": ("unsafe", "file_too_large"),
        "binary": ("error", "unsupported_file_type"),
        "nothing": ("error", "unsupported_file_type"),
        "pdf": ("unsafe", rules.XSS_ISSUE),
    }
    assert got["pii"].llm_score == 0.5 and got["pii"].overall_score == 0.0
    for name in ("bad", "large", "binary", "nothing"):
        assert got[name].overall_score == 0.0 and got[name].detected_issues is None
    assert got["pdf"].analysis_summary == rules.FILE_TEXT_UNSAFE_SUMMARY


def test_size_limit_is_strict(spark):
    df = spark.createDataFrame([(0, b64(b"y" * rules.MAX_BYTES)),
                                (1, b64(b"y" * (rules.MAX_BYTES + 1)))], "id INT, file STRING")
    rows = V.validate_file(df).orderBy("id").collect()
    assert [r.reason for r in rows] == ["safe", "file_too_large"]


def test_pdf_text_and_embedded_files(spark):
    clean = verdicts(spark, pdf_text=F.lit("clean page"))["pdf"]
    assert (clean.status, clean.analysis_summary) == ("safe", rules.PDF_SAFE_SUMMARY)
    embedded = verdicts(spark, pdf_text=F.lit("clean page"), embedded=F.lit(True))["pdf"]
    assert (embedded.status, embedded.reason) == ("unsafe", rules.EMBEDDED_ISSUE)
    assert embedded.llm_score == 0.8
    corrupt = verdicts(spark, decode_unread_pdf=False)["pdf"]
    assert (corrupt.reason, corrupt.llm_score) == (rules.BAD_PDF_ISSUE, 0.0)


REQUESTS = [
    (0, None, "Hello", None, None), (1, None, "Hello", None, "HIGH"),
    (2, None, "a", FILES["text"], "low"), (3, None, None, None, None),
    (4, None, "", FILES["pii"], ""), (5, None, "  ", None, "low"),
    (6, None, "a", "b", "HIGH"), (7, None, None, "", "bogus"),
]


def requests(spark):
    return spark.createDataFrame(REQUESTS, REQUEST)


def test_service_routing(spark):
    rows = V.route_requests(requests(spark)).orderBy("request_id").collect()
    assert [r.request_error for r in rows] == [
        None, rules.BAD_LEVEL_ERROR, rules.AMBIGUOUS_ERROR, rules.MISSING_ERROR, None, None,
        rules.BAD_LEVEL_ERROR, rules.BAD_LEVEL_ERROR]
    assert [r.analysis_type for r in rows] == \
        ["text", None, None, None, "file", "text", None, None]
    assert [r.security_level for r in rows][:5] == ["high", "HIGH", "low", "high", "high"]


def test_gateway_routing(spark):
    rows = V.route_requests(requests(spark), "gateway").orderBy("request_id").collect()
    assert [r.request_error for r in rows] == [
        None, rules.GATEWAY_LEVEL_ERROR, None, rules.MISSING_ERROR, rules.GATEWAY_LEVEL_ERROR,
        None, rules.GATEWAY_LEVEL_ERROR, rules.MISSING_ERROR]


def test_mixed_requests_keep_rejects(spark):
    rows = V.validate_requests(requests(spark)).orderBy("request_id").collect()
    assert [r.reason for r in rows] == [
        "safe", None, None, None, f"{rules.PII_ISSUE}, {rules.EMAIL_ISSUE}", "empty_input",
        None, None]
    assert all(r[c] is None for r in rows if r.request_error for c in RESULT_FIELDS)


def test_verdict_is_a_function_of_content_type_and_level(spark, texts):
    df = texts(["x.bind(y) hate", "x.bind(y) hate", "ok", "ok"])
    for level in rules.LEVELS:
        rows = V.validate_text(df, level=level).orderBy("id").drop("id").collect()
        assert rows[0] == rows[1] and rows[2] == rows[3]


def test_filter_on_verdict_keeps_rows(texts):
    df = texts(["Hello", "You are stupid", "<script", "fine"])
    out = V.validate_text(df).filter("status = 'unsafe' AND size(detected_issues) > 0")
    assert sorted(r.id for r in out.collect()) == [1, 2]


def test_risk_score(texts):
    df = texts(["hi", "a;b", "select; <script>", "union", "ONſELECT = x", "oné = 1"])
    high = {r.id: r for r in V.risk_scores(df, "text", F.lit("high"), F.lit(0.0)).collect()}
    assert high[0].status == "safe" and high[0].overall_score == 0.0
    assert high[2].rule_score == 0.3 + 0.3 + 0.3
    assert high[2].overall_score == (0.3 + 0.3 + 0.3) * 0.4
    assert high[5].risk_issues == [rules.RISK_XSS_ISSUE]
    low = {r.id: r for r in V.risk_scores(df, "text", F.lit("low"), F.lit(1.0)).collect()}
    assert low[2].status == "unsafe" and low[2].llm_score == 0.0
    assert low[1].status == "safe"
    toxic = V.risk_scores(df, "text", F.lit("medium"), F.lit(1.0)).filter("id = 0").first()
    assert toxic.status == "safe" and toxic.overall_score == 0.4
    strict = V.risk_scores(df, "text", F.lit("high"), F.lit(1.0), 0.5).filter("id = 0").first()
    assert (strict.status, strict.reason) == ("unsafe", rules.RISK_OTHER_REASON)


def test_display_error(spark):
    df = spark.createDataFrame(
        [("error", "unsupported_file_type"), ("error", "file_too_large"), ("error", None),
         ("error", "other"), ("unsafe", "invalid_base64")], "status STRING, reason STRING")
    got = [r[0] for r in df.select(S.display_error("status", "reason")).collect()]
    assert got == [rules.DISPLAY_ERRORS["unsupported_file_type"],
                   rules.DISPLAY_ERRORS["file_too_large"], rules.UNKNOWN_ERROR_DISPLAY,
                   "other", None]


def test_model_lookup_and_scorer(spark, texts):
    df = texts(["Hello", "Hi", "  ", "Hey"])
    known = spark.createDataFrame([(0, True), (1, False)], "id INT, blocked BOOLEAN")
    joined = with_model_verdicts(df, known, "id")
    rows = V.validate_text(joined, blocked="blocked", llm_score="llm_score") \
        .orderBy("id").collect()
    assert [r.reason for r in rows] == [rules.MODEL_ISSUE, "safe", "empty_input", "safe"]

    def scorer(given):
        assert given.columns == ["id", "text"]
        return given.filter("id <> 3").select("id", F.lit(0.25).alias("llm_score"))

    scored = with_scorer(df, scorer, "id").orderBy("id").collect()
    assert [r.llm_score for r in scored] == [0.25, 0.25, 1.0, 1.0]


def test_findings_give_the_same_verdicts_as_texts(spark):
    texts = ["fine", "", None, " \u00a0", "You are stupid", "<script", "drop table; kill", "x' OR 1=1 --"]
    df = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts * 3)], "id INT, text STRING, k INT")
    df = df.withColumns({"blocked": F.col("k") == 1, "score": F.when(F.col("k") == 2, 0.4),
                         "error": F.when(F.col("id") == 20, F.lit("broken"))})
    level = F.element_at(F.array(*[F.lit(v) for v in ("high", "medium", "low")]), F.col("id") % 3 + 1)
    options = dict(blocked="blocked", llm_score="score", error="error")
    whole = V.validate_text(df, level=level, **options).drop("text")
    parts = V.decide(V.text_findings(df), level, **options)
    assert parts.columns == whole.columns
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
