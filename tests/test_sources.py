import json
import random
from itertools import groupby

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions import text as T
from gatesift.operators import matches
from gatesift.operators.matches import (
    keyword_matches,
    keyword_table_matches,
    rule_matches,
    rule_table_matches,
)
from gatesift.operators.validate import validate_requests
from gatesift.schemas import REQUEST
from gatesift.sources import dictionaries, files, pages
from gatesift.sources import requests as R
from gatesift.operators.cache import to_verdict

PAGES = [
    (1, 2, "pt('x')", False), (1, 1, "<scri", False), (2, 1, "fine", True), (2, 2, "", False),
    (3, 1, None, False), (4, 1, None, False), (4, 2, "mail a@b.co", True),
    (5, 1, "x" * 60, False), (5, 2, "y" * 60, False), (6, 10, "b", False), (6, 9, "a", False),
]


def page_rows(spark, max_bytes=100):
    df = spark.createDataFrame(
        PAGES, "doc_id INT, page_no INT, text STRING, has_embedded_files BOOLEAN")
    return df, max_bytes


def test_pages_are_joined_in_order(spark):
    df, limit = page_rows(spark)
    docs = {r.doc_id: r for r in pages.assemble_pages(df, max_bytes=limit).collect()}
    assert docs[1].text == "<script('x')" and docs[6].text == "ab"
    assert docs[3].text is None and docs[5].text is None
    assert (docs[5].n_bytes, docs[5].n_pages) == (120, 2)
    assert docs[2].has_embedded_files and not docs[1].has_embedded_files


def test_paged_analysis(spark):
    df, limit = page_rows(spark)
    got = {r.doc_id: r.analysis for r in pages.analyze_pages(df, max_bytes=limit).collect()}
    assert got[1].detected_issues == [rules.XSS_ISSUE]
    assert got[1].analysis_summary == rules.PDF_UNSAFE_SUMMARY
    assert (got[2].detected_issues, got[2].confidence_score, got[2].is_safe) == \
        ([rules.EMBEDDED_ISSUE], 0.8, True)
    assert got[2].analysis_summary == rules.PDF_SAFE_SUMMARY
    assert (got[3].detected_issues, got[3].confidence_score, got[3].is_safe) == \
        ([rules.BAD_PDF_ISSUE], 0.0, False)
    # unsafe documents get no embedded-file issue
    assert got[4].detected_issues == [rules.PII_ISSUE, rules.EMAIL_ISSUE]
    assert got[5].detected_issues == [rules.OVERSIZE_ISSUE]
    assert got[6].is_safe and got[6].confidence_score == 1.0


def test_files(spark, tmp_path):
    contents = {"a.txt": b"mail a@b.co", "b.pdf": b"%PDF-1 <script", "c.bin": b"\xff\x00ok",
                "d.big": b"z" * 50}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    df = files.read_files(spark, str(tmp_path), max_bytes=40)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.analyze_files(df).collect()}
    assert got["a.txt"].analysis.detected_issues == [rules.PII_ISSUE, rules.EMAIL_ISSUE]
    assert got["b.pdf"].analysis.detected_issues == [rules.XSS_ISSUE]
    assert got["b.pdf"].analysis.analysis_summary == rules.FILE_TEXT_UNSAFE_SUMMARY
    assert got["c.bin"].analysis.is_safe
    assert got["d.big"].content is None and got["d.big"].length == 50
    assert got["d.big"].analysis.detected_issues == [rules.OVERSIZE_ISSUE]
    read = files.analyze_files(df, pdf_text=F.lit("page"), embedded=F.lit(True)).collect()
    pdf = next(r for r in read if r.path.endswith("b.pdf")).analysis
    assert (pdf.is_safe, pdf.detected_issues) == (True, [rules.EMBEDDED_ISSUE])
    assert next(r for r in read if r.path.endswith("c.bin")).analysis.detected_issues == []
    with pytest.raises(AnalysisException):
        files.read_files(spark, str(tmp_path / "missing"))


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "keywords.json"
    path.write_text(json.dumps(rules.KEYWORDS, indent=1))
    assert [r.keyword for r in dictionaries.read_keywords(spark, str(path)).collect()] == rules.KEYWORDS
    missing = dictionaries.read_keywords(spark, str(tmp_path / "none.json"))
    assert missing.columns == ["keyword"] and missing.isEmpty()
    assert dictionaries.keywords_table(spark).count() == 136
    table = dictionaries.rules_table(spark)
    assert table.count() == 259
    assert dictionaries.rules_table(spark, "file").count() == 258
    assert table.filter("family = 'template' AND case_sensitive").count() == 17
    assert dictionaries.levels_table(spark).count() == 3


def test_dictionary_of_any_length(spark):
    words = [(f"term{i}",) for i in range(50_000)] + [
        ("Two Words",), ("f(",), ("(g",), ("a-b c",), ("++",), ("",), (None,), ("term7",)]
    table = spark.createDataFrame(words, "keyword STRING").repartition(4)
    texts = ["term49999 and TERM7, term7", "xterm7 term7_", "two words twotwo  words", "f(x) f( (g)", "x(g f(",
             "a-b c", "a-b cd", "i++j", "i++", "++", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    got = sorted(map(tuple, keyword_table_matches(df, table).collect()))
    few = [w for (w,) in words if w and not w.startswith("term")] + ["term7", "term49999"]
    assert got == sorted(map(tuple, keyword_matches(df, keywords=few).collect()))
    assert {(0, "term49999"), (0, "term7"), (2, "two words"), (3, "f("), (7, "++")} <= set(got)
    assert keyword_table_matches(df, table.limit(0)).isEmpty()


def test_rules_as_a_table_of_any_length(spark):
    table = dictionaries.rules_table(spark)
    texts = [f"some {p} here" for f in rules.FAMILIES for p in f.patterns] + [
        "", None, "plain words only", "a" * 70_000 + "<script", "é<ScRiPt" * 3, "`", "\U0001f600{{7*7}}",
        "x" * 65_534 + "../", "x" * 65_535 + "../"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    for profile in ("text", "file"):
        own = dictionaries.rules_table(spark, profile)
        got = sorted(map(tuple, rule_table_matches(df, own, profile=profile).collect()))
        assert got == sorted(map(tuple, rule_matches(df, profile=profile).collect())) and len(got) > 259
    extra = spark.createDataFrame([("own", i, f"sign{i}", False, "all") for i in range(20_000)]
                                  + [("own", -1, None, False, "all"), ("own", -2, "", False, "all"),
                                     ("own", -3, "Zz", True, "all"), ("own", -4, "é", None, "all")],
                                  table.schema).repartition(3)
    more = spark.createDataFrame([(1, "SIGN19999 and sign7x"), (2, "Zz zz"), (3, "É")], "id INT, text STRING")
    got = {(r.id, r.pattern) for r in rule_table_matches(more, table.union(extra)).collect()}
    assert got == {(1, p) for p in ("sign19999", "sign1999", "sign199", "sign19", "sign1", "sign7")} | {
        (2, "Zz"), (3, "é")}
    assert rule_table_matches(df, table.limit(0)).isEmpty()


def test_table_matches_move_no_texts(spark, texts, tmp_path):
    values = ["${x} <script `", "\U0001f600bc kill \U0001d49cx KILL", "do kill yourself, kill", None, ""] * 3
    texts(values).repartition(3).write.parquet(str(tmp_path / "texts"))
    df = spark.read.parquet(str(tmp_path / "texts"))
    own = spark.createDataFrame([("own", 1, "\U0001f600bc", True, "all"), ("own", 2, "", False, "all")],
                                dictionaries.rules_table(spark).schema)
    table = dictionaries.rules_table(spark).union(own)
    for found, more in ((rule_table_matches(df, table), {(1, "own", 1, "\U0001f600bc")}),
                        (keyword_table_matches(df, dictionaries.keywords_table(spark)), {(2, "kill yourself")})):
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        assert more <= set(map(tuple, found.collect()))


def test_a_large_table_is_broadcast_in_parts(spark, texts, monkeypatch):
    df = texts([f"some {p} here" for f in rules.FAMILIES for p in f.patterns] + [f"a {k}x {k}" for k in rules.KEYWORDS])
    table, keywords = dictionaries.rules_table(spark), dictionaries.keywords_table(spark)
    whole = [sorted(map(tuple, f.collect())) for f in (rule_table_matches(df, table), keyword_table_matches(df, keywords))]
    monkeypatch.setattr(matches, "_BROADCAST", 9_000)
    monkeypatch.setattr(T, "PLACE_CHARACTERS", 5)
    parts = rule_table_matches(df, table)
    assert parts._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") > 2
    assert [sorted(map(tuple, f.collect())) for f in (parts, keyword_table_matches(df, keywords))] == whole


def test_windows_of_runs_in_odd_texts(spark, texts):
    rng = random.Random(5)
    marks = ["a", "b", "\u00e9", "\U0001d49c", "\u4e2d", "7", "_", " ", "-", "(", "\U0001f600", "\n", "K", "\u0130"]
    values = ["".join(rng.choices(marks, k=rng.randrange(12))) for _ in range(400)]
    words = sorted({"".join(rng.choices(marks, k=rng.randrange(1, 4))).lower() for _ in range(400)})
    table = spark.createDataFrame([(w,) for w in words], "keyword STRING")
    got = {(r.id, r.keyword) for r in keyword_table_matches(texts(values), table).collect()}

    def windows(text):
        runs = ["".join(g) for _, g in groupby(text, lambda c: c.isalnum() or c == "_")]
        for i in range(len(runs)):
            for j in range(i + 1, len(runs) + 1):
                word = [r[0].isalnum() or r[0] == "_" for r in (runs[i], runs[j - 1])]
                if (i or word[0]) and (j < len(runs) or word[1]):
                    yield "".join(runs[i:j])

    lowered = [r[0] for r in texts(values).orderBy("id").selectExpr("lower(text)").collect()]
    known = {r[0] for r in table.selectExpr("lower(keyword)").collect()}
    assert got == {(i, w) for i, t in enumerate(lowered) for w in windows(t) if w in known} and len(got) > 100


def test_listed_files_that_are_missing_or_not_analysed(spark, tmp_path):
    for name, data in {"a": b"mail a@b.co", "b": b"%PDF fine", "c": b"z" * 50}.items():
        (tmp_path / name).write_bytes(data)
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), ("e",)], "name STRING")
    found = files.read_listed_files(spark, str(tmp_path), listed, F.regexp_extract("path", "([^/]+)$", 1), 40)
    rows = files.analyze_files(found, error="error", available=F.col("name") != "e").collect()
    got = {r.name: (r.analysis.is_safe, r.analysis.detected_issues, r.analysis.analysis_summary) for r in rows}
    assert len(rows) == 5 and got["a"][1] == [rules.PII_ISSUE, rules.EMAIL_ISSUE]
    assert got["b"][0] and got["c"][1] == [rules.OVERSIZE_ISSUE]
    assert got["d"] == (False, [rules.FILE_ERROR_ISSUE], rules.FILE_MISSING_ERROR + "d")
    assert got["e"] == (False, [rules.FILE_UNAVAILABLE_ISSUE], rules.FILE_UNAVAILABLE_SUMMARY)


def test_names_of_folders_are_no_columns_and_files_are_listed_once(spark, tmp_path, monkeypatch):
    for i, folder in enumerate(("bundle=1", "part=2/bundle=2", "plain", "bundle=x")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / f"f{i}").write_text("mail a@b.co")
    loads, reader = [], type(spark.read)
    load = reader.load
    monkeypatch.setattr(reader, "load", lambda self, *a, **b: loads.append(a) or load(self, *a, **b))
    listed = spark.createDataFrame([(f"f{i}",) for i in range(5)], "name STRING")
    found = files.read_listed_files(spark, str(tmp_path / "in"), listed, F.regexp_extract("path", "([^/]+)$", 1))
    assert {(r.name, r.length, r.error is None) for r in found.collect()} == {
        *((f"f{i}", 11, True) for i in range(4)), ("f4", None, False)}
    assert len(loads) == 1


def test_files_are_written_by_tasks_into_few_folders(spark, tmp_path):
    rows = [(i // 3 if i else None, f"{i}\u00e9" if i % 7 else None, i) for i in range(900)]
    lines = spark.createDataFrame(rows, "bundle BIGINT, value STRING, n INT") \
        .withColumn("value", F.when(F.col("n") == 5, F.expr("cast(X'61FF62' AS string)")).otherwise(F.col("value"))) \
        .repartition(4, "bundle").sortWithinPartitions("bundle", "n").drop("n")
    files.write_files(lines, str(tmp_path / "out"))
    written = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len({p.parent for p in written}) <= 4 and not any(p.name.startswith(".") for p in written)
    expected = {}
    for bundle, value, n in rows:
        name = "bundle=__HIVE_DEFAULT_PARTITION__" if bundle is None else f"bundle={bundle}"
        expected.setdefault(name, []).append(b"a\xffb" if n == 5 else (value or "").encode())
    assert {p.name: p.read_bytes() for p in written} == {
        name: b"".join(v + b"\n" for v in values) for name, values in expected.items()}
    with pytest.raises(FileExistsError):
        files.write_files(lines, str(tmp_path / "out"))


def test_another_store_gets_a_folder_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "local_path", lambda *_: None)
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "bundle BIGINT, value STRING")
    files.write_files(lines.repartition(2, "bundle").sortWithinPartitions("bundle", "value"), str(tmp_path / "out"))
    found = {r.path.split("bundle=")[1][0]: bytes(r.content) for r in
             files.read_files(spark, str(tmp_path / "out")).collect()}
    assert found == {"1": b"a\nb\n", "2": b"\n"}


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(1500):
        (tmp_path / f"f{i}").write_bytes(b"z" * (1 + i % 50))
    settings = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    before = [spark.conf.get(k) for k in settings]
    found = files.read_files(spark, str(tmp_path), max_bytes=40)
    # one pass over the files within the limit, one over the others
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert found.count() == 1500 and found.filter("content IS NULL").count() == 300
    assert found.sparkSession is spark and [spark.conf.get(k) for k in settings] == before
    assert found._jdf.sparkSession().equals(spark._jsparkSession)


def test_very_many_empty_pages_are_not_collected(spark):
    df = spark.range(20_000).selectExpr("1 AS doc_id", "cast(id AS int) AS page_no", "if(id = 77, 'x', '') AS text")
    none = spark.createDataFrame([(2, 1, ""), (3, 1, None), (None, 2, "b"), (None, 1, "a")],
                                 "doc_id INT, page_no INT, text STRING")
    docs = pages.assemble_pages(df.unionByName(none), embedded=None)
    assert {r.doc_id: (r.text, r.n_pages) for r in docs.collect()} == {
        1: ("x", 20_000), 2: ("", 1), 3: (None, 1), None: ("ab", 2)}
    assert "length(text" in docs._jdf.queryExecution().optimizedPlan().toString()


def test_malformed_requests_stay_as_rows(spark, tmp_path):
    lines = ['{"request_id": 1, "text": "Hello"}', '{"request_id": 2, "te', "not json", '{"request_id": "x"}',
             '{"request_id": 5, "text": "a", "other": 1}', "", "{}"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/requests.json").write_text("\n".join(lines))
    rows = validate_requests(R.read_requests(spark, str(tmp_path / "in"), "json")).collect()
    got = sorted((r.request_id or 0, r.request_error or r.status, r.corrupt_request or "") for r in rows)
    assert got == sorted([(1, "safe", ""), (5, "safe", ""), (0, rules.MISSING_ERROR, ""),
                          *((0, rules.MALFORMED_ERROR, x) for x in lines[1:4])])


def test_a_batch_written_again_replaces_all_of_it(spark, tmp_path):
    def verdicts(*statuses):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(statuses)], "request_id BIGINT, status STRING")
        return df.withColumn("reason", F.lit("r"))

    path = str(tmp_path / "out")
    R.write_verdicts(verdicts("safe", "error", "unsafe", None), path, "request_id", batch="1")
    R.write_verdicts(verdicts("safe"), path, "request_id", batch="2")
    R.write_verdicts(verdicts("unsafe", "unsafe", None), path, "request_id", batch="1")
    back = R.read_verdicts(spark, path, "request_id BIGINT")
    assert sorted((r.batch, str(r.status)) for r in back.collect()) == [
        ("1", "None"), ("1", "unsafe"), ("1", "unsafe"), ("2", "safe")]
    plan = back.filter("status = 'unsafe' AND batch = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "status#" in plan.split("PartitionFilters")[1]


def test_requests_and_verdicts_round_trip(spark, tmp_path):
    rows = [(1, None, "Hello", None, None), (2, None, "<script", None, "low"),
            (3, None, "x", None, "nope")]
    spark.createDataFrame(rows, REQUEST).write.json(str(tmp_path / "in"))
    requests = R.read_requests(spark, str(tmp_path / "in"), "json")
    verdicts = validate_requests(requests)
    R.write_verdicts(verdicts.filter("request_error IS NULL"), str(tmp_path / "out"), "request_id")
    back = R.read_verdicts(spark, str(tmp_path / "out"), "request_id BIGINT")
    assert {(r.request_id, r.status) for r in back.collect()} == {(1, "safe"), (2, "unsafe")}
    assert (tmp_path / "out" / "batch=all" / "status=unsafe").exists()
    assert set(back.columns) == {*to_verdict(verdicts, "request_id").columns, "batch"}
    stream = R.stream_requests(spark, str(tmp_path / "in"), "json", 1)
    assert stream.isStreaming and stream.columns == requests.columns
