"""Quality rules and URL filters against plain Python."""

import random
import re

from gatesift.llm.quality_rules import apply_rules
from gatesift.llm.url_filter import bloom_filter, judge_urls, rule_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_counts_and_verdicts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "the and of to in is a that it for was", "x\ny\nx\n\n\nx \n",
             "a b c d e f a b c d e", "a a a a a a a", "Ä#$ |<> ** %%&& \u00a0 \U0001f600 end of it"]
    texts += [" ".join(rng.choice("the of ab cd ef gh\n ij | ###".split(" ")) for _ in range(rng.randint(1, 90)))
              for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").selectExpr(
        "*", "1 AS m", "'x' AS n_words", "2 AS w", "'k' AS kept")
    out = apply_rules(df)
    assert out.columns.count("n_words") == 1 and "w" in out.columns
    for r in out.collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counts(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert r.kept == (not r.base_failed and not r.failed_rules)
    assert apply_rules(df.limit(0)).collect() == []


def test_long_text_and_plan(spark):
    text = " ".join(f"w{i % 50_000}" for i in range(120_000))
    df = spark.createDataFrame([(1, text)], "doc_id INT, text STRING")
    row = apply_rules(df).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (120_000, 120_000, True)
    plan = apply_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_against_all_rules(spark):
    rng = random.Random(2)
    hosts = ["example.org", "WWW.Example.org", "a.b.example.org", "notexample.org", "org", "x.com", "com",
             "é.com", "", ".org", "example.org.", "example.org:80", "1.2.3.4"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/17?x=/de/", "/fr/a", "/de/#f", "?q=/es/", "#/es/", "/EN/1", "//es/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https") for h in hosts for p in paths]
    urls += [None, "", "example.org/es/", "http:/x.org/", "a://b://c.org/es/", "x\n://example.org/en/1\n2"]
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]
    many = rules + [(rng.choice(["allow", "block"]), f"{rng.choice(hosts[:4]).lower()}/{'abcdef'[:i % 6]}{i}")
                    for i in range(3000)]
    urls += [f"http://{r.upper() if i % 9 == 0 else r}x" for i, (_, r) in enumerate(many[::50])]
    df = spark.createDataFrame([(i % 40, u) for i, u in enumerate(urls + urls[:5])], "page_id INT, url STRING") \
        .selectExpr("*", "'x' AS host", "1 AS key", "2 AS block", "3 AS word")
    for table in (rules, many):
        got = judge_urls(df, rule_table(spark, table))
        assert sorted((str(r.url), r.host, r.path, str(r.rule), r.verdict) for r in got.collect()) == \
            sorted((str(u), h, p, str(r), v) for u in urls + urls[:5] for h, p, r, v in [judged(u, table)])


def test_no_listed_key_is_missed_and_most_others_are_stopped(spark):
    listed = spark.createDataFrame([("block", f"h{i}.org/") for i in range(500)], "verdict STRING, rule STRING")
    words = {r.block: r.word for r in bloom_filter(listed, 256).collect()}
    assert len(words) <= 256
    pages = spark.createDataFrame([(i, f"http://h{i}.org/") for i in range(2000)], "page_id INT, url STRING")
    assert judge_urls(pages, listed, max_blocks=4).where("verdict = 'block'").count() == 500


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id INT, url STRING")
    empty = spark.createDataFrame([], "verdict STRING, rule STRING")
    assert [tuple(r) for r in judge_urls(pages, empty).collect()] == [(1, "http://a.org/", "a.org", "/", None, "allow")]
    assert judge_urls(pages.limit(0), rule_table(spark)).collect() == []
