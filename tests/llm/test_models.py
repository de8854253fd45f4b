"""Classifiers by held-out accuracy, language-model scores against a dictionary model."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from gatesift.llm.common import held_out
from gatesift.llm.compression import score_quality
from gatesift.llm.lm_scoring import score_difference
from gatesift.llm.toxic_grammar import Grammar, compose, score_toxicity

DOCS = TESTDATA.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{DOCS}/documents.parquet"), spark.read.parquet(f"{DOCS}/labels.parquet"))


@pytest.mark.parametrize("score, label, least", [(score_toxicity, "toxic", 0.93), (score_quality, "quality", 0.93)])
def test_held_out_accuracy(tables, score, label, least):
    docs, labels = tables
    out = (score(docs.select("doc_id", "text"), labels).join(labels, "doc_id")
           .where(held_out(F.col("doc_id"))).select("score", "predicted", label).toPandas())
    assert out.score.between(0, 1).all()
    assert (out.predicted == out[label]).mean() >= least
    assert out.score[out[label] == 1].mean() > 2 * out.score[out[label] == 0].mean()


@pytest.mark.parametrize("score", [score_toxicity, score_quality])
def test_edges(spark, tables, score):
    docs, labels = tables
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 50_000), (4, "x"), (4, "x"), (None, "x y")],
                                "doc_id BIGINT, text STRING").selectExpr("*", "'a' AS score", "1 AS label", "2 AS turn")
    both = docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True)
    out = [r for r in score(both, labels).where("label = 1").collect()]
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert {r.score for r in out if r.doc_id in (1, 2)} == {out[0].score}
    assert score(both.limit(0), labels).collect() == []
    one_sided = labels.selectExpr("doc_id", "1 AS toxic", "1 AS quality")
    assert all(r.score > 0.6 for r in score(docs.limit(20), one_sided).collect())
    assert {r.score for r in score(docs.limit(20), labels.limit(0)).collect()} == {0.5}


def test_learns_from_no_held_out_row(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    same = [score_quality(docs, x).orderBy("doc_id").select("score").collect() for x in (labels, flipped)]
    assert same[0] == same[1]


def test_the_bound_of_the_sample_holds_whatever_repeats(spark):
    from gatesift.llm.common import learn_from
    docs = spark.createDataFrame([(i % 10, f"text {i % 3}") for i in range(1000)], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i % 10, i % 10 % 2) for i in range(50)] + [(2, 1), (3, 0)], "doc_id BIGINT, toxic INT")
    rows = learn_from(docs, labels, "toxic", 5).collect()
    assert len(rows) == len({r.doc_id for r in rows}) <= 5 and all(r.label == r.doc_id % 2 for r in rows)
    every = learn_from(docs, labels, "toxic", 100).collect()
    kept = [r[0] for r in spark.range(10).where(~held_out(F.col("id"))).collect()]
    assert sorted(r.doc_id for r in every) == [i for i in kept if i not in (2, 3)]  # 2 and 3 are contradicted
    assert sorted(map(str, learn_from(docs.repartition(7), labels, "toxic", 5).collect())) == sorted(map(str, rows))


def test_features_are_the_sizes_of_whole_texts(spark, tables):
    """The operator's features against compressing each text here with the same dictionaries."""
    import zstandard

    from gatesift.llm import compression
    docs, labels = tables
    sample = compression.learn_from(docs, labels, "quality", compression.SAMPLE_ROWS).where("text <> ''").collect()
    trained = [compression._dictionary([r.text for r in sample if r.label == v]) for v in (1, 0)]
    measure = compression.SizeFeatures(*trained)
    for text in [r.text for r in docs.limit(200).collect()] + [None, "", "word " * 100_000]:
        raw = (text or "").encode()
        sizes = [len(zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d),
                                              write_content_size=False).compress(raw)) for d in trained]
        assert measure(text) == pytest.approx(
            ((sizes[1] - sizes[0]) / max(sizes), math.log(sum(sizes) / 2 / (len(raw) + 1))))


def test_whole_rows_within_a_bound(spark):
    from gatesift.llm.compression import _dictionary, _whole_rows
    rows = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(300)], "doc_id BIGINT, text STRING")
    kept = _whole_rows(rows, 1000).collect()
    assert 960 < sum(len(r.text) for r in kept) <= 1000 and all(len(r.text) == r.doc_id % 40 for r in kept)
    assert _whole_rows(rows, 10**6).count() == 300
    assert _dictionary(["ab", "cd"]) == b"ab\ncd"  # too little to train on


def test_grammar_reads_clauses():
    grammar = Grammar({"fool": 2.0}, {"idio": 1.0})
    names = ["plain", "aimed", "negated", "reported"]
    def kinds(text):
        return {n for n, v in zip(names, grammar(text)[:4]) if v > 0}
    assert kinds("what a fool") == {"plain"}
    assert kinds("You fool!") == {"aimed"}
    assert kinds("you are not a fool") == {"negated"}
    assert kinds("she said: fool") == {"plain"}  # the colon ends the clause
    assert kinds("they called him a fool") == {"reported"}
    assert kinds("Idiotic things") == {"plain"} and kinds("idio") == set()
    assert kinds("not here. fool, you") == {"plain"}
    assert kinds("a fool like you") == kinds("idiots like you") == {"aimed"}  # the target behind
    assert kinds("a fool. you") == {"plain"} and kinds("no fool like you") == {"negated"}
    assert kinds("you fool, not a fool") == {"aimed", "negated"}
    assert grammar(None) == grammar("") and len(compose()) == 16 * 7


def test_composed_machine_equals_reading_each_clause(spark):
    from gatesift.llm.toxic_grammar import AIMED_FACTOR, CLOSED, KINDS
    words, prefixes = {"fool": 2.0, "scum": 3.5, "kill": 0.5}, {"idio": 1.0, "stup": 2.5}
    grammar = Grammar(words, prefixes)

    def weight(w):
        return max([words.get(w, 0.0)] + [prefixes.get(w[:n], 0.0) for n in range(4, 9) if n < len(w)])

    def plain(text):
        sums, strongest, number = dict.fromkeys(KINDS, 0.0), 0.0, 0
        for clause in re.split(r"[.!?;:,|\n]", (text or "").lower()):
            number += 1
            tokens = re.findall(r"[^\W\d_]+", clause)
            classes = {c: [i for i, w in enumerate(tokens) if w in ws and not weight(w)] for c, ws in CLOSED.items()}
            best = {}
            for i, w in enumerate(tokens):
                kind = "I" if weight(w) else "T" if i in classes["T"] else ""
                if not kind:
                    continue
                if any(i - 3 <= j < i for j in classes["N"]):
                    kind += "negated"
                elif any(j < i for j in classes["R"]):
                    kind += "reported"
                else:
                    kind += "aimed" if classes["G"] else "plain"
                best[kind] = max(best.get(kind, 0.0), weight(w) or 2.0)
            for kind, value in best.items():
                sums[kind] += value
            strongest = max(strongest, best.get("Iplain", 0) + AIMED_FACTOR * best.get("Iaimed", 0))
        meant = sum(sums[k] for k in KINDS if k.endswith(("plain", "aimed")))
        return [math.log1p(sums[k]) for k in KINDS] + [strongest, meant / math.sqrt(number + 2)]

    vocabulary = ["fool", "scum", "idiots", "stupid", "kill", "you", "he", "not", "never", "said", "called", "a",
                  "the", "house", "burn", "dich", "nicht", "sagte", ",", ".", "!", "\n", "-", "x1", "Fool"]
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(300)] + [None, "", ". ,"]
    texts += [r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    for text in texts:
        assert grammar(text) == pytest.approx(plain(text)), text


def test_quoted_and_denied_insults_are_no_verdict(spark, tables):
    docs, labels = tables
    insults = ["idiot", "moron", "stupid", "loser"]
    texts = [" ".join(f"You are a {w}, you {w}!" for w in insults),
             " ".join(f"They said he was a {w}." for w in insults),
             " ".join(f"You are not a {w}." for w in insults)]
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    out = score_toxicity(docs.select("doc_id", "text").union(own), labels).where("doc_id < 0").collect()
    score = {r.doc_id: r.score for r in out}
    assert score[-1] >= 0.7 > max(score[-2], score[-3])


@pytest.mark.parametrize("block_bytes, owned_keys", [(8_000_000, 2_000_000), (40, 20)])
def test_scores_match_a_dictionary_model(spark, block_bytes, owned_keys):
    texts = ["a b a b a b", "a b c", None, "", "d d d", "A b", "z", "b a\tb"] + [f"w{i % 7} w{i % 5} a" for i in range(40)]
    targets = [0, 1, 4, 999]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1.0)],
                                 "doc_id BIGINT, text STRING, wanted STRING, score DOUBLE").repartition(3)
    out = score_difference(docs, spark.createDataFrame([(t,) for t in targets + [None]], "doc_id BIGINT"),
                           block_bytes, owned_keys)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    rows = list(enumerate(texts)) + [(0, texts[0])]
    vocabulary = len({w for t in texts for w in split(t)}) + 1

    def model(chosen):
        single, pair, begins = Counter(), Counter(), 0
        for t in chosen:
            words = split(t)
            begins += bool(words)
            single.update(words)
            pair.update(zip([None, *words], words))
        total = max(1, sum(single.values()))

        def loss(t):
            words = split(t)
            return sum(-math.log2(0.7 * min(1, pair[v, w] / max(1, begins if v is None else single[v]))
                                  + 0.29 * single[w] / total + (1 - 0.7 - 0.29) / vocabulary)
                       for v, w in zip([None, *words], words)) / max(1, len(words))
        return loss
    target, background = model([t for i, t in rows if i in targets]), model([t for _, t in rows])
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id]
        assert r.n_tokens == len(split(t))
        assert (r.target_loss, r.background_loss) == pytest.approx((target(t), background(t)))
        assert r.score == pytest.approx(target(t) - background(t))
    assert score_difference(docs.limit(0), out.select("doc_id")).collect() == []


def test_probabilities_sum_to_one_over_the_vocabulary(spark):
    words = ["a", "b", "c", "d"]
    texts = ["a b a c", "b a", "c d d"] + [f"a {w}" for w in words] + ["a unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in score_difference(docs, docs.where("doc_id < 3").select("doc_id")).collect()}
    # the first token's loss is the same in the last five texts: what differs is the second's
    bits = [got[i].background_loss * 2 for i in range(3, 8)]
    single = {w: sum(t.split().count(w) for t in texts) for w in [*words, "unseen"]}
    pairs = {w: sum(("a", w) in zip(t.split(), t.split()[1:]) for t in texts) for w in [*words, "unseen"]}
    p = {w: 0.7 * pairs[w] / single["a"] + 0.29 * single[w] / sum(single.values()) + 0.01 / 6 for w in single}
    assert [b - bits[0] for b in bits] == pytest.approx(
        [-math.log2(p[w]) + math.log2(p["a"]) for w in [*words, "unseen"]])
    # with the unknown word; an a at a text's end is followed by none
    assert sum(p.values()) + 0.01 / 6 == pytest.approx(0.7 * sum(pairs.values()) / single["a"] + 0.3)


def test_counts_of_a_large_vocabulary_are_exact(spark):
    # more words and pairs than tasks hold: rare words must not take the counts of others
    texts = [" ".join(f"v{i * 3000 + j}" for j in range(3000)) for i in range(100)] + ["v0 v1 v0 v1", "v0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(6)
    good = spark.createDataFrame([(7,), (100,)], "doc_id BIGINT")
    got = {r.doc_id: r for r in score_difference(docs, good).collect()}
    words = 300_000 + 1
    assert len(got) == len(texts)

    def bits(pair, context, word, tokens):
        return -math.log2(0.7 * pair / context + 0.29 * word / tokens + (1 - 0.7 - 0.29) / words)
    # texts 8 to 99 have each word and pair once; text 7 twice as target
    first, rest = bits(1, 102, 1, 300_005), bits(1, 1, 1, 300_005)
    for i in range(8, 100):
        assert got[i].background_loss == pytest.approx((first + 2999 * rest) / 3000)
        assert got[i].target_loss == pytest.approx(bits(0, 1, 0, 3004))
    assert got[7].target_loss == pytest.approx((bits(1, 2, 1, 3004) + 2999 * bits(1, 1, 1, 3004)) / 3000)
