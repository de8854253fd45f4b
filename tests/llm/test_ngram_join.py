"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from gatesift.llm.components import components
from gatesift.llm.ngram_join import ngram_components, reaches
from gatesift.llm.shingles import shingle_set, shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(docs):
    """(doc_id, n_shingles, component_id) of all rows."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(doc_id)
    named = lambda i: min((x for x in ids[find(i)] if x is not None), default=None)
    return sorted((str(d), len(s), str(named(i) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def found(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    for name, column in more.items():
        df = df.withColumn(name, column)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id))
                  for r in ngram_components(df.repartition(5)).collect())


def test_near_copies_large_groups_and_shared_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = prose(120), prose(60)
    texts = []
    for _ in range(60):  # one large group of near copies, linked by chains at the edges
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    for _ in range(40):  # a passage that many documents share, in short and long ones
        texts.append(" ".join(prose(rng.randint(0, 40)) + passage + prose(rng.randint(0, 40))))
    for _ in range(30):  # pairs around the threshold
        own = prose(rng.randint(5, 60))
        texts += [" ".join(own), "  ".join(own[:-1] + prose(1)).upper()]
    texts += [" ".join(base)] * 20
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    assert found(spark, docs) == brute_force(docs)


def test_big_lists_in_blocks_with_copies_around_the_similarity(spark, monkeypatch):
    import gatesift.llm.ngram_join as module
    monkeypatch.setattr(module, "SKETCH_BLOCK", 16)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(90):  # copies with 2 to 7 changed words: links between some of them only
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(2, 7)):
            copy[at] = f"c{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    docs = list(enumerate(texts))
    expected = brute_force(docs)
    assert 2 < len({component for _, _, component in expected}) < len(docs)
    assert found(spark, docs) == expected


def links_by_brute_force(docs):
    sets = [shingles(t) for _, t in docs]
    return sorted((str(docs[i][0]), sum(i != j and bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
                                        for j, b in enumerate(sets))) for i, a in enumerate(sets))


def links_found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(5)
    return sorted((str(r.doc_id), r.n_links) for r in ngram_components(df, with_links=True).collect())


@pytest.mark.parametrize("block_bytes", [None, 20_000, 3_000])
def test_links_inside_components(spark, monkeypatch, block_bytes):
    import gatesift.llm.link_counts as module
    if block_bytes:  # whole components, classes of set size, and several blocks of a class
        monkeypatch.setattr(module, "BLOCK_BYTES", block_bytes)
    rng = random.Random(12)
    base, texts = [f"b{i}" for i in range(150)], []
    for _ in range(110):  # one component, similar to some of its members only, of several sizes
        copy = list(base[:rng.randint(100, 150)])
        for at in rng.sample(range(len(copy)), rng.randint(0, 4)):
            copy[at] = f"c{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 7 + texts[:3] + ["a b", "A  b", "a b c", "", None, " "]
    for i in range(40):
        own = [f"d{i}x{k}" for k in range(rng.randint(1, 40))]
        texts += [" ".join(own), " ".join(own[:-1] + ["e"]), " ".join(own + ["e"])]
    docs = [*enumerate(texts), (5, texts[5]), (5, texts[6]), (None, texts[0]), (None, "a b"), (None, None)]
    expected = links_by_brute_force(docs)
    assert max(n for _, n in expected) > 30
    assert links_found(spark, docs) == expected


@pytest.mark.parametrize("split", [None, 0, 70, 200])
def test_counts_by_short_and_long_lists(split):
    from gatesift.llm.link_counts import linked_weights
    rng = np.random.default_rng(3)
    core = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core[rng.random(300) < rng.choice([0.3, 0.85, 0.97])],
                                      rng.integers(0, 500, 12).astype(np.uint64)])) for _ in range(200)]
    weight = rng.integers(1, 9, 200)
    expected = [sum(int(weight[j]) for j in range(200) if i != j and (split is None or (i < split) != (j < split))
                    and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])))
                for i in range(200)]
    assert split in (0, 200) or max(expected) > 0
    assert linked_weights(sets, weight, split).tolist() == expected


def test_links_of_an_empty_table(spark):
    assert links_found(spark, []) == []


def test_sketches_differ_by_at_most_what_the_sets_differ_by():
    import pyarrow as pa

    from gatesift.llm.ngram_join import _sketches
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    sets = [np.unique(pool[rng.integers(0, k, n)]) for k, n in ((90, 80), (90, 70), (6000, 4000), (6000, 3000))]
    batch = pa.RecordBatch.from_pydict({"node": list(range(4)), "shingles": [x.tobytes() for x in sets]})
    drawn = [np.frombuffer(x, np.uint8) for x in next(_sketches(iter([batch])))["sketch"].to_pylist()]
    for a, x in zip(sets, drawn):
        for b, y in zip(sets, drawn):
            assert np.bitwise_count(x ^ y).sum(dtype=int) <= len(np.setxor1d(a, b))


def test_edges(spark):
    from pyspark.sql import functions as F
    long = " ".join(f"x{i % 977}y{i % 31}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B\n"), (6, "a b c"), (7, long),
            (8, long + " end"), (9, "one two three four five"), (9, "one two three four five"),
            (10, "a\u00a0b"), (None, "one two three four FIVE"), (None, "alone in this row of words"),
            (-3, "a b"), (11, "É b"), (12, "é b")]
    assert found(spark, docs, node=F.lit(1), n=F.lit("x"), root=F.lit(None)) == brute_force(docs)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_hashing_of_long_texts_matches_pieces():
    import gatesift.llm.shingles as module
    text = b" ".join(b"w%d" % (i % 5000) for i in range(30_000)) + b" " + b"z" * 5000
    whole = word_hashes(text)
    module._CHUNK, chunk = 1000, module._CHUNK
    try:
        assert np.array_equal(word_hashes(text), whole)
        assert [x.tolist() for x in shingle_sets([text, b"a b", b"", text])] == \
            [shingle_set(x).tolist() for x in (text, b"a b", b"", text)]
    finally:
        module._CHUNK = chunk


def test_probing_stops_or_counts():
    a = np.arange(1000, dtype=np.uint64)
    assert reaches(a, a) and reaches(a[:800], a) and not reaches(a[:799], a)
    assert not reaches(a + np.uint64(5000), a)


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components_of_paths_and_stars(spark, n):
    path = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(1, n)] + [(7, 7)]
    df = spark.createDataFrame(path, "a BIGINT, b BIGINT").repartition(4)
    got = {r.node: r.root for r in components(df).collect()}
    expected = {i: 0 for i in range(n + 1)} | ({1000 + i: 1000 for i in range(n)} if n > 1 else {})
    assert got == expected


@pytest.mark.parametrize("n", range(1, 7))
def test_chunks_of_few_words(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    long = [" ".join(f"{name}{i}" for i in range(90_000)).encode() for name in "xy"]  # each fills a chunk
    expected = shingle_sets([text.encode(), long[0]])[0].tolist()
    assert len(expected) == max(1, n - 4)
    assert shingle_sets([text.encode()])[0].tolist() == expected
    assert shingle_sets([long[0], text.encode(), long[1]])[1].tolist() == expected
    if n == 3:  # the only row of its table
        assert found(spark, [(1, text)]) == [("1", 1, "1")]
