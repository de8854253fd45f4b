"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import TESTDATA
from gatesift.llm import simhash
from gatesift.llm.queries import REGISTRY
from gatesift.llm.simhash import fingerprint, similar_fingerprints, simhash_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values):
    """The least position connected to each value by links of at most 3 bits."""
    values = np.array(values, np.uint64)
    label = np.arange(len(values))
    while True:
        before = label.copy()
        for i, v in enumerate(values):
            near = np.bitwise_count(values ^ v) <= 3
            label[near] = label[near].min()
        if (before == label).all():
            return label


def brute_force(docs):
    prints = [plain_fingerprint(t) for _, t in docs]
    label = classes(prints)
    least = {}
    for (d, _), c in zip(docs, label):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    return sorted((str(d), f"{p:016x}", str(least[c])) for (d, _), p, c in zip(docs, prints, label))


def found(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_components(df).collect())


def test_fingerprints_of_whole_texts(monkeypatch):
    texts = [None, "", " \t\n", "One", "one two", "A b C", "É x y z Ärger", "a a a a a a", "x " * 700 + "y"]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "_AT_ONCE", 100)  # a text in several parts
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert fingerprint("One\x0bTWO  three") == fingerprint("one two three") != fingerprint("one two three four")


def test_components_equal_all_pairs(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = [None, None, "", "one", "One", "a b", "a b c"]
    for size in (5, 20, 60, 200, 400):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = list(enumerate(texts)) + [(3, "one"), (None, texts[-1]), (None, "nothing like it here at all")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    df = df.withColumns({"fingerprint": F.lit("x"), "component_id": F.lit(7), "fp": F.lit(1)})
    assert found(df.repartition(5)) == brute_force(docs)


def bits(rng, n):
    return sum(1 << b for b in rng.sample(range(64), n))


@pytest.mark.parametrize("block", [256, 4])
def test_links_equal_all_pairs_in_sparse_and_dense_groups(spark, monkeypatch, block):
    rng = random.Random(3)
    values = {0, 7, 2**64 - 1}
    for _ in range(40):  # chains and pairs around the limit, in all places
        v = rng.getrandbits(64)
        values |= {v, v ^ bits(rng, 3), v ^ bits(rng, 4), v ^ bits(rng, 2) ^ bits(rng, 2)}
    for spread in ((0, 1, 40, 41, 42, 60, 61), range(32, 64, 4), range(3, 30, 4)):  # dense groups
        v = rng.getrandbits(64)
        for _ in range(90):
            values.add(v ^ sum(1 << b for b in spread if rng.random() < 0.4))
    values = sorted(values)
    monkeypatch.setattr(simhash, "BLOCK", block)
    indexed = np.array(values, np.uint64)
    links = in_this_process(indexed)
    label = classes(values)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    place = {v: i for i, v in enumerate(values)}
    for a, b in links:
        assert (a ^ b).bit_count() >= 1
        root[find(place[a])] = find(place[b])
    mine = [find(i) for i in range(len(values))]
    assert len({*zip(mine, label)}) == len(set(mine)) == len(set(label.tolist()))
    assert len(links) < len(values) * (64 if block == 256 else 64 * 32)  # stars, not all pairs
    if block == 256:
        df = spark.createDataFrame([(int(np.int64(np.uint64(v))),) for v in values], "fp BIGINT")
        roots = {r.node % 2**64: r.root % 2**64 for r in similar_fingerprints(df).collect()}
        mine = [roots.get(v, v) for v in values]
        assert len({*zip(mine, label)}) == len(set(mine)) == len(set(label.tolist()))


def in_this_process(values, batch=37):
    """The links that the stages give, run in order without Spark."""
    import pyarrow as pa

    def sort(batches):
        rows = pa.Table.from_batches(batches)
        if "a" in rows.column_names:
            rows = pa.table({"fp": rows["a"], "key": rows["key"]})
        fp, key = (rows[c].to_numpy().view(t) for c, t in (("fp", np.uint64), ("key", np.int64)))
        order = np.lexsort((fp, key))
        pairs = sorted(set(zip(key[order].tolist(), fp[order].tolist())), key=lambda p: (p[0], p[1]))
        for at in range(0, len(pairs), batch):
            k, f = zip(*pairs[at:at + batch])
            yield pa.RecordBatch.from_pydict({"fp": pa.array(np.array(f, np.uint64).view(np.int64)),
                                              "key": pa.array(np.array(k, np.int64))})

    given = pa.RecordBatch.from_pydict({"fp": pa.array(values.view(np.int64))})
    first = pa.Table.from_batches(list(simhash._links(True)(sort(list(simhash._variants([given]))))))
    dense = first.filter(pa.compute.is_null(first["b"]))
    out = first.filter(pa.compute.is_valid(first["b"]))
    if dense.num_rows:
        out = pa.concat_tables([out, pa.Table.from_batches(list(simhash._links(False)(sort(dense.to_batches()))))])
    return [(a % 2**64, b % 2**64) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    out = simhash_components(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    out = REGISTRY["op12_simhash"](spark, TESTDATA).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == brute_force(docs)
