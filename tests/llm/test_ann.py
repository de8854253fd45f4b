"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from gatesift.llm.ann import _hadamard, codes, nearest_neighbours, probed, probes_to_reach, sharpness

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, class STRING, score INT"


def brute_force(rows, k=10):
    out = {}
    for q, x, *_ in rows:
        if q % 100:
            continue
        near = sorted((float(np.sqrt(((np.array(y) - np.array(x)) ** 2).sum())), v) for v, y, *_ in rows if v != q)
        out[q] = near[:k]
    return out


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet(f"{TESTDATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    expected, got = brute_force(rows), {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = sum(len({v for _, v in got[q]} & {v for _, v in near}) for q, near in expected.items())
    assert hits >= 0.9 * 10 * len(expected)
    assert all(len(v) == 10 and v == sorted(v) for v in got.values())


def test_probes_are_raised_to_what_recall_needs(spark, monkeypatch):
    import gatesift.llm.ann as module
    monkeypatch.setattr(module, "plan", lambda rows, *_: (2, 1))  # far too few
    df = spark.read.parquet(f"{TESTDATA}/embeddings.parquet")
    expected, hits = brute_force([(r.vec_id, r.embedding) for r in df.collect()]), 0
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        hits += r.vec_id in {v for _, v in expected[r.query_id]}
    assert hits >= 0.95 * 10 * len(expected)


@pytest.mark.parametrize("functions", [1, 2, 3])
def test_probes_to_reach_a_code(functions):
    x = np.random.default_rng(2).normal(size=(6, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.stack([unit[[1, 2, 3]]] * 6)
    sharp = sharpness(0.5, 8)
    needed = probes_to_reach(unit, near, 3, functions, sharp)
    table, code = probed(unit, 3, functions, 16 ** functions, sharp)
    order = [list(zip(*pair)) for pair in zip(table.tolist(), code.tolist())]
    for row in range(6):
        for n, other in enumerate((1, 2, 3)):
            places = [order[row].index((t, codes(unit[other:other + 1], t, functions, 1)[0][0, 0])) for t in range(3)]
            assert needed[row, n] == min(places) + 1


def test_probed_codes_lose_least_in_all_tables():
    x = np.random.default_rng(4).normal(size=(50, 8))
    x[0] = [9, 0, 0, 0, 0, 0, 0, 0]
    unit, sharp = x / np.linalg.norm(x, axis=1, keepdims=True), sharpness(0.5, 8)
    every = [codes(unit, t, 2, 16 ** 2, sharp) for t in range(6)]  # all codes of all tables
    for probes in (1, 3, 40, 256):
        table, code = probed(unit, 6, 2, probes, sharp)
        for row in range(50):
            loss = sorted(v for _, lack in every for v in lack[row])
            of = {(t, c): v for t, (own, lack) in enumerate(every) for c, v in zip(own[row], lack[row])}
            picked = list(zip(table[row], code[row]))
            assert len(set(picked)) == probes * 6
            assert [of[p] for p in picked] == pytest.approx(loss[:probes * 6])


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=6).tolist(), "x", 1) for i in range(60)]
    vectors += [(1000 + i, [1.0, 2, 3, 4, 5, 6], "x", 1) for i in range(250)]  # a large class with queries
    vectors += [(2000, [2.0, 4, 6, 8, 10, 12], "x", 1), (2001, [0.5, 1, 1.5, 2, 2.5, 3], "x", 1)]
    bad = [(300, None, "x", 1), (400, [0.0] * 6, "x", 1), (500, [1.0, None, 1, 1, 1, 1], "x", 1),
           (600, [1.0, float("nan"), 1, 1, 1, 1], "x", 1), (700, [float("inf"), 1.0, 1, 1, 1, 1], "x", 1),
           (800, [1.0], "x", 1), (None, [1.0] * 6, "x", 1), (801, [], "x", 1)]
    rows = [(i, v and [x if x is None else float(x) for x in v], *r) for i, v, *r in vectors + bad + vectors[:3]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0, probes=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    expected = brute_force(vectors)
    assert set(got) == set(expected)
    for q, near in expected.items():
        assert [v for _, v in got[q]] == [v for _, v in near]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in near])


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_fewer_rows_than_neighbours(spark, n):
    rows = [(100 * i, [float(i + 1), 1.0], "x", 1) for i in range(n)]
    out = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()
    assert len(out) == n * max(0, n - 1)


def test_rotations_keep_lengths_and_codes_are_nearest_first():
    x = np.random.default_rng(1).normal(size=(20, 16))
    assert np.allclose((_hadamard(x) ** 2).sum(1), (x ** 2).sum(1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    (one, _), (many, lack) = codes(unit, 3, 2, 1), codes(unit, 3, 2, 30)
    assert (many[:, :1] == one).all() and (np.diff(lack) >= 0).all() and all(len(set(r)) == 30 for r in many.tolist())
