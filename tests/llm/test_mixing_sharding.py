"""Mixing and sharding against plain Python."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatesift.llm.mixing import mix_sources, mixed_rows, source_targets, split_quotas, words_of
from gatesift.llm.sharding import shard_records, write_shards

SIZED = "doc_id BIGINT, source STRING, size BIGINT, target STRING"


def expected_targets(sizes, weights=(1, 2, 3)):
    """Reshare the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return target | {s: 3.0 * sizes[s] for s in capped}
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"b": 100, "a": 100, None: 100}, {"a": 1, "b": 5, "c": 1000, "d": 0}, {"a": 0, "b": 0}, {"x": 7},
    {f"s{i}": (i * 37) % 101 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source STRING, source_size BIGINT")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(expected_targets(sizes))


def test_mix_takes_exactly_the_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 9 == 0 else f"s{i % 5}" if i % 3 else "hot", int(rng.integers(0, 400)), "x")
            for i in range(600)] + [(5, "s1", 77, "x")] * 3 + [(None, "s1", 9, "x"), (900, "s2", 60_000, "x")]
    df = spark.createDataFrame(rows, SIZED)
    mixed = mix_sources(df, shards=7, block_words=100)
    taken_words = F.expr("aggregate(pieces, 0L, (s, p) -> s + p.n_words)")
    out = mixed.withColumn("taken", taken_words).collect()
    assert len(out) == len(rows) and mixed.columns.count("target") == 1
    taken = Counter()
    for r in out:
        assert r.taken <= 3 * r.size
        assert r.taken == sum(p.n_words for p in r.pieces)
        assert all(0 < p.n_words <= 100 and p.from_word + p.n_words <= r.size for p in r.pieces)
        taken[r.source] += r.taken
    targets = {r.source: r.target for r in out}
    sizes = Counter()
    for r in rows:
        sizes[r[1]] += r[2]
    assert targets == pytest.approx(expected_targets(dict(sizes)))
    assert taken == {s: round(t) for s, t in targets.items()}
    # a block goes to one shard, and no two source blocks share words
    blocks = {}
    for r in out:
        for p in r.pieces:
            assert blocks.setdefault((r.source, p.block), (p.shard, p.slot_key)) == (p.shard, p.slot_key)
    again = mix_sources(df.repartition(3), shards=7, block_words=100).withColumn("taken", taken_words)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def mix_input(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"s{i % 3}" if i % 2 else "hot", int(rng.integers(0, 300))) for i in range(500)]
    return spark.createDataFrame(rows, "doc_id BIGINT, source STRING, size BIGINT")


def blocks_of(rows):
    """{(shard, source): number of blocks} of a mix whose blocks have 64 words."""
    blocks = {(r.shard, r.row.source, r.slot_key) for r in rows}
    return Counter((shard, source) for shard, source, _ in blocks)


def test_shards_hold_the_blocks_that_the_tree_deals(spark, monkeypatch):
    from gatesift.llm import mixing
    df = mix_input(spark)
    rows = mixed_rows(df, shards=6, block_words=64).collect()
    sizes = df.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = {r.source: round(r.target) for r in source_targets(sizes).collect()}
    names = sorted(targets)
    quotas = [-(-targets[s] // 64) for s in names]
    dealt = split_quotas(spark.createDataFrame([(quotas,)], "quotas ARRAY<BIGINT>"), 6).collect()
    assert blocks_of(rows) == Counter({(r.shard, s): n for r in dealt for s, n in zip(names, r.quotas) if n})
    taken = Counter()
    for r in rows:
        taken[r.row.source] += r.n_words
    assert taken == targets
    # rows come by shard and block, blocks of all sources among each other
    keys = [(r.shard, r.slot_key) for r in rows]
    assert keys == sorted(keys)
    first = [r.row.source for r in rows if r.shard == 0]
    assert len({s for s in first[:len(first) // 3]}) == len(set(first))
    # another deal gives another mix, and one that leaves blocks out leaves out their words
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, seed: split_quotas(q, n, seed).withColumn(
        "quotas", F.expr("if(shard = 5, transform(quotas, x -> 0L), quotas)")))
    fewer = mixed_rows(df, shards=6, block_words=64).collect()
    assert sum(r.n_words for r in fewer) < sum(targets.values()) and blocks_of(fewer) != blocks_of(rows)


def test_columns_named_like_working_ones_stay(spark):
    df = mix_input(spark).selectExpr("*", "doc_id AS __key", "'p' AS __part", "1 AS __group", "2 AS shard", "3 AS row")
    out = mix_sources(df).collect()
    assert all(r["__key"] == r.doc_id and r["__part"] == "p" and r["__group"] == 1 and r.shard == 2 for r in out)
    assert all(r.row["__key"] == r.row.doc_id and r.row.row == 3 for r in mixed_rows(df).collect())


def test_words_of_a_piece(spark):
    text = " one\ttwo\n\nthree  four "
    df = spark.createDataFrame([(text, 4, f, n) for f, n in ((0, 4), (0, 2), (2, 2), (1, 1))],
                               "text STRING, size INT, f INT, n INT")
    got = [r[0] for r in df.select(words_of(*(F.col(c) for c in ("text", "size", "f", "n")))).collect()]
    assert got == [text, " one\ttwo", "\n\nthree  four", "\ttwo"]


def test_mix_without_rows_or_words(spark):
    assert mix_sources(spark.createDataFrame([], SIZED)).collect() == []
    none = mix_sources(spark.createDataFrame([(1, None, 0, "x"), (2, "a", 0, "x")], SIZED)).collect()
    assert [(r.target, r.pieces) for r in none] == [(0.0, []), (0.0, [])]


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_splitting_tree_is_exact_and_random(spark, shards):
    quotas = [0, 1, 40, 1000, 12345]
    df = spark.createDataFrame([(quotas,)], "quotas ARRAY<BIGINT>")
    leaves = np.array([r.quotas for r in split_quotas(df, shards).orderBy("shard").collect()])
    assert leaves.shape == (shards, 5) and (leaves >= 0).all()
    assert leaves.sum(0).tolist() == quotas
    assert leaves.sum(1).max() - leaves.sum(1).min() <= shards
    if shards == 16:  # the spread of hypergeometric draws: not even, and not far from it
        own, n = leaves[:, 4], sum(quotas)
        deviation = (n / 16 * (12345 / n) * (1 - 12345 / n) * 15 / 16) ** 0.5
        assert 0.4 * deviation < own.std() < 2 * deviation


def test_left_draw_has_the_hypergeometric_mean_and_spread(spark):
    draws = [split_quotas(spark.createDataFrame([([30, 70],)], "quotas ARRAY<BIGINT>"), 2, seed)
             .where("shard = 0") for seed in range(40)]
    union = draws[0]
    for d in draws[1:]:
        union = union.union(d)
    left = np.array([r.quotas for r in union.collect()])
    assert (left.sum(1) == 50).all()
    assert abs(left[:, 0].mean() - 15) < 1.2 and 1.2 < left[:, 0].std() < 3.5


def test_shards(spark, tmp_path):
    texts = [None, "", "a", "a", "ä" * 50] + [f"text {i}" for i in range(200)]
    records = spark.createDataFrame([(i if i != 7 else None, t, "x") for i, t in enumerate(texts)]
                                    + [(3, "a", "x")] * 2, "doc_id BIGINT, text STRING, shard STRING")
    out = shard_records(records, ["doc_id", "text"], 13, bucket_rows=30)
    rows = out.collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(v) for v in slots.values()]
    assert len(slots) == 13 and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == \
        sorted((str(r.doc_id), str(r.text)) for r in records.collect())
    again = shard_records(records.repartition(4), ["doc_id", "text"], 13, bucket_rows=30).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    ids = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.3
    write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_fewer_records_than_shards(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id BIGINT, text STRING")
    assert sorted((r.shard, r.slot) for r in shard_records(records, ["doc_id"], 40).collect()) == [(0, 0), (1, 0)]
    assert shard_records(records.limit(0), ["doc_id"], 40).collect() == []


def test_query_values_of_shards(spark):
    from conftest import TESTDATA
    from gatesift.llm.queries import op8_sharding
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    for r in op8_sharding(spark, TESTDATA).where(F.col("law") == "rows").collect():
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
        assert r.grown_shard is None


def test_shards_hold_the_texts(spark):
    from conftest import TESTDATA
    from gatesift.llm.queries import op8_sharding
    out = op8_sharding(spark, TESTDATA)
    files = spark.read.option("basePath", out.inputFiles()[0].split("/shard=")[0]).parquet(*out.inputFiles())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    rows = files.collect()
    assert {r.doc_id: r.text for r in rows} == texts
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in out.collect())


def test_positions_over_many_buckets_and_shards_over_many_files(spark, tmp_path, monkeypatch):
    from gatesift.llm import sharding
    monkeypatch.setattr(sharding, "RANGE_BUCKETS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    records = spark.createDataFrame([(i % 150 if i % 9 else None, None if i % 7 == 0 else f"t{i}") for i in range(600)],
                                    "doc_id BIGINT, text STRING").repartition(4)
    out = shard_records(records, ["doc_id", "text"], 5, bucket_rows=25)
    rows = out.collect()
    for shard in range(5):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(120))
    write_shards(out, str(tmp_path / "shards"))
    files = list((tmp_path / "shards/shard=3").glob("*.parquet"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert len(files) > 1 and sorted(map(str, back.select(out.columns).collect())) == sorted(map(str, rows))
    for file in files:  # each in slot order
        slots = [r.slot for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_equal_rows_nulls_and_no_rows_are_written(spark):
    from gatesift.llm.sharding import written_shards
    records = spark.createDataFrame([(1, "a")] * 30 + [(None, None)] * 20 + [(2, "")] * 10, "doc_id BIGINT, text STRING")
    rows = written_shards(shard_records(records, ["doc_id", "text"], 7, bucket_rows=9)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str(tuple(r)) for r in records.collect())
    assert sorted((r.shard, r.slot) for r in rows) == sorted((i % 7, i // 7) for i in range(60))
    assert written_shards(shard_records(records.limit(0), ["doc_id", "text"], 7)).collect() == []


def test_equal_records_and_large_ones_spread_over_buckets(spark):
    from gatesift.llm.sharding import _numbered, shuffle_records
    records = spark.createDataFrame([(1, "a")] * 300 + [(i, "b" * 1000) for i in range(2, 300)],
                                    "doc_id BIGINT, text STRING").repartition(3)
    assert sorted(r["__copy"] for r in _numbered(records, ["doc_id", "text"], 1).where("doc_id = 1").collect()) == list(range(300))
    rows = shuffle_records(records, ["doc_id", "text"], bucket_bytes=10_000).collect()
    assert sorted(r.position for r in rows) == list(range(598))
    at = sorted(r.position for r in rows if r.doc_id == 1)
    assert np.diff(at).max() < 60 and at[0] < 60 and at[-1] > 540
