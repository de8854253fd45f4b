"""The prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatesift.llm.prefix_trie import RangeMinimum, ordered_turns, prefix_trie, with_family_heads

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def plain_turns(rows):
    out = {}
    for c, t, r, x in rows:
        if c is not None:
            out.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(),
                                          x or ""))
    return {c: [(r, x) for *_, r, _, x in sorted(turns)] for c, turns in out.items()}


def plain_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(family, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for prefix in nodes:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)

    def subtree(prefix):
        stack, leaves, saved = [prefix], 0, 0
        while stack:
            p = stack.pop()
            leaves += p not in children
            saved += (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
            stack += children.get(p, [])
        return leaves, saved

    out = []
    for prefix, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(prefix))
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
                    len(children.get(prefix, [])), *subtree(prefix), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(rng, n):
    rows = []
    say = lambda: (rng.choice(["user", "assistant", "system", None, ""]),
                   rng.choice(["hi", "", None, "é" * 3, "why?", "long " * 40, "a", "b", "c"]))
    trunk = [say() for _ in range(30)]
    for c in range(n):
        own = c if c % 7 else c - 4000
        kind = rng.random()
        turns = trunk[:rng.randint(0, 30)] if kind < 0.4 else trunk[:2]
        turns = turns + [say() for _ in range(rng.randint(0 if turns else 1, 4))] if kind > 0.2 else turns
        for t, (r, x) in enumerate(turns):
            rows.append((own, rng.choice([t, t, None]) if kind > 0.9 else t, r, x))
    rows += rng.sample(rows, n // 10)
    rows += [(None, 1, "user", "hi"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("slice_turns", [500_000, 40])
def test_trie_equals_dictionaries(spark, slice_turns):
    rows = made(random.Random(8), 600)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "path": F.lit("x"), "t": F.lit(2)})
    turns = ordered_turns(df)
    own = plain_turns(rows)
    assert found(prefix_trie(turns, slice_turns)) == plain_trie(own)
    assert found(prefix_trie(with_family_heads(turns), slice_turns)) == plain_trie(plain_rebuilt(own))


def test_copies_and_one_very_long_conversation_over_slices(spark):
    rows = [(c, t, "user", f"{t}") for c in range(5000, 5300) for t in range(3)]
    rows += [(c, 0, "user", "0") for c in range(-50, 50)]
    rows += [(9000 + c, t, "user", f"{t}") for c in range(3) for t in range(500 + c)]
    rows += [(20_000 + c, 0, "user", f"only {c}") for c in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie(ordered_turns(df), 100)) == plain_trie(plain_turns(rows))


def test_empty_table_and_conversations_without_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(with_family_heads(ordered_turns(none))).count() == 0
    long_head = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    df = spark.createDataFrame([(long_head, 1, None, None)], SCHEMA)  # five turns of no conversation
    ends = hashlib.sha256(str(long_head).encode()).hexdigest()
    assert found(prefix_trie(with_family_heads(ordered_turns(df)))) == [(long_head, 0, None, 1, 0, 1, 0, ends)]


def test_extents_are_where_the_minimum_falls_below():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 100):
        lcp = rng.integers(0, 5, n)
        lcp[0] = -1
        rows, depths = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(6)))
        table = RangeMinimum(lcp)
        left, right = table.extents(rows, depths)
        for i, d, l, r in zip(rows, depths, left, right):
            while i > 0 and lcp[i] >= d:
                i -= 1
            assert l == i
        for i, d, r in zip(rows, depths, right):
            while i + 1 < n and lcp[i + 1] >= d:
                i += 1
            assert r == i
        assert (table.of(left, right) == [lcp[l:r + 1].min() for l, r in zip(left, right)]).all()
