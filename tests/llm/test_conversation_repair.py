"""Conversation repair against plain Python."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gatesift.llm import conversation_repair as R
from gatesift.llm.queries import op13_conversation_repair

WANTED, NEXT = "uuau", (2, 2, 3, 2)
BLANKS = " \t\n\x0b\f\r"


def least(codes, start=0, ends=(0, 3)):
    """(cost, audit) from the last turn to the first, one state after another."""
    after = None
    for i in range(len(codes), -1, -1):
        now = {s: ((0, "") if s in ends else None) if i == len(codes) else None for s in range(4)}
        if i < len(codes):
            code, role = codes[i], codes[i].lower()
            for s in range(4):
                options = [(3, "D", s)]
                if code != "x":
                    t = int(code.isupper())
                    options += [(t, "K", 1)] if role == "s" and s == 0 else []
                    options += [(t, "K", NEXT[s])] if role == WANTED[s] else [(2 + t, "R", NEXT[s])]
                now[s] = min(((c + after[to][0], letter + after[to][1]) for c, letter, to in options if after[to]),
                             default=None)
        for _ in range(4):  # inserts
            for s in range(4):
                if now[NEXT[s]]:
                    option = (2 + now[NEXT[s]][0], "I" + now[NEXT[s]][1])
                    now[s] = min(option, now[s] or option)
        after = now
    return after[start]


def test_search_equals_every_other_way():
    rng = random.Random(1)
    cases = ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    cases += ["", "x", "xxxx", "s", "S", "ss", "aaaa", "uuuu", "sua", "suaua" * 20, "o" * 40, "aX".lower() * 30]
    for codes in cases:
        for start, ends in [(0, (0, 3)), *itertools.product(range(4), [(0,), (1,), (2,), (3,)])]:
            assert R.cheapest(codes, start, ends) == least(codes, start, ends), (codes, start, ends)


def test_least_way_equals_all_ways_of_short_ones():
    def ways(codes, state, budget):
        if not codes and state in (0, 3):
            yield 0, ""
        if budget >= 2:
            for c, a in ways(codes, NEXT[state], budget - 2):
                yield c + 2, "I" + a
        if codes:
            for letter, cost, after in R._READS[codes[0]][state]:
                if cost <= budget:
                    for c, a in ways(codes[1:], after, budget - cost):
                        yield c + cost, letter + a
    for codes in map("".join, itertools.product("suaoAx", repeat=3)):
        assert min(ways(codes, 0, 9)) == R.cheapest(codes, 0, (0, 3)), codes


def test_parts_chain_to_the_whole():
    rng = random.Random(2)
    for _ in range(150):
        codes = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(1, 30)))
        cuts = sorted(rng.randrange(len(codes) + 1) for _ in range(rng.randint(0, 4)))
        pieces = [codes[i:j] for i, j in zip([0, *cuts], [*cuts, len(codes)])]
        parts = [[R.cheapest(p, s, (t,)) for s in range(4) for t in range(4)] for p in pieces]
        assert R.chain(parts) == least(codes)


def plain(rows):
    """{conv_id: result} of rows (conv_id, turn, role, text) after damage."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        turns = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv_id]
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, codes, seen = [], "", set()
        for _, role, text in turns:
            solid = text.rstrip(BLANKS)
            fault = ("blank" if not solid else "duplicate" if (role, text) in seen
                     else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
            faults.append(fault)
            code = role[0] if role and role[0] in "sua" else "o"
            codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        cost, audit = least(codes)
        initials = [r[1][:1] for r in turns]
        numbers = {r[0] for r in turns} - {None}
        left, state, unread = [], 0, iter(turns)
        for letter in audit:
            turn = None if letter == "I" else next(unread)
            if letter == "D":
                continue
            role = turn[1] if letter == "K" else {"u": "user", "a": "assistant"}[WANTED[state]]
            left.append(f"{role}:{turn[2] if turn else ''}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out[conv_id] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def made(rng, n, hot=0):
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "s", "unknown"]
    texts = ["Yes.", "No!", "what", "", None, " \n", "Why? \t", "ok.", "é", "x." * 50]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            turn = rng.choice([t, t, t, t + 2, None])
            rows.append((c if c else None, turn, role, rng.choice(texts)))
    rows += [(n + 5, t if t % 50 else None, rng.choice(roles), rng.choice(texts) or f"say {t}.") for t in range(hot)]
    rows += rng.sample(rows, n // 2)
    rng.shuffle(rows)
    return rows


def found(spark, rows, slices):
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    df = df.withColumns({"slice": F.lit("x"), "audit": F.lit(1), "n": F.lit(2), "c": F.lit(3)})
    diagnosis = R.diagnose(df, slices)
    repaired = R.repaired_rows(df, diagnosis)
    digests = {r.conv_id: r.repaired_sha256 for r in R.repaired_digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                        digests.get(r.conv_id, empty)) for r in diagnosis.collect()}


@pytest.mark.parametrize("slices", [None, 13])
def test_diagnosis_and_repair_equal_plain_python(spark, slices):
    rows = made(random.Random(5), 60, hot=400)  # one conversation lies in most slices
    assert found(spark, rows, slices) == plain(rows)


def test_copies_of_one_turn_and_very_long_texts(spark):
    rows = [(1, 0, "user", "hello there")] * 300 + [(1, 1, "assistant", "word " * 300_000 + ".")]
    rows += [(2, None, "user", "a.")] * 3 + [(2, None, "assistant", "b.")]
    assert found(spark, rows, 4) == plain(rows)


def test_empty_table_and_empty_conversations(spark, tmp_path):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    none = spark.createDataFrame([], schema)
    assert R.diagnose(none).count() == 0
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_conversation_repair(spark, str(tmp_path)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (None, None, None, None), (7, 1, "user", "Here.")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/conversations.parquet")
    out = {r.conv_id: tuple(r)[1:] for r in op13_conversation_repair(spark, f"{tmp_path}/some").collect()}
    assert out[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(out) == {dropped, None, 7}


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in
            [(0, "system", "Be. Kind!"), (1, "user", "Hi?"), (None, None, None), (2, "assistant", "Yo")]]
    expected = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if fate == 1 else x.translate(str.maketrans("", "", ".!?")) if fate == 2 else x
        expected += [(c, t, "user" if fate == 4 else r, x)] * (fate != 0) * (1 + (fate == 3))
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    assert sorted(map(str, map(tuple, R.damaged(df).collect()))) == sorted(map(str, expected))
