"""Conversation repair: the cheapest edits that make a damaged conversation well formed again.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?`` and no turn is
blank or said before. Keeping a turn costs 0, giving it the role user or assistant 2, deleting it
3 (a must for blank and repeated turns), an inserted empty turn of user or assistant 2; a truncated
turn that isn't deleted adds 1.

The edits are paths through a lattice: a node is (turns read, state of the pattern), an edge an
edit. A bidirectional Dijkstra runs a heap forward from the start and one in reverse from the ends;
each settles whole levels of equal cost, so when the levels add up to more than the cheapest
crossing, every node of every cheapest path is settled from one side at least. Of all crossings of
that cost, the walk picks the least concatenated audit (the initials of the edits in order): at
each node the least letter that still leads over such a crossing.

How it runs on Spark:

* Only narrow rows (turn, role, digest of the text, flags) are diagnosed. Equal rows of a
  conversation are counted before they are shuffled; the first of repeated turns is a combinable
  minimum joined back.
* The rows are range-partitioned by conversation and turn, so a conversation of a third of all rows
  is cut into slices. A conversation that lies inside a slice is solved there. The first and last of
  a slice may go on elsewhere: they give the cheapest audit from each state to each, and these are
  chained, at most two a slice. Equal-cost audits to one node never start with one another, so
  chaining the least ones gives the least.
* Texts move once, behind their conversation's audit, and are read as a stream. An audit is one
  value of a letter a turn, and a digest over a whole text can't be computed in parts: these two
  results, not the search, are what one task per conversation is needed for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import stored

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
STATES = 4                      # nothing yet, system, user, assistant
_WANTED = "uuau"                # what the pattern asks for after each state
_NEXT = (2, 2, 3, 2)
_ROLES = {"u": "user", "a": "assistant"}
_GONE = "x"                     # code of a turn that must be deleted
_INFINITE = float("inf")
_BLANKS = " \t\n\x0b\f\r"


# ------------------------------------------------------------------ the search

def _reads(code: str) -> list[list[tuple[str, int, int]]]:
    """From each state, the edits that read a turn of this code: (letter, cost, next state)."""
    out = []
    for state in range(STATES):
        edits = [("D", DELETE, state)]
        if code != _GONE:
            extra = TRUNCATED if code.isupper() else 0
            role = code.lower()
            if role == "s" and state == 0:
                edits.append(("K", extra, 1))
            if role == _WANTED[state]:
                edits.append(("K", extra, _NEXT[state]))
            else:
                edits.append(("R", REROLE + extra, _NEXT[state]))
        out.append(edits)
    return out


_READS = {code: _reads(code) for code in "suaoSUAO" + _GONE}
_UNREADS = {code: [[(cost, before) for before in range(STATES) for _, cost, after in edits[before]
                    if after == state] for state in range(STATES)] for code, edits in _READS.items()}


class _Side:
    """One of the two searches: costs of the nodes seen, and which are settled."""

    def __init__(self, sources, neighbours):
        self.cost = dict.fromkeys(sources, 0)
        self.heap = [(0, node) for node in sorted(sources)]
        self.settled: set[tuple[int, int]] = set()
        self.neighbours = neighbours

    def level(self) -> float:
        while self.heap and self.heap[0][1] in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else _INFINITE

    def settle(self, other: _Side, best: float) -> float:
        """Settle all nodes of the cheapest level; the cost of the best crossing known."""
        level = self.level()
        while self.level() == level:
            cost, node = heappop(self.heap)
            self.settled.add(node)
            best = min(best, cost + other.cost.get(node, _INFINITE))
            for extra, near in self.neighbours(node):
                if cost + extra < self.cost.get(near, _INFINITE):
                    self.cost[near] = cost + extra
                    heappush(self.heap, (cost + extra, near))
        return best


def cheapest(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from one state to one of others, ties ASCII-least.

    ``codes`` has a letter a turn: the initial of its role (o: another one), upper case if the
    turn is truncated, or x if it must go. None if no edits lead there.
    """
    n = len(codes)

    def edges(node):
        i, state = node
        if i < n:
            for letter, cost, after in _READS[codes[i]][state]:
                yield letter, cost, (i + 1, after)
        yield "I", INSERT, (i, _NEXT[state])

    def before(node):
        i, state = node
        if i:
            for cost, was in _UNREADS[codes[i - 1]][state]:
                yield cost, (i - 1, was)
        for was in range(STATES):
            if _NEXT[was] == state:
                yield INSERT, (i, was)

    first, last = (0, start), {(n, s) for s in ends}
    ahead = _Side([first], lambda node: ((cost, near) for _, cost, near in edges(node)))
    back = _Side(last, before)
    best = _INFINITE
    while ahead.level() + back.level() <= best:
        if min(ahead.level(), back.level()) == _INFINITE:
            break
        nearer, other = (ahead, back) if ahead.level() <= back.level() else (back, ahead)
        best = nearer.settle(other, best)
    if best == _INFINITE:
        return None

    # tails of all crossings of the best cost, and what leads to them at no more than they cost
    useful = [u for u in ahead.settled if ahead.cost[u] + back.cost.get(u, _INFINITE) == best
              or any(v in back.settled and ahead.cost[u] + cost + back.cost[v] == best for _, cost, v in edges(u))]
    leads = set(useful)
    while useful:
        v = useful.pop()
        for cost, u in before(v):
            if u in ahead.settled and u not in leads and ahead.cost[u] + cost == ahead.cost[v]:
                leads.add(u)
                useful.append(u)

    node, spent, audit = first, 0, []
    while not (node in last and spent == best):
        letter, cost, node = min(
            (letter, cost, v) for letter, cost, v in edges(node)
            if (v in back.settled and spent + cost + back.cost[v] == best)
            or (v in leads and spent + cost == ahead.cost[v]))
        audit.append(letter)
        spent += cost
    return best, "".join(audit)


@lru_cache(maxsize=4096)
def _known(codes: str) -> tuple[int, str]:
    return cheapest(codes, 0, (0, 3))


def whole(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; those of few turns are remembered."""
    return _known(codes) if len(codes) <= 32 else cheapest(codes, 0, (0, 3))


def chain(parts: list[list[tuple[int, str] | None]]) -> tuple[int, str]:
    """(cost, audit) over consecutive parts, each with its answers from state to state."""
    reached: list[tuple[int, str] | None] = [(0, "")] + [None] * (STATES - 1)
    for part in parts:
        reached = [min(((was[0] + step[0], was[1] + step[1]) for state, was in enumerate(reached)
                        if was and (step := part[STATES * state + after])), default=None)
                   for after in range(STATES)]
    return min(x for x in (reached[0], reached[3]) if x)


# -------------------------------------------------------------------- diagnosis

def _solid(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" "))


def _narrow(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, code and number of equal turns; a row each different turn."""
    solid = _solid(_text("text"))
    initial = F.substring(_text("role"), 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.right(solid, F.lit(1)).isin(".", "!", "?"), code).otherwise(F.upper(code))
    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        _text("role").alias("role"), F.md5(_text("text").cast("binary")).alias("digest"),
                        F.when(solid == "", "b").otherwise(code).alias("code"))
            .groupBy("conv_id", "turn", "role", "digest", "code").agg(F.count("*").alias("n")))


def _with_repeats(turns: DataFrame) -> DataFrame:
    """Add ``again``: the role and text were there in an earlier turn."""
    first = (turns.groupBy("conv_id", "role", "digest")
             .agg(F.min("turn").alias("least"), F.count("*").alias("turns"),
                  F.count_if(F.col("turn").isNull()).alias("unnumbered"))
             .where("turns > 1")
             .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
                     F.when(F.col("unnumbered") == 0, F.col("least")).alias("least")))
    same = (F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
            & (F.col("digest") == F.col("d")))
    again = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("least"))
    return turns.join(first, same, "left").withColumn("again", again).drop("c", "r", "d", "least")


_PART = ("conv_id long, slice int, blank long, duplicate long, truncated long, illegal long, first string, "
         "last string, low long, high long, turns long, cost long, audit string, costs array<long>, "
         "audits array<string>")
_NAMES = [f.split()[0] for f in _PART.split(", ")]


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _PART.split(", ")])


def _part(conv_id, turns: list[tuple], slice_no: int, whole_run: bool) -> dict:
    """What a run of consecutive turns of a conversation tells, and its cheapest edits."""
    blank = duplicate = truncated = illegal = 0
    codes, initials, numbers = [], [], set()
    for turn, role, code, n, again in turns:
        if code == "b":
            blank += n
        elif again:
            duplicate += n
        else:
            duplicate += n - 1
            truncated += code.isupper()
        codes.append(_GONE * n if code == "b" or again else code + _GONE * (n - 1))
        initials.append((role[:1], n))
        numbers.add(turn)
    numbers.discard(None)
    for k, (initial, n) in enumerate(initials):
        illegal += n - 1
        if k and initials[k - 1][0] + initial not in ("su", "ua", "au"):
            illegal += 1
    out = dict(conv_id=conv_id, slice=slice_no, blank=blank, duplicate=duplicate, truncated=truncated,
               illegal=illegal, first=initials[0][0], last=initials[-1][0], low=min(numbers, default=None),
               high=max(numbers, default=None), turns=len(numbers),
               cost=None, audit=None, costs=None, audits=None)
    codes = "".join(codes)
    if whole_run:
        out["cost"], out["audit"] = whole(codes)
    else:
        answers = [cheapest(codes, start, (end,)) for start in range(STATES) for end in range(STATES)]
        out["costs"] = [a and a[0] for a in answers]
        out["audits"] = [a and a[1] for a in answers]
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a sorted slice: the first and last may go on in another slice."""
    slice_no = TaskContext.get().partitionId()
    schema = _arrow_schema()

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist()
                             for c in ("conv_id", "turn", "role", "code", "n", "again")))

    out, waiting, first = [], None, True
    for conv_id, run in groupby(rows(), key=lambda r: r[0]):
        if waiting is not None:
            out.append(_part(*waiting, slice_no, not first))
            first = False
        waiting = conv_id, [r[1:] for r in run]
        if len(out) >= 2048:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if waiting is not None:
        out.append(_part(*waiting, slice_no, False))
    yield pa.RecordBatch.from_pylist(out, schema)


_SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string")


def _chained(rows: pa.Table) -> pa.Table:
    """One conversation's parts in the order of their slices, as one."""
    parts = sorted(rows.to_pylist(), key=lambda p: p["slice"])
    total = {n: sum(p[n] for p in parts) for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for x, y in zip(parts, parts[1:]):
        total["illegal"] += x["last"] + y["first"] not in ("su", "ua", "au")
    numbered = [p for p in parts if p["turns"]]
    total["turns"] -= sum(x["high"] == y["low"] for x, y in zip(numbered, numbered[1:]))
    gaps = numbered[-1]["high"] - numbered[0]["low"] + 1 - total["turns"] if numbered else 0
    cost, audit = chain([[c is not None and (c, a) or None for c, a in zip(p["costs"], p["audits"])] for p in parts])
    long, columns = pa.int64(), ("blank", "duplicate", "truncated", "illegal")
    return pa.table({"conv_id": pa.array([parts[0]["conv_id"]], long), "gaps": pa.array([gaps], long),
                     **{n: pa.array([total[n]], long) for n in columns},
                     "cost": pa.array([cost], long), "audit": pa.array([audit], pa.string())})


def diagnose(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """The faults of each conversation and the cheapest edits that mend it.

    ``rows`` has conv_id, turn, role and text; further columns are not looked at. Turns are taken
    by turn (nulls first), those of one number by role and the MD5 of their text. A null role or
    text counts as one space, so such a text is blank and such a role illegal; an empty role is
    illegal too. Rows without conv_id make up one conversation. Each turn's first fault counts:
    blank, duplicate (same role and text earlier; equal rows repeat each other) or truncated.
    Returns conv_id, gaps (numbers missing between the first and last turn), blank, duplicate,
    truncated, illegal (adjacent roles other than system-user, user-assistant and assistant-user),
    cost and audit; a row a conversation, none for an empty table. ``slices`` is how many ranges
    the turns are cut into, by default the session's shuffle partitions.
    """
    turns = _with_repeats(_narrow(rows))
    key = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    ranged = turns.repartitionByRange(*([slices] if slices else []), *key).sortWithinPartitions(*key)
    parts = stored(ranged.select("conv_id", "turn", "role", "code", "n", "again")
                   .mapInArrow(_parts, _PART), "parts")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    inside = parts.where("audit IS NOT NULL").withColumn("gaps", gaps)
    cut = parts.where("audit IS NULL").groupBy("conv_id").applyInArrow(_chained, _SUMMARY)
    return inside.select(cut.columns).union(cut)


# ----------------------------------------------------------------------- repair

_REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply each conversation's audit, which comes first, to the turns behind it."""
    audit, at, state, place, conv_id = "", 0, 0, 0, None
    out: list[tuple] = []
    size = 0

    def emit(edit, role, text):
        nonlocal state, place, size
        state = {"s": 1, "u": 2, "a": 3}[role[:1]]
        out.append((conv_id, place, edit, role, text))
        place += 1
        size += len(text)

    def inserted():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            emit("I", _ROLES[_WANTED[state]], "")
            at += 1

    def packed():
        nonlocal size
        columns = list(zip(*out)) or [()] * 5
        out.clear()
        size = 0
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=["conv_id", "place", "edit", "role", "text"])

    for batch in batches:
        ids, kinds, roles = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "role"))
        texts = batch.column("text")
        for k, kind in enumerate(kinds):
            if kind == 0:
                inserted()  # what the last conversation ends with
                conv_id, audit, at, state, place = ids[k], texts[k].as_py(), 0, 0, 0
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                emit(edit, roles[k] if edit == "K" else _ROLES[_WANTED[state]], texts[k].as_py())
            if size > 4_000_000 or len(out) >= 10_000:
                yield packed()
    inserted()
    yield packed()


def repaired_rows(rows: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """The turns of each conversation after its edits: conv_id, place (from 0), edit, role, text.

    ``diagnosis`` is what :func:`diagnose` gives for the same rows. A conversation's rows lie in
    one partition in the order of their places.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("kind"),
                        F.col("turn").cast("long").alias("turn"), _text("role").alias("role"),
                        F.md5(_text("text").cast("binary")).alias("digest"), _text("text").alias("text"))
    none = F.lit(None)
    audits = diagnosis.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"),
                              none.cast("string").alias("role"), none.cast("string").alias("digest"),
                              F.col("audit").alias("text"))
    key = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "digest")]
    return (turns.union(audits).repartition("conv_id").sortWithinPartitions(*key)
            .select("conv_id", "kind", "role", "text").mapInArrow(_edit, _REPAIRED))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, read as a stream."""
    current, ids, digests = None, [], []

    def packed(n):
        out = pa.RecordBatch.from_arrays([pa.array(ids[:n], pa.int64()), pa.array(digests[:n], pa.string())],
                                         names=["conv_id", "repaired_sha256"])
        del ids[:n], digests[:n]
        return out

    for batch in batches:
        places, conv_ids, roles = (batch.column(c).to_pylist() for c in ("place", "conv_id", "role"))
        texts = batch.column("text")
        for k, place in enumerate(places):
            if place == 0:
                if current is not None:
                    digests.append(current.hexdigest())
                current = hashlib.sha256()
                ids.append(conv_ids[k])
            else:
                current.update(b"\n")
            current.update(f"{roles[k]}:{texts[k].as_py()}".encode())
        yield packed(len(digests))
    if current is not None:
        digests.append(current.hexdigest())
    yield packed(len(digests))


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations with a turn left, from :func:`repaired_rows`."""
    return repaired.mapInArrow(_digest, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations, damaged by the CRC-32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the
    user's; the others stay.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(name.cast("binary")) % 20
    text, role = _text("text"), _text("role")
    out = rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        fate.alias("__fate")).where("__fate <> 0")
    copies = F.when(F.col("__fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.withColumn("__copy", F.explode(copies)).drop("__fate", "__copy")
