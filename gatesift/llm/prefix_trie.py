"""Prefix trie of conversations: which prefixes do they share, and what does sharing save?

Different conversations are sorted by the digests of their turns, and adjacent ones give an array
of longest common prefixes (LCPs). A sparse table over it answers range minima; every candidate
prefix (a row and a depth) searches its left and its right extent by halving steps through that
table, each on its own, and has the rows between as members. No stack walks the array. A prefix
whose left extent is its own row is a node, and nodes in the order of (row, depth) are in preorder,
so a subtree is a range of them and its totals are differences of running sums.

How it runs on Spark:

* A turn is a 16-byte digest and its length; texts are read once and not moved. Equal conversations
  are one row before anything is sorted.
* Rows are range-partitioned by their digests, so a first turn that a third of all conversations
  share is cut into slices like any other. Nodes inside a slice are finished there. Only prefixes
  of a slice's first or last row can go on in another slice: these leave with their part of each
  total, at most two rows' depths a slice, and are added up by one task.
* Ids of equal conversations are joined into texts of up to 4096 ids in parallel, and the digest of
  all of them, which can't be computed in parts, reads these texts in order.

A conversation's digests (16 bytes a turn, no texts) must fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import stored

SLICE_TURNS = 500_000   # of different conversations that a slice holds, some 500 bytes each
HEAD_TURNS = 5          # the most turns that a rebuilt conversation takes from another one
FAMILY = 100
_ID_BITS = 12
_NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, tokens, chars): the digests and code points of each conversation's turns in order.

    ``rows`` has conv_id, turn, role and text; further columns are not looked at. Null roles and
    texts are empty. Turns of one number are ordered by role and the MD5 of their text, null
    numbers come first. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(text.cast("binary"))
    turns = (rows.where("conv_id IS NOT NULL")
             .select(F.col("conv_id").cast("long").alias("conv_id"),
                     F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"),
                              F.char_length(text).alias("chars")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")))
    token = lambda t: F.md5(F.concat(t.digest, t.role).cast("binary"))
    return turns.select("conv_id", F.transform("t", token).alias("tokens"),
                        F.transform("t", lambda t: t.chars).alias("chars"))


def with_family_heads(convs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 100.

    h is the CRC-32 of the decimal id modulo 6. All turns if there are fewer, none if there is no
    such conversation; behind them come the own turns after the first h.
    """
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("tokens", 1, HEAD_TURNS).alias("head"),
        F.slice("chars", 1, HEAD_TURNS).alias("head_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")
    cut = convs.withColumns({"h": h, "family": F.col("conv_id") - F.col("conv_id") % FAMILY})

    def rebuilt(own, head):
        return F.concat(F.slice(F.coalesce(head, F.expr(f"slice({own}, 1, 0)")), F.lit(1), F.col("h")),
                        F.slice(own, F.col("h") + 1, F.size(own))).alias(own)

    return cut.join(heads, "family", "left").select(
        "conv_id", rebuilt("tokens", F.col("head")), rebuilt("chars", F.col("head_chars")))


# --------------------------------------------------------- equal conversations

def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, n, least, ids) in order -> one row a path with the digest of all its ids."""
    path, digest, total, first = None, None, 0, None
    out: list[tuple] = []

    def packed():
        columns = list(zip(*out)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (
            pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "n", "ends"])

    for batch in batches:
        for key, n, least, ids in zip(*(batch.column(c).to_pylist() for c in ("path_key", "n", "least", "ids"))):
            if key != path:
                if path is not None:
                    out.append((first, total, digest.hexdigest()))
                path, digest, total, first = key, hashlib.sha256(ids.encode()), n, least
            else:
                digest.update(b"," + ids.encode())
                total += n
        yield packed()
    if path is not None:
        out.append((first, total, digest.hexdigest()))
    yield packed()


def _different(convs: DataFrame) -> DataFrame:
    """(conv_id, path, chars, n, ends): a row each different conversation, of the least id."""
    whole = stored(convs.select("conv_id", F.unhex(F.array_join("tokens", "")).alias("path"), "chars"), "paths")
    blocks = (whole.groupBy(F.md5("path").alias("path_key"), F.shiftright("conv_id", _ID_BITS).alias("block"))
              .agg(F.count("*").alias("n"), F.min("conv_id").alias("least"),
                   F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))
    ends = (blocks.repartition("path_key").sortWithinPartitions("path_key", "block")
            .mapInArrow(_ends, "conv_id long, n long, ends string"))
    return whole.join(ends, "conv_id")


# ------------------------------------------------------------------- one slice

class RangeMinimum:
    """Minima of any range of an array, from minima of its ranges of 2**k."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            low, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value of each range, both ends included."""
        k = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            values = self.levels[level]
            out[at] = np.minimum(values[first[at]], values[last[at] - 2 ** int(level) + 1])
        return out

    def extents(self, rows: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far left and right of each row the values between stay at the depth or above.

        Entry i is the LCP of rows i - 1 and i. The two searches are independent of each other.
        """
        left, right, n = rows.copy(), rows.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            values, step = self.levels[k], 2 ** k
            start = left - step + 1
            fits = (start >= 1) & (values[np.clip(start, 0, len(values) - 1)] >= depths)
            left[fits] -= step
            start = right + 1
            fits = (right + step < n) & (values[np.clip(start, 0, len(values) - 1)] >= depths)
            right[fits] += step
        return left, right


_NODE = ("kind string, slice int, ref long, up long, conv_id long, parent_conv_id long, depth long, n long, "
         "children long, leaves long, saved long, chars long, ends string, prefix binary, parent_prefix binary")
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in _NODE.split(", ")])


def _batch(size: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCHEMA],
        schema=_SCHEMA)


def _prefixes(path: bytes) -> list[bytes]:
    """A digest of every prefix of a path, the empty one first."""
    digest, out = hashlib.md5(), []
    for at in range(0, len(path) + 1, 16):
        out.append(digest.digest())
        digest.update(path[at:at + 16])
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a sorted slice: finished ones, and parts of those that may go on elsewhere.

    Kinds: ``done``; ``hangs``, finished but for its parent, which is part ``up`` of this slice;
    ``part``.
    """
    given = [b for b in batches if b.num_rows]
    if not given:
        return
    rows = pa.Table.from_batches(given)
    paths = rows["path"].to_pylist()
    ids, weights = (rows[c].to_numpy() for c in ("conv_id", "n"))
    ends = rows["ends"].to_pylist()
    chars = np.concatenate([np.asarray(c.flatten(), np.int64) for c in rows["chars"].chunks])
    m = len(paths)
    lengths = np.array([len(p) // 16 for p in paths])
    tokens = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    opens = np.cumsum(lengths) - lengths

    # LCPs of adjacent rows: how many turns agree before the first that doesn't
    row = np.repeat(np.arange(m), lengths)
    depth = np.arange(len(tokens)) - opens[row]
    above = np.maximum(row - 1, 0)
    beside = np.where(depth < lengths[above], opens[above] + depth, 0)
    same = (row > 0) & (depth < lengths[above]) & (tokens == tokens[beside]).all(axis=1)
    lcp = lengths.copy()
    np.minimum.at(lcp, row[~same], depth[~same])
    lcp[0] = -1

    # candidates: every prefix of every row, the empty one included
    first = np.cumsum(lengths + 1) - (lengths + 1)
    of = np.repeat(np.arange(m), lengths + 1)
    deep = np.arange(len(of)) - first[of]
    left, right = RangeMinimum(lcp).extents(of, deep)
    at = np.flatnonzero(left == of)
    number = np.full(len(of), -1)
    number[at] = np.arange(len(at))
    low, high, deep = left[at], right[at], deep[at]
    above = first[left[np.maximum(at - 1, 0)]] + deep - 1   # the candidate that is the parent's node
    parent = np.where(deep > 0, number[np.where(deep > 0, above, 0)], -1)

    running = np.append(0, np.cumsum(weights))
    n = running[high + 1] - running[low]
    least = RangeMinimum(ids).of(low, high)
    said = np.zeros(len(at), np.int64)
    said[deep > 0] = chars[(opens[low] + deep - 1)[deep > 0]]
    end = np.searchsorted(low, high, side="right")          # one past the subtree, in preorder
    edge = (low == 0) | (high == m - 1)
    leaf = end == np.arange(len(at)) + 1

    def below(values):
        sums = np.append(0, np.cumsum(np.where(edge, 0, values)))
        return sums[end] - sums[:-1]

    leaves, saved = below(leaf), below((n - 1) * said)
    children = np.bincount(parent[~edge & (deep > 0)], minlength=len(at))
    closes = [ends[i] if d == lengths[i] else None for i, d in zip(low.tolist(), deep.tolist())]
    slice_no = TaskContext.get().partitionId()

    inside = np.flatnonzero(~edge)
    for start in range(0, len(inside), 50_000):
        own = inside[start:start + 50_000]
        up = parent[own]
        hangs = edge[up]
        yield _batch(len(own), kind=np.where(hangs, "hangs", "done"), slice=np.full(len(own), slice_no, np.int32),
                     up=up, conv_id=least[own], depth=deep[own],
                     parent_conv_id=pa.array(least[up], mask=hangs), n=n[own], children=children[own],
                     leaves=leaves[own], saved=saved[own], ends=[closes[k] or _NOTHING for k in own.tolist()])
    own = np.flatnonzero(edge)
    begins, finishes = _prefixes(paths[0]), _prefixes(paths[-1])
    names = [(begins if low[k] == 0 else finishes, deep[k]) for k in own.tolist()]
    yield _batch(len(own), kind=["part"] * len(own), slice=np.full(len(own), slice_no, np.int32), ref=own,
                 conv_id=least[own], depth=deep[own], n=n[own], children=children[own], leaves=leaves[own],
                 saved=saved[own], chars=said[own], ends=[closes[k] for k in own.tolist()],
                 prefix=[p[d] for p, d in names], parent_prefix=[p[d - 1] if d else None for p, d in names])


# -------------------------------------------------------------- between slices

def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of all slices, added up: whole nodes, and each part's conv_id (kind ``named``)."""
    nodes: dict[bytes, dict] = {}
    parts = []
    for batch in batches:
        for p in batch.to_pylist():
            parts.append((p["slice"], p["ref"], p["prefix"]))
            node = nodes.setdefault(p["prefix"], p)
            if node is not p:
                for name in ("n", "children", "leaves", "saved"):
                    node[name] += p[name]
                node["conv_id"] = min(node["conv_id"], p["conv_id"])
                node["ends"] = node["ends"] or p["ends"]
    if not nodes:
        return
    # leaves and saved have what lies inside slices; what the nodes here add goes up to the root
    for node in nodes.values():
        node["own_leaves"], node["own_saved"] = 0, (node["n"] - 1) * node["chars"]
        if node["depth"]:
            nodes[node["parent_prefix"]]["children"] += 1
    order = sorted(nodes.values(), key=lambda p: -p["depth"])
    for node in order:
        node["own_leaves"] += node["children"] == 0
        if node["depth"]:
            up = nodes[node["parent_prefix"]]
            up["own_leaves"] += node["own_leaves"]
            up["own_saved"] += node["own_saved"]
    for node in order:
        node["leaves"] += node["own_leaves"]
        node["saved"] += node["own_saved"]
        node["parent_conv_id"] = nodes[node["parent_prefix"]]["conv_id"] if node["depth"] else None
        node["kind"], node["ends"] = "done", node["ends"] or _NOTHING
    yield _batch(len(order), **{f.name: [node[f.name] for node in order] for f in _SCHEMA})
    yield _batch(len(parts), kind=["named"] * len(parts), slice=[p[0] for p in parts],
                 ref=[p[1] for p in parts], conv_id=[nodes[p[2]]["conv_id"] for p in parts])


def prefix_trie(convs: DataFrame, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, tokens, chars; an id once), a row a node.

    Every different sequence of first turns is a node, from the empty one; its members are the
    conversations that start with it. Returns conv_id (smallest member), depth, parent_conv_id (that
    of the parent; null for the root), n_convs (members), n_children, n_leaves (nodes of its subtree
    without children), saved_tokens (over its subtree: one less than the members, times the code
    points of the last turn) and ends_sha256 (of the ids of members that end there, ascending,
    joined by commas; without any, that of an empty text). Conversations without turns are members
    of the root. No conversations give no nodes. Equal conversations, turns without text and very
    long conversations need no special care; texts are not held.
    """
    different = stored(_different(convs), "different")
    turns = different.agg(F.coalesce(F.sum(F.size("chars")), F.lit(0))).first()[0]
    slices = max(convs.sparkSession.sparkContext.defaultParallelism, -(-turns // slice_turns))
    nodes = stored(different.repartitionByRange(slices, "path").sortWithinPartitions("path")
                   .mapInArrow(_nodes, _NODE), "nodes")
    joined = stored(nodes.where("kind = 'part'").repartition(1).mapInArrow(_joined, _NODE), "joined")
    named = joined.where("kind = 'named'").select("slice", F.col("ref").alias("up"),
                                                  F.col("conv_id").alias("parent"))
    hanging = (nodes.where("kind = 'hangs'").drop("parent_conv_id").join(named, ["slice", "up"])
               .withColumnRenamed("parent", "parent_conv_id"))
    done = nodes.where("kind = 'done'").unionByName(joined.where("kind = 'done'"))
    columns = ["conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"),
               F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
               F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    return done.select(*columns).unionByName(hanging.select(*columns))
