"""How many similar texts each text has, counted inside components of similar ones.

Every link is inside a component, so its members are all that has to be compared. The inverted
lists of a block of members are divided: the short ones are merged, and occurrences counted; the
long ones, which most members have, are probed in a bitmap of each member. Both counts together
are the exact overlap. Only sums leave a task, no pairs.

A component whose sets fill more than a block is cut by classes of set size, so that similar
sets are of one class or of neighbouring ones, and each class by hash into blocks. A task
compares two blocks; members are copied once for each block that theirs is compared with, so
for b blocks of a class b copies are moved for the comparisons of a whole block each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import stored

BLOCK_BYTES = 8_000_000     # of sets, a task holds two such blocks
BROADCAST_ROWS = 1_000_000  # members with their blocks, 40 bytes each
_CLASS_RATIO = 1.26         # sizes of similar sets differ by a factor of 1.25 at most
_LONG_SHARE = 32            # a list is long if more than this part of the members are on it
_PAIR = ["part", "low_class", "low_block", "high_class", "high_block"]


def pair_required(na, nb) -> np.ndarray:
    """Overlap at which 100 * intersection reaches 80 * union."""
    return (4 * (na + nb) + 8) // 9


def linked_weights(sets: list[np.ndarray], weight: np.ndarray, split: int | None = None) -> np.ndarray:
    """For each set, the weights of the similar ones.

    With ``split``, only pairs between the first ``split`` sets and the others count.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    side = np.zeros(len(sets), np.int8) if split is None else (np.arange(len(sets)) >= split).astype(np.int8)
    order = np.lexsort((sizes, side))
    sizes, weight = sizes[order], weight[order]
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.unique(flat, return_inverse=True)[1]
    often = np.bincount(codes)
    is_long = often * _LONG_SHARE > max(len(sets), 2 * _LONG_SHARE)
    # long lists: a bitmap a member
    number = np.cumsum(is_long) - 1
    on_long = is_long[codes]
    bits = np.zeros((len(sets), -(-int(is_long.sum()) // 64) * 64), bool)
    bits[owner[on_long], number[codes[on_long]]] = True
    bits = np.packbits(bits, axis=1).view(np.uint64) if bits.size else np.zeros((len(sets), 0), np.uint64)
    # short lists: members, list by list; a list of one member links nothing
    by_code = np.argsort(codes, kind="stable")
    posted, opens = owner[by_code], np.cumsum(often) - often
    counted = (often > 1) & ~is_long
    bounds = np.append(0, np.cumsum(sizes))
    out = np.zeros(len(sets), np.int64)
    first = len(sets) if split is None else split
    for i in range(first):
        start, end = (i + 1, len(sets)) if split is None else (split, len(sets))
        low = start + np.searchsorted(sizes[start:end], -(-4 * sizes[i] // 5), side="left")
        high = start + np.searchsorted(sizes[start:end], 5 * sizes[i] // 4, side="right")
        if low >= high:
            continue
        own = codes[bounds[i]:bounds[i + 1]]
        own = own[counted[own]]
        lengths = often[own]
        at = np.repeat(opens[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        overlap = np.bincount(posted[at], minlength=len(sets))[low:high]
        overlap = overlap + np.bitwise_count(bits[low:high] & bits[i]).sum(axis=1, dtype=np.int64)
        hit = low + np.flatnonzero(overlap >= pair_required(sizes[i], sizes[low:high]))
        out[i] += weight[hit].sum()
        out[hit] += weight[i]
    back = np.empty_like(out)
    back[order] = out
    return back


def _count(rows: pa.Table) -> pa.Table:
    """(node, linked): sums of one pair of blocks, or of whole components that share a part."""
    once = np.unique(rows["node"].to_numpy(), return_index=True)[1]
    rows = rows.take(pa.array(once))
    node, root, weight = (rows[name].to_numpy() for name in ("node", "root", "copies"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["shingles"]]
    low, high = (tuple(rows[f"{end}_{name}"][0].as_py() for name in ("class", "block")) for end in ("low", "high"))
    out = np.zeros(len(sets), np.int64)
    if low != high:  # members of the low block first
        in_low = (rows["class"].to_numpy() == low[0]) & (rows["block"].to_numpy() == low[1])
        order = np.argsort(~in_low, kind="stable")
        out[order] = linked_weights([sets[i] for i in order], weight[order], int(in_low.sum()))
    else:
        order = np.argsort(root, kind="stable")
        cuts = np.flatnonzero(np.append(True, root[order][1:] != root[order][:-1])).tolist() + [len(order)]
        for i, j in zip(cuts, cuts[1:]):
            own = order[i:j]
            out[own] = linked_weights([sets[k] for k in own], weight[own])
    return pa.table({"node": node, "linked": out})


def _places(sized: DataFrame) -> DataFrame:
    """Each member's own class and block and the pairs of blocks that it is compared in."""
    size = F.col("bytes")
    totals = stored(sized.groupBy("root").agg(F.sum(size).alias("total")), "totals")
    small = totals.where(F.col("total") <= BLOCK_BYTES)
    parts = max(1, math.ceil((small.agg(F.sum("total")).first()[0] or 0) / BLOCK_BYTES))
    none = F.lit(-1)
    whole = sized.join(small.select("root"), "root").select(
        "node", "root", "copies", none.alias("class"), none.alias("block"),
        F.pmod(F.xxhash64("root"), F.lit(parts)).alias("part"),
        *(none.alias(name) for name in _PAIR[1:]))

    classed = (sized.join(totals.where(F.col("total") > BLOCK_BYTES).select("root"), "root")
               .withColumn("class", F.floor(F.log(size / 8) / math.log(_CLASS_RATIO)).cast("int")))
    blocks = stored(classed.groupBy("root", "class").agg(F.sum(size).alias("total"))
                    .select("root", "class", F.ceil(F.col("total") / BLOCK_BYTES).cast("int").alias("blocks")), "blocks")
    own = (classed.join(blocks, ["root", "class"])
           .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks"))
    around = own.withColumn("c", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    others = blocks.select("root", F.col("class").alias("c"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    here = F.struct(F.col("class").alias("c"), F.col("block").alias("b"))
    there = F.struct("c", "b")
    cut = (around.join(others, ["root", "c"])
           .withColumn("low", F.least(here, there)).withColumn("high", F.greatest(here, there))
           .select("node", "root", "copies", "class", "block", F.col("root").alias("part"),
                   F.col("low.c").alias("low_class"), F.col("low.b").alias("low_block"),
                   F.col("high.c").alias("high_class"), F.col("high.b").alias("high_block")))
    return whole.unionByName(cut)


def link_counts(sets: DataFrame, roots: DataFrame, copies: DataFrame) -> DataFrame:
    """(node, linked): how many texts are similar to each node's, its own copies left out.

    ``sets`` has node and shingles (sorted 64-bit hashes as bytes) of all nodes in ``roots`` at
    least; ``roots`` node and root, its component; ``copies`` node and copies, its texts. Nodes
    in no component are left out: nothing is similar to them. Repeated sets count once.
    """
    sized = stored(sets.select("node", F.octet_length("shingles").cast("long").alias("bytes")).distinct()
                   .join(roots, "node").join(copies, "node"), "sized")
    places = stored(_places(sized), "places")
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    return (sets.join(places, "node").groupBy(*_PAIR).applyInArrow(_count, "node long, linked long")
            .groupBy("node").agg(F.sum("linked").alias("linked")))
