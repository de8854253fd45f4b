"""SimHash near-duplicates: which texts have fingerprints that differ in few bits?

Deletion-variant signatures. A 64-bit fingerprint is cut into ``SEGMENTS`` = 2 halves, fewer than
the 3 bits by which linked ones may differ need for an equal piece: of 3 differing bits, one half
has at most one. So every half is indexed under its 32 variants, each with one bit left out (the
wildcard): two halves that differ in at most that bit share the variant, and an equality join on
variants meets every link. What meets is verified on the whole fingerprints.

* Equal fingerprints are one node before anything is indexed, so copies meet nothing.
* Variants are dealt out by key and sorted; a task reads them as a stream. Members of a variant are
  compared at growing distances in the sorted run, and only links that connect something new leave
  the task.
* A variant with more than ``BLOCK`` members, a dense group of unequal fingerprints, isn't compared
  there. Its members share 31 bits already, so each is dealt out again under the variants of the
  other half's own halves (the same rule, one level down). Members of such a variant share 46 bits:
  at most 2**18 exist, and instead of comparing pairs each probes what differs in up to 3 of the
  18 open bits. So no group gives all its pairs, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import stored
from gatesift.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MOST_DIFFERENT = 3   # bits by which linked fingerprints differ at most
SEGMENTS = 2
BLOCK = 256          # members of a variant that are compared with each other
_AT_ONCE = 200_000   # shingles, or rows of a run, in the work space at a time

_HALF = 32
_QUARTER = 16
_FIELD = "fp long, key long"


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text over its word shingles, repeats included; 0 without words."""
    # bytes.split() cuts at 0x20 and 0x09 to 0x0D, bytes.lower() changes A-Z, both nothing else
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    width = min(SHINGLE_WORDS, len(words))
    n = len(words) - width + 1
    starts, ends = starts[:n], ends[width - 1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _AT_ONCE):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(
            starts[at:at + _AT_ONCE].tolist(), ends[at:at + _AT_ONCE].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))],
                                         names=["doc_id", "fp"])


def _delete_bit(value: np.ndarray, bit: int) -> np.ndarray:
    low = np.uint64((1 << bit) - 1)
    return (value & low) | ((value >> np.uint64(bit + 1)) << np.uint64(bit))


def one_wildcard(piece: np.ndarray, bits: int) -> np.ndarray:
    """(variants, rows): each piece with one of its bits left out, tagged with which."""
    return np.stack([(np.uint64(bit) << np.uint64(bits - 1)) | _delete_bit(piece, bit) for bit in range(bits)])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint under the variants of its two halves."""
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        for start in range(0, len(values), 4096):
            own = values[start:start + 4096]
            for segment in range(SEGMENTS):
                half = (own >> np.uint64(_HALF * segment)) & np.uint64(2**_HALF - 1)
                keys = one_wildcard(half, _HALF) | np.uint64(segment << 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(own, _HALF).view(np.int64)), pa.array(keys.ravel().view(np.int64))],
                    names=["fp", "key"])


def _narrower(fp: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, key) of a dense variant's members under the variants of the other half's halves.

    The pair of a key (segment, wildcard, rest) and the new variant (quarter, wildcard, rest)
    must be met, so the new key is a 64-bit mix of both; a chance meeting is verified like any.
    """
    other = np.uint64(_HALF * (1 - (key >> 40)))
    of_key = np.uint64(key * 0x9E3779B97F4A7C15 % 2**64)
    half = (fp >> other) & np.uint64(2**_HALF - 1)
    fps, keys = [], []
    for quarter in range(2):
        piece = (half >> np.uint64(_QUARTER * quarter)) & np.uint64(2**_QUARTER - 1)
        tagged = one_wildcard(piece, _QUARTER) | np.uint64(quarter << 20)
        mixed = of_key ^ (tagged * np.uint64(0xC2B2AE3D27D4EB4F))
        fps.append(np.tile(fp, _QUARTER))
        keys.append(mixed.ravel())
    return np.concatenate(fps), np.concatenate(keys)


def _connect(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of positions i and j: each position's root becomes the least one connected."""
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def spanning_links(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) that connect what is linked within each group of a sorted run, a star each."""
    root = np.arange(len(fp))
    opens = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(fp) else root
    longest = int(np.diff(np.append(opens, len(fp))).max(initial=0))
    if longest <= BLOCK:
        at = np.arange(len(fp))
        for step in range(1, longest):
            at = at[at + step < len(fp)]
            at = at[group[at] == group[at + step]]
            near = np.bitwise_count(fp[at] ^ fp[at + step]) <= MOST_DIFFERENT
            root = _connect(root, at[near], at[near] + step)
    else:
        for low, high in zip(opens, np.append(opens[1:], len(fp))):
            root[low:high] = low + _probe(fp[low:high])
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def _probe(fp: np.ndarray) -> np.ndarray:
    """Roots of one sorted group, by looking up what differs in up to 3 bits open in it."""
    root = np.arange(len(fp))
    changing = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [1 << k for k in range(64) if changing >> k & 1]
    for n in range(1, MOST_DIFFERENT + 1):
        for mask in combinations(bits, n):
            wanted = fp ^ np.uint64(sum(mask))
            at = np.minimum(np.searchsorted(fp, wanted), len(fp) - 1)
            found = np.flatnonzero(fp[at] == wanted)
            root = _connect(root, found, at[found])
    return root


_LINKED = "a long, b long, key long"


def _links(narrow: bool):
    """(fp, key) sorted by key and fp -> links (a, b); members of dense variants as (fp, null, key).

    The rows come as a stream: a run that goes on in the next batch is carried over, and one that
    has grown beyond ``BLOCK`` leaves as it comes where ``narrow`` is set.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, key, dense = np.zeros(0, np.uint64), np.zeros(0, np.int64), None

        def linked(fp, key):
            a, b = np.unique(np.stack(spanning_links(fp, key)), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                                               pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

        def dealt(fp, key):
            for start in range(0, len(fp), 4096):
                own, keys = _narrower(fp[start:start + 4096], key)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.nulls(len(own), pa.int64()),
                                                  pa.array(keys.view(np.int64))], names=["a", "b", "key"])

        def closed(fp, key):
            """Whole runs: small ones are compared together, dense ones dealt out or probed."""
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
            sizes = np.diff(np.append(cuts, len(key)))
            large = np.repeat(sizes > BLOCK, sizes)
            several = np.repeat(sizes > 1, sizes)
            yield linked(fp[several & ~large], key[several & ~large])
            for at in np.flatnonzero(sizes > BLOCK).tolist():
                own = slice(cuts[at], cuts[at] + sizes[at])
                if narrow:
                    yield from dealt(fp[own], int(key[cuts[at]]))
                else:
                    yield linked(fp[own], key[own])

        for batch in batches:
            fp = np.append(fp, batch.column("fp").to_numpy().view(np.uint64))
            key = np.append(key, batch.column("key").to_numpy())
            if dense is not None:  # the rest of a run that was found dense before
                n = int(np.searchsorted(key != dense, True)) if len(key) else 0
                yield from dealt(fp[:n], dense)
                fp, key = fp[n:], key[n:]
                if not len(key):
                    continue
                dense = None
            if not len(key):
                continue
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            yield from closed(fp[:last], key[:last])
            fp, key = fp[last:], key[last:]
            if narrow and len(key) > BLOCK:
                dense = int(key[0])
                yield from dealt(fp, dense)
                fp, key = fp[:0], key[:0]
        yield from closed(fp, key)
    return run


def _met(indexed: DataFrame, narrow: bool) -> DataFrame:
    return (indexed.repartition("key").sortWithinPartitions("key", "fp")
            .mapInArrow(_links(narrow), _LINKED))


def similar_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(node, root) of fingerprints (column fp, long) that are connected to another one."""
    nodes = stored(fingerprints.select("fp").distinct(), "fingerprints")
    first = stored(_met(nodes.mapInArrow(_variants, _FIELD), True), "variants")
    dense = first.where("b IS NULL").select(F.col("a").alias("fp"), "key")
    links = first.where("b IS NOT NULL").select("a", "b")
    if not dense.isEmpty():
        links = links.union(_met(dense, False).select("a", "b"))
    return components(links)


def simhash_components(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` with its fingerprint and component_id.

    Returns doc_id, fingerprint (16 lowercase hex digits; of an empty or null text, or one without
    words, all zeros, linked like any other) and component_id: the smallest doc_id reachable over
    links of at most 3 differing bits, its own included. Texts of any length are read whole, a part
    of their shingles at a time. Repeated rows stay; a row without doc_id takes part in links but
    gives no smallest id, so its component is null if no linked row has one. An empty table gives
    an empty one; further columns are not looked at.
    """
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    roots = stored(similar_fingerprints(texts), "components")
    by_fp = texts.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = (by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return texts.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
