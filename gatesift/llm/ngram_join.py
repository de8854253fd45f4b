"""N-gram Jaccard join: which texts share most of their word shingles?

T-occurrence search by divided lists. A pair that reaches the similarity shares at least
T = ceil(0.8 n) of the n shingles of either text. Sort a text's shingles by how many texts
have them, rarest first: the first n - T + R are its *short lists*, the others its T - R *long
lists*. Whatever reaches T must occur R times among the short lists, so only these are merged
(sorted runs of the inverted index meet in buckets of it, and occurrences of a pair are
counted); the long lists are then only probed, by binary search in the candidate's sorted
shingles, until the required overlap is reached or out of reach.

* Texts with equal shingle sets are one node; a node's posting leaves a task once.
* Frequent shingles come from all rows: each task counts what it has and reports what it saw
  twice or more. The table of the most frequent ones is bounded and only decides the order,
  never what is found.
* Short lists of up to ``BIG_LIST`` nodes give all their pairs that meet early enough to leave
  room for T. From a longer one, usually a large group of near copies, neighbours are verified
  first. After linked ones are put into components, members of different components are
  compared by sketches: each set's shingles hashed into ``SKETCH_BITS`` bits, each bit the
  parity of what falls on it. Two sets differ in at least as many shingles as their sketches
  differ in bits, so a pair whose sketches differ too much is not similar, and only the others
  are probed: first as many as would connect a list, then, with the components that these
  gave, all that are still across components. So no group gives all its pairs, and no link
  between different components is lost.
* The links inside components are counted there (``link_counts``), where the number is asked for.

A node is a 64-bit hash of a shingle set, shingles are 64-bit hashes. Merging holds a list
longer than ``BIG_LIST`` in one task as 20 bytes a different text; copies do not count. Sketches
of long lists are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import stored
from gatesift.llm.components import components
from gatesift.llm.link_counts import link_counts, pair_required
from gatesift.llm.shingles import mix, shingle_sets

LEAST_SHARED = 4            # R: occurrences among the short lists
BIG_LIST = 16
MOST_FREQUENT = 1 << 19     # entries of the frequency table, 16 bytes each
BUCKET_POSTINGS = 250_000
SKETCH_BITS = 1024          # of a node in a big list
SKETCH_BLOCK = 4096         # members of a big list whose sketches a task holds twice at most
BROADCAST_ROWS = 1_000_000  # ids of candidates, 16 bytes each
_COUNT_AT_ONCE = 4_000_000
_POST_AT_ONCE = 500_000


def required(n) -> np.ndarray:
    """Shingles that a partner must share at least: 0.8 n, rounded up."""
    return (4 * n + 4) // 5


def _node(shingles: np.ndarray) -> int:
    total = np.add.reduce(mix(shingles ^ np.uint64(0x5DEECE66D))) + np.uint64(len(shingles))
    return int(mix(np.array([total]))[0].astype(np.int64))


def _sets(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of a batch, its texts a few megabytes at a time."""
    texts, start, size = [], 0, 0
    values = batch.column(column)
    for row in range(batch.num_rows):
        text = values[row].as_py()
        texts.append(text.encode() if text else b"")
        size += len(texts[-1])
        if size > 4_000_000 or row == batch.num_rows - 1:
            yield from enumerate(shingle_sets(texts), start)
            texts, start, size = [], row + 1, 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a text (doc_id, node, n), and rows of shingles seen twice or more (node, seen)."""
    seen_nodes, kept, n_kept = set(), [], 0
    names = ["doc_id", "node", "n", "seen"]

    def frequent():
        values = np.concatenate(kept)
        kept.clear()
        values.sort()
        again = np.append(values[1:] == values[:-1], False)
        opens = np.flatnonzero(again & ~np.append(False, again[:-1]))
        closes = np.flatnonzero(~again & np.append(False, again[:-1]))
        values, counts = values[opens].astype(np.int64), closes - opens + 1
        none = pa.nulls(len(values), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, pa.array(values), none, pa.array(counts, pa.int64())], names=names)

    for batch in batches:
        nodes, sizes = [], []
        for _, shingles in _sets(batch):
            node = _node(shingles) if len(shingles) else None
            nodes.append(node)
            sizes.append(len(shingles))
            if node is not None and node not in seen_nodes:
                seen_nodes.add(node)
                kept.append(shingles)
                n_kept += len(shingles)
                if n_kept > _COUNT_AT_ONCE:
                    yield frequent()
                    n_kept = 0
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
             pa.nulls(len(nodes), pa.int64())], names=names)
    if kept:
        yield frequent()


def _short_lists(frequent: np.ndarray, counts: np.ndarray, buckets: int):
    """Postings of every text's short lists, packed into a binary a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, short, nodes, sizes, n_held = set(), [], [], [], 0

        def packed():
            s = np.concatenate(short)
            lengths = [len(x) for x in short]
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            node = np.repeat(np.array(nodes, np.int64), lengths)
            size = np.repeat(np.array(sizes, np.int32), lengths)
            bucket = (s & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.lexsort((s, bucket))
            s, node, size, bucket, place = s[order], node[order], size[order], bucket[order], place[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(s)]
            rows = [(int(bucket[i]), (s[i:j] >> np.uint64(32)).astype(np.uint32).tobytes(),
                     node[i:j].tobytes(), size[i:j].tobytes(), place[i:j].tobytes())
                    for i, j in zip(cuts, cuts[1:])]
            b, *packs = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), *(pa.array(v, pa.binary()) for v in packs)],
                names=["bucket", "shingles", "nodes", "sizes", "places"])

        for batch in batches:
            for _, shingles in _sets(batch, 0):
                n = len(shingles)
                node = _node(shingles) if n else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                often = np.zeros(n, np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
                    often = np.where(frequent[at] == shingles, counts[at], 0)
                length = min(n, n - int(required(n)) + LEAST_SHARED)
                short.append(shingles[np.lexsort((shingles, often))[:length]])
                nodes.append(node)
                sizes.append(n)
                n_held += length
                if n_held > _POST_AT_ONCE:
                    yield packed()
                    short, nodes, sizes, n_held = [], [], [], 0
        if short:
            yield packed()
    return run


_MERGED = ("a long, b long, na int, nb int, shared long, members array<long>, sizes array<int>, "
           "places array<int>")


def _within_reach(na, pa_, nb, pb) -> np.ndarray:
    """Whether a pair may be similar that meets at these places of its short lists.

    Each of a pair's first R common shingles passes: before it there are at most R - 1, and
    from it on at most what is left of either text. So R occurrences remain of a similar pair,
    and those that don't pass need not be counted.
    """
    left = np.minimum(na.astype(np.int64) - pa_, nb.astype(np.int64) - pb)
    return left >= pair_required(na.astype(np.int64), nb.astype(np.int64)) - (LEAST_SHARED - 1)


def _merge_bucket(rows: pa.Table) -> pa.Table:
    """Merge a bucket's runs into inverted lists; pairs with their occurrences, and big lists."""
    def column(name, kind):
        return np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows.column(name)])

    shingle, node, size = column("shingles", np.uint32), column("nodes", np.int64), column("sizes", np.int32)
    place = column("places", np.int32)
    order = np.lexsort((place, node, size, shingle))
    shingle, node, size, place = shingle[order], node[order], size[order], place[order]
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1]))
    shingle, node, size, place = shingle[new], node[new], size[new], place[new]
    opens = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    lengths = np.diff(np.append(opens, len(shingle)))
    of = np.repeat(np.arange(len(opens)), lengths)
    big = lengths[of] > BIG_LIST
    first, second, weight = [], [], []
    for step in range(1, min(BIG_LIST, int(lengths.max()))):
        near = (of[step:] == of[:-step]) & (5 * size[:-step].astype(np.int64) >= 4 * size[step:].astype(np.int64))
        if step > 1:  # of big lists, neighbours only
            near &= ~big[step:]
        at = np.flatnonzero(near)
        at = at[_within_reach(size[at], place[at], size[at + step], place[at + step])]
        first.append(at)
        second.append(at + step)
        weight.append(np.where(big[at], LEAST_SHARED, 1))
    out = pa.table({n: pa.array([], t) for n, t in zip(
        ("a", "b", "na", "nb", "shared"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))})
    if first and sum(map(len, first)):
        i, j, w = np.concatenate(first), np.concatenate(second), np.concatenate(weight)
        order = np.lexsort((node[j], node[i]))
        i, j, w = i[order], j[order], w[order]
        starts = np.flatnonzero(np.append(True, (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])))
        out = pa.table({"a": node[i][starts], "b": node[j][starts], "na": size[i][starts],
                        "nb": size[j][starts], "shared": np.add.reduceat(w, starts).astype(np.int64)})
    n_pairs = out.num_rows
    lists = {}
    for k in np.flatnonzero(lengths > BIG_LIST).tolist():
        own = slice(opens[k], opens[k] + lengths[k])
        key = node[own].tobytes()  # lists with the same nodes need one look, at the first places
        before = lists.get(key)
        lists[key] = (size[own], place[own] if before is None else np.minimum(before[1], place[own]))
    members = [np.frombuffer(x, np.int64) for x in lists]
    blank = {n: pa.nulls(len(members), out.schema.field(n).type) for n in out.column_names}
    listed = pa.table({**blank, "members": pa.array(members, pa.list_(pa.int64())),
                       "sizes": pa.array([x for x, _ in lists.values()], pa.list_(pa.int32())),
                       "places": pa.array([x for _, x in lists.values()], pa.list_(pa.int32()))})
    out = out.append_column("members", pa.nulls(n_pairs, pa.list_(pa.int64())))
    for name in ("sizes", "places"):
        out = out.append_column(name, pa.nulls(n_pairs, pa.list_(pa.int32())))
    return pa.concat_tables([out, listed])


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wanted node, text) -> (node, shingles as bytes), where the text is that node's, once a task."""
    seen = set()
    for batch in batches:
        wanted, found, sets = batch.column(0).to_pylist(), [], []
        for row, shingles in _sets(batch):
            node = _node(shingles) if len(shingles) else None
            if node is not None and wanted[row] in (None, node) and node not in seen:
                seen.add(node)
                found.append(node)
                sets.append(shingles.tobytes())
            if len(sets) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())],
                                                 names=["node", "shingles"])
                found, sets = [], []
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())],
                                         names=["node", "shingles"])


def reaches(short: np.ndarray, long: np.ndarray, step: int = 256) -> bool:
    """Whether two sorted sets overlap enough: probe one's shingles in the other, in blocks."""
    need, found = int(pair_required(len(short), len(long))), 0
    for start in range(0, len(short), step):
        if found + len(short) - start < need:
            return False
        probes = short[start:start + step]
        at = np.minimum(np.searchsorted(long, probes), len(long) - 1)
        found += int(np.count_nonzero(long[at] == probes))
    return found >= need


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            keep.append(reaches(*sorted((x, y), key=len)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y") \
                .mapInArrow(_verify, "a long, b long")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) -> (node, sketch): which bits an odd number of shingles falls on."""
    for batch in batches:
        out = []
        for shingles in batch.column("shingles"):
            bits = mix(np.frombuffer(shingles.as_py(), np.uint64)) % np.uint64(SKETCH_BITS)
            odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
            out.append(np.packbits(odd.astype(bool)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())],
                                         names=["node", "sketch"])


def _across(spanning: bool):
    """Pairs of a big list's members in different components that sketches don't rule out.

    If ``spanning``, only as many as would connect them: the nearest sketch of a component that
    nothing connects to yet. Otherwise all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, low, high in zip(*(batch.column(n).to_pylist() for n in ("members", "low", "high"))):
                members.sort(key=lambda m: (m["size"], m["node"]))
                size, node, root, place, block = (np.array([m[k] for m in members], np.int64)
                                                  for k in ("size", "node", "root", "place", "block"))
                sketch = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint64).reshape(len(node), -1)
                for i in range(len(node)):
                    end = np.searchsorted(size, 5 * size[i] // 4, side="right")
                    fits = (root[i + 1:end] != root[i]) & _within_reach(
                        size[i], place[i], size[i + 1:end], place[i + 1:end])
                    if low != high:  # pairs inside a block are another task's
                        fits &= block[i + 1:end] != block[i]
                    j = i + 1 + np.flatnonzero(fits)
                    differ = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                    total = size[i] + size[j]
                    near = differ <= total - 2 * pair_required(size[i], size[j])
                    j = j[near]
                    if spanning and len(j):
                        taken = []
                        for k in j[np.argsort(differ[near], kind="stable")].tolist():
                            if root[k] != root[i]:
                                taken.append(k)
                                root[root == root[k]] = root[i]
                        j = np.array(taken)
                    if len(j):
                        yield pa.RecordBatch.from_pydict({"a": np.full(len(j), node[i]), "b": node[j]})
    return run


def _candidates(lists: DataFrame, sketches: DataFrame, links: DataFrame, spanning: bool) -> DataFrame:
    """Pairs of members of big lists to be probed, given the links found so far.

    Lists of more than ``SKETCH_BLOCK`` members are compared in pairs of blocks, each a group
    of its own.
    """
    rooted = (lists.join(stored(components(links), "roots"), "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    mixed = (rooted.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y"),
                                        F.count("*").alias("n")).where("x < y")
             .select("list", F.ceil(F.col("n") / SKETCH_BLOCK).cast("int").alias("blocks")))
    other = F.col("other")
    return (rooted.join(mixed, "list").join(sketches, "node")
            .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .groupBy("list", F.least("block", other).alias("low"), F.greatest("block", other).alias("high"))
            .agg(F.collect_list(F.struct("size", "node", "root", "place", "block", "sketch")).alias("members"))
            .select("members", "low", "high").mapInArrow(_across(spanning), "a long, b long").distinct())


def _most_frequent(sightings: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles seen most often, sorted, and how often; at most ``MOST_FREQUENT``.

    A histogram of the counts, eight classes an octave, tells from which class on the table
    has room; so the driver gets that table only, and nothing is ranked.
    """
    counted = stored(sightings.groupBy("node").agg(F.sum("seen").alias("seen"))
                     .withColumn("class", F.floor(8 * F.log2("seen")).cast("int")), "counted")
    lowest, room = None, MOST_FREQUENT
    for row in sorted(counted.groupBy("class").count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        lowest = row["class"]
    seen = F.least("seen", F.lit(2**31 - 1)).cast("int").alias("seen")
    chosen = counted.where(F.col("class") >= F.lit(lowest)).select("node", seen).toArrow()
    frequent = chosen["node"].to_numpy().astype(np.uint64)
    order = np.argsort(frequent)
    return frequent[order], chosen["seen"].to_numpy()[order]


def similar_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts as nodes, and which nodes are linked by paths of similar pairs.

    ``docs`` has doc_id (long) and text. Returns (doc_id, node, n), a row a row of ``docs``,
    node null without words; (node, root) of the nodes that are similar to another; and (node,
    shingles), the sorted hashes as bytes, of these at least, a node more than once at times.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stored(docs.mapInArrow(_scan, "doc_id long, node long, n long, seen long"), "scanned")
    texts = scanned.where("seen IS NULL").select("doc_id", "node", F.col("n"))
    frequent, counts = _most_frequent(scanned.where("seen IS NOT NULL"))
    n_shingles = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(16, n_shingles // 5 // BUCKET_POSTINGS)
    postings = docs.select("text").mapInArrow(
        _short_lists(frequent, counts, buckets),
        "bucket int, shingles binary, nodes binary, sizes binary, places binary")
    merged = stored(postings.groupBy("bucket").applyInArrow(_merge_bucket, _MERGED), "merged")
    reach = F.least(F.lit(LEAST_SHARED), F.floor((4 * (F.col("na") + F.col("nb")) + 8) / 9))
    pairs = stored(merged.where("a IS NOT NULL")
                   .groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("na").alias("na"),
                                          F.first("nb").alias("nb"))
                   .where(F.col("shared") >= reach).select("a", "b"), "pairs")
    # a list's number comes before its members are dealt out
    numbered = (merged.where("members IS NOT NULL").select("members", "sizes", "places")
                .withColumn("list", F.monotonically_increasing_id()))
    lists = stored(numbered.select("list", F.explode(F.arrays_zip("members", "sizes", "places")).alias("m"))
                   .select("list", F.col("m.members").alias("node"), F.col("m.sizes").alias("size"),
                           F.col("m.places").alias("place")), "lists")

    wanted = (pairs.select(F.explode(F.array("a", "b")).alias("node")).union(lists.select("node")).distinct())
    chosen = stored(texts.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
                    .join(wanted, "node").select("doc_id", "node"), "chosen")
    known = chosen.where("doc_id IS NOT NULL")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    by_id = docs.join(known, "doc_id").select("node", "text").mapInArrow(_to_sets, "node long, shingles binary")
    nameless = (docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("node"), "text")
                .mapInArrow(_to_sets, "node long, shingles binary")
                .join(chosen.where("doc_id IS NULL").select("node"), "node", "left_semi"))
    sets = stored(by_id.union(nameless), "sets")

    links = stored(_linked(pairs, sets).distinct(), "links")
    if not lists.isEmpty():
        sketches = stored(sets.join(lists.select("node").distinct(), "node", "left_semi")
                          .mapInArrow(_sketches, "node long, sketch binary"), "sketches")
        probed = pairs
        for spanning in (True, False):
            found = _candidates(lists, sketches, links, spanning).join(probed, ["a", "b"], "left_anti")
            found = stored(found, "across")
            links = links.union(stored(_linked(found, sets).distinct(), "links"))
            probed = probed.union(found)
    return texts, stored(components(links), "components"), sets


def ngram_components(docs: DataFrame, with_links: bool = False) -> DataFrame:
    """Each row of ``docs`` with n_shingles and component_id, and n_links if asked for.

    Returns doc_id, n_shingles (size of the set of 5-word shingles; of a text with fewer
    words, 1; of an empty or null text, 0) and component_id: the smallest doc_id reachable
    over links, its own included. A text without words is linked with nothing. Repeated rows
    stay; a row without doc_id takes part in links but gives no smallest id, so its component
    is null if no linked row has one. n_links counts the other rows that a row is linked with,
    copies and rows without doc_id included. An empty table gives an empty one; further columns
    are not looked at.
    """
    texts, roots, sets = similar_nodes(docs)
    by_node = (texts.where("node IS NOT NULL").groupBy("node")
               .agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    if with_links:
        by_node = stored(by_node, "nodes")
    rooted = by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id", "copies")
    if with_links:
        linked = link_counts(sets, roots, by_node.select("node", "copies"))
        named = named.join(linked, "node", "left")
    out = ["doc_id", F.col("n").alias("n_shingles"),
           F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    if with_links:
        out.append(F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).alias("n_links"))
    return texts.join(named, "node", "left").select(*out)
