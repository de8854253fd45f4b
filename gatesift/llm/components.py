"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import stored


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch's links by links from its nodes to their smallest one."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()),
                                          "b": pa.array([find(x) for x in nodes], pa.int64())})


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One large-star (both ways) or small-star step: neighbours link to the smallest around."""
    if both_ways:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    around = edges.join(least, "a")
    if both_ways:
        out = around.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = around.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node it reaches.

    ``links`` has a and b (long). Alternating large and small stars: the rounds grow with the
    logarithm of the longest path; each aggregates minima and joins them back, so a node with
    very many links is combined before the shuffle and split by adaptive execution after it.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                F.least("a", "b").alias("b"))
                   .mapInArrow(_contract, "a long, b long").distinct(), "edges")
    before = None
    while True:
        edges = stored(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
