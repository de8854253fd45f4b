"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (random signs and a Hadamard transform, three
times) and hashed to the nearest signed axis; a table's code joins the axes of several
rotations. All vectors are indexed in all tables. A query probes the codes, of all tables
together, that most probably hold a neighbour, and all candidates are ranked by exact distance.

Vectors that are equal are one class: however many there are, they fill one place of a bucket,
and only the ``k + 1`` smallest ids of a class can be answers. A query that its probes give
too few answers is searched again, exactly, against all classes.

How many codes a query probes follows from the rows, and is raised to what recall needs: for
``MEASURED`` queries the true neighbours are found by looking at all vectors, and how many probes
reach each of them follows from its codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatesift.llm.common import stored

TABLES = 32
SEED = 9
MEASURED = 100      # queries, chosen by hash, whose recall is measured
TARGET = 0.97       # share of their true neighbours that the probes reach
NEAR = 0.5          # cosine of neighbours, as long as none is measured
BROADCAST_BYTES = 64_000_000
_BLOCK_BYTES = 8_000_000
_CODES_AT_ONCE = 8_000_000


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    width, step = x.shape[1], 1
    while step < width:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), -1)
        step *= 2
    return x / np.sqrt(width)


def axis_scores(unit: np.ndarray, table: int, function: int, seed: int = SEED) -> np.ndarray:
    """How near each row is to each signed axis of a rotation: axis 0, -0, 1, -1, ..."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    signs = np.random.Generator(np.random.PCG64([seed, table, function])).choice([-1.0, 1.0], (3, width))
    turned = np.zeros((len(unit), width))
    turned[:, :unit.shape[1]] = unit
    for row in signs:
        turned = _hadamard(turned * row)
    scores = np.empty((len(unit), 2 * width))
    scores[:, 0::2], scores[:, 1::2] = turned, -turned
    return scores


def sharpness(cosine: float, dimension: int) -> float:
    """How fast an axis gets less probable for a neighbour of that cosine as the row's score falls.

    A neighbour's scores are the row's, shrunk by the cosine, and noise; which axis is the largest
    then follows, nearly, a softmax of the row's scores.
    """
    width = 1 << max(1, (dimension - 1).bit_length())
    cosine = min(max(cosine, 0.1), 0.99)
    return math.sqrt(2 * math.log(2 * width)) * cosine / math.sqrt((1 - cosine ** 2) / width)


def _losses(scores: np.ndarray, sharp: float) -> np.ndarray:
    """Minus the logarithm of each axis's probability."""
    top = scores.max(1, keepdims=True)
    return sharp * (top - scores) + np.log(np.exp(sharp * (scores - top)).sum(1, keepdims=True))


def codes(unit: np.ndarray, table: int, functions: int, probes: int,
          sharp: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(rows, probes) codes of a table, the nearest first, and what each loses."""
    out = np.zeros((len(unit), 1), np.int64)
    lack = np.zeros((len(unit), 1))
    for function in range(functions):
        loss = _losses(axis_scores(unit, table, function), sharp)
        width = loss.shape[1]
        n = min(probes, width)
        near = np.argpartition(loss, n - 1, axis=1)[:, :n]
        total = (lack[:, :, None] + np.take_along_axis(loss, near, 1)[:, None, :]).reshape(len(unit), -1)
        code = (out[:, :, None] * width + near[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(total, axis=1, kind="stable")[:, :probes]
        out, lack = np.take_along_axis(code, best, 1), np.take_along_axis(total, best, 1)
    return out, lack


def probed(unit: np.ndarray, tables: int, functions: int, probes: int,
           sharp: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, probes * tables) tables and codes: those of all tables that lose least."""
    depth = 2 * probes
    while True:
        each = [codes(unit, table, functions, depth, sharp) for table in range(tables)]
        n = each[0][0].shape[1]
        code, lack = (np.concatenate([one[i] for one in each], 1) for i in (0, 1))
        best = np.argsort(lack, axis=1, kind="stable")[:, :probes * tables]
        last = np.take_along_axis(lack, best[:, -1:], 1)
        if n < depth or all((one[1][:, -1:] >= last).all() for one in each):  # no table has more to give
            return best // n, np.take_along_axis(code, best, 1)
        depth *= 2


def probes_to_reach(unit: np.ndarray, near: np.ndarray, tables: int, functions: int, sharp: float) -> np.ndarray:
    """How many codes a row probes, of all tables, until one of them is a code of its neighbour.

    ``unit`` is (rows, width), ``near`` (rows, neighbours, width). A code is probed after all
    that lose less in total; those are counted by the sums of both halves of the rotations.
    """
    rows, k, width = near.shape
    least = np.full((rows, k), np.inf)
    for table in range(tables):
        own = np.zeros((rows, k))
        for function in range(functions):
            axis = axis_scores(near.reshape(-1, width), table, function).argmax(1).reshape(rows, k)
            own += np.take_along_axis(_losses(axis_scores(unit, table, function), sharp), axis, 1)
        least = np.minimum(least, own)
    out = np.ones((rows, k), np.int64)
    for table in range(tables):
        loss = [_losses(axis_scores(unit, table, function), sharp) for function in range(functions)]
        for row in range(rows):
            halves = []
            for part in (loss[:functions // 2], loss[functions // 2:]):
                sums = np.zeros(1)
                for one in part:
                    sums = np.add.outer(sums, one[row]).ravel()
                halves.append(sums)
            halves[1].sort()
            for n in range(k):
                out[row, n] += int(np.searchsorted(halves[1], least[row, n] - halves[0] - 1e-12).sum())
    return out


def _unit(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), float)
    return _normed(flat.reshape(len(column), -1))


def _normed(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # first: squares of tiny or huge ones
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _hash_rows(tables: int, functions: int, name: str, probes: int = 0, sharp: float = 1.0):
    """Rows to (row, table, code): its own code in each table, or the codes that a query probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = 2 * len(batch.column(1).flatten()) // max(1, batch.num_rows)
            step = max(1, min(512, _CODES_AT_ONCE // (max(1, 2 * probes) * max(2 * tables, width))))
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                ids, unit = np.asarray(rows.column(0)), _unit(rows.column(1))
                if not probes:
                    code = np.concatenate([codes(unit, t, functions, 1)[0] for t in range(tables)], 1)
                    table = np.broadcast_to(np.arange(tables), code.shape)
                else:
                    table, code = probed(unit, tables, functions, probes, sharp)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, code.shape[1])), pa.array(table.ravel().astype(np.int32)),
                     pa.array(code.ravel())], names=[name, "table", "code"])
    return run


def distance(x: Column, y: Column) -> Column:
    """Euclidean distance of two arrays, in double precision."""
    squares = F.zip_with(x, y, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _exact(queries: DataFrame, classes: DataFrame, dimension: int, k: int) -> DataFrame:
    """All of (query_class, class, score) that may be among the k nearest, by looking at all.

    Queries come to the driver a block of fixed size at a time, which every task holds.
    """
    found, block = None, max(1, _BLOCK_BYTES // (8 * dimension))
    waiting = queries.select("class", "vector").toLocalIterator()
    while rows := list(islice(waiting, block)):
        ids = np.array([r[0] for r in rows], np.int64)
        points = np.array([r[1] for r in rows], float)

        def nearest(batches, ids=ids, points=points):
            for batch in batches:
                vectors = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                own = np.asarray(batch.column(0))
                for query, point in zip(ids, points):
                    score = np.sqrt(((vectors - point) ** 2).sum(1))
                    cut = np.partition(score, min(k, len(score)) - 1)[min(k, len(score)) - 1]
                    at = np.flatnonzero(score <= cut)
                    yield pa.RecordBatch.from_pydict({
                        "query_class": np.full(len(at), query), "class": own[at]})

        part = classes.select("class", "vector").mapInArrow(nearest, "query_class long, class long")
        found = part if found is None else found.union(part)
    return found


def plan(rows: int, dimension: int, tables: int = TABLES) -> tuple[int, int]:
    """Rotations a code and probes a table, so that work grows slower than the rows.

    Codes are about as many as rows, within a factor of twice the dimension, and a query looks
    at about ``100 rows^0.35`` candidates, counted once for each table that finds them.
    """
    width = 2 << max(1, (dimension - 1).bit_length())
    rows = max(rows, 2)
    functions = max(1, round(math.log(rows) / math.log(width) - 0.3))
    probes = 100 * rows ** 0.35 * width ** functions / rows / tables
    return functions, max(16, math.ceil(probes))


def measured_probes(queries: DataFrame, classes: DataFrame, dimension: int, k: int, tables: int,
                    functions: int) -> tuple[int, float]:
    """Probes a table that reach ``TARGET`` of the true neighbours of ``MEASURED`` queries, and the sharpness.

    One probe, without any neighbours.
    """
    sample = stored(queries.orderBy(F.xxhash64("class"), "class").limit(MEASURED), "sample")
    found = _exact(sample, classes, dimension, k + 1)
    if found is None:
        return 1, sharpness(NEAR, dimension)
    points = sample.select(F.col("class").alias("query_class"), F.col("vector").alias("point"))
    scored = (found.where("class <> query_class").join(classes, "class").join(F.broadcast(points), "query_class")
              .withColumn("score", distance(F.col("vector"), F.col("point"))))
    best = Window.partitionBy("query_class").orderBy("score", "class")
    rows = (scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
            .select("point", "vector").collect())
    if not rows:
        return 1, sharpness(NEAR, dimension)
    point, near = (_normed(np.array([r[i] for r in rows], float)) for i in (0, 1))
    sharp = sharpness(float((point * near).sum(1).mean()), dimension)
    needed = probes_to_reach(point, near[:, None, :], tables, functions, sharp)
    return math.ceil(np.quantile(needed, TARGET, method="inverted_cdf") / tables), sharp


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES,
                       functions: int | None = None, probes: int | None = None) -> DataFrame:
    """The k nearest rows of each query row, by Euclidean distance.

    Rotations a code and probes a table (on average: the most probable codes of all tables are
    probed) follow :func:`plan`, unless they are given; probes are at least as many as
    :func:`measured_probes`.

    ``vectors`` has vec_id (long) and embedding (array of numbers); ``is_query`` is a condition
    on vec_id. Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the
    smaller vec_id; all other rows, if there are fewer than k. Rows without id, and vectors
    that are null, zero, hold null or non-finite components or have another length than most,
    take no part; of rows with equal id and vector one does. Distances are exact, on the
    vectors as given. Without usable rows or queries the result is empty.
    """
    rows = (vectors.select("vec_id", F.col("embedding").alias("vector"))
            .where(F.col("vec_id").isNotNull() & _usable(F.col("vector"))))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    most = sizes.orderBy(F.desc("rows"), "n").first()
    dimension = most.n if most else 1
    rows = rows.where(F.size("vector") == dimension)
    # equal vectors have equal keys of 128 bits
    keyed = rows.select("vec_id", "vector", F.xxhash64("vector").alias("k1"),
                        F.xxhash64(F.lit(7), "vector").alias("k2"), is_query.alias("asks"))
    by_key = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("class"), F.max("asks").alias("asks"))
    named = stored(keyed.join(by_key.drop("asks"), ["k1", "k2"])
                   .select("vec_id", "class", "asks", F.when(F.col("vec_id") == F.col("class"), F.col("vector"))
                           .alias("vector")).distinct(), "named")
    asking = stored(named.where("asks").select("class").distinct(), "asking")
    classes = named.where("vector IS NOT NULL").select("class", "vector").dropDuplicates(["class"])
    classes = stored(classes, "classes")
    queries = stored(classes.join(asking, "class"), "queries")

    planned = plan(classes.count(), dimension, tables)
    functions = functions or planned[0]
    sharp = sharpness(NEAR, dimension)
    if probes is None:
        needed, sharp = measured_probes(queries, classes, dimension, k, tables, functions)
        probes = max(planned[1], needed)
    index = classes.mapInArrow(_hash_rows(tables, functions, "class"), "class long, table int, code long")
    asked = queries.mapInArrow(_hash_rows(tables, functions, "query_class", probes, sharp),
                               "query_class long, table int, code long")
    pairs = stored(index.join(asked, ["table", "code"]).select("query_class", "class").distinct(), "pairs")
    enough = pairs.groupBy("query_class").agg(F.count("*").alias("n")).where(F.col("n") > k)
    short = queries.join(enough.select(F.col("query_class").alias("class")), "class", "left_anti")
    more = _exact(stored(short, "short"), classes, dimension, k + 1)
    if more is not None:
        pairs = pairs.union(more).distinct()

    points = queries.select(F.col("class").alias("query_class"), F.col("vector").alias("point"))
    if points.count() * dimension * 8 <= BROADCAST_BYTES:
        points = F.broadcast(points)
    scored = (pairs.join(classes, "class").join(points, "query_class")
              .select("query_class", "class", distance(F.col("vector"), F.col("point")).alias("score")))
    near = (scored.withColumn("place", F.rank().over(Window.partitionBy("query_class").orderBy("score")))
            .where(F.col("place") <= k + 1).select("query_class", "class", "score"))
    # at most k + 1 ids of a class, found in slices so that a large class is not in one task
    sliced = Window.partitionBy("class", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    members = (named.select("class", "vec_id").withColumn("at", F.row_number().over(sliced))
               .where(F.col("at") <= k + 1)
               .withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("vec_id")))
               .where(F.col("at") <= k + 1).select("class", "vec_id"))
    asks = named.where("asks").select(F.col("class").alias("query_class"), F.col("vec_id").alias("query_id"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (near.join(members, "class").join(asks, "query_class").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
