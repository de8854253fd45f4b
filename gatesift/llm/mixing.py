"""Mixing sources to target weights, with DataFrame and SQL functions only.

The rows of a source are put into a seeded random order; the stream of their words, repeated
as often as the source's target asks, is cut into blocks of a fixed number of words. The
blocks that the target asks for are a source's *quota*. A splitting tree deals the quotas to
the output shards: each node draws how many blocks of each source go to its left half from
the multivariate hypergeometric distribution (one conditional hypergeometric draw a source),
and its right half gets the rest, so quotas stay exact at every level. A leaf then owns
disjoint ranges of each source's permuted blocks. The mix is the table of what these blocks hold,
written shard by shard: a shard's blocks in random order, and a block's pieces shuffled.

The tree works on one row per node; the rows of the corpus are only joined with small tables
and ordered within (source, hash range) groups, so no source meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatesift.llm.common import WORD, stored, unit_hash

SEED = 20240607
MAX_REPEATS = 3
_MULTIPLIER = 2147483647  # a prime: i -> (i * prime + shift) mod n is a permutation unless it divides n


def order_key(row_id: Column, seed: int = SEED) -> Column:
    """16 hexadecimal digits that put rows into a random order that reruns repeat."""
    text = F.coalesce(row_id.cast("string"), F.lit(""))
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")), 1, 16)


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Share the total of all sizes out to the sources.

    ``sizes`` has (source, source_size), a row for each source. Sources ordered by code point,
    null last, weigh ``weights``, repeating. A target never exceeds ``max_repeats`` times its
    source's size; what is above goes to the others by weight, until none is above: the
    sources with the smallest size per weight are the ones that stop, so running totals in
    that order find the level that the others share. Returns source, rank, weight,
    source_size, target. One row a source passes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cap = F.col("source_size") * max_repeats
    ranked = (sizes.withColumn("rank", F.row_number().over(by_name) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                 F.col("rank") % len(weights) + 1).cast("long"))
              .withColumn("fill", F.col("source_size") / F.col("weight")))
    level = (ranked.withColumn("total", F.sum("source_size").over(whole))
             .withColumn("all_weight", F.sum("weight").over(whole))
             .withColumn("left_size", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
             .withColumn("left_weight",
                         F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
             .withColumn("stops", F.col("left_size").cast("double") / F.col("left_weight")
                         * F.col("weight") > cap)
             .withColumn("open", F.when(~F.col("stops"), F.struct("fill", "rank", "left_size",
                                                                 "left_weight")))
             .withColumn("first_open", F.min("open").over(whole)))
    stops = F.struct("fill", "rank") < F.struct("first_open.fill", "first_open.rank")
    return level.select(
        "source", "rank", "weight", "source_size",
        F.when(stops, cap.cast("double"))
         .otherwise(F.col("first_open.left_size").cast("double") / F.col("first_open.left_weight")
                    * F.col("weight")).alias("target"))


def _hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many marked items are among those drawn, by inverting the distribution at u.

    Weights are built up by their ratios from the lower end of mean +- 10 deviations (what
    is outside weighs less than 1e-20) or of the possible range, if that is narrower.
    """
    ratio = ("CAST({k} - x AS DOUBLE) * ({n} - x) / ((x + 1D) * ({t} - {k} - {n} + x + 1))"
             .format(k="p.k", n="p.n", t="p.t"))
    mean = "p.n * CAST(p.k AS DOUBLE) / greatest(p.t, 1L)"
    deviation = (f"sqrt(greatest(0D, {mean} * (1 - p.k / greatest(p.t, 1D)) "
                 "* (p.t - p.n) / greatest(p.t - 1D, 1D)))")
    low = f"greatest(0L, p.n - (p.t - p.k), CAST(floor({mean} - 10 * {deviation} - 10) AS BIGINT))"
    high = f"least(p.n, p.k, CAST(ceil({mean} + 10 * {deviation} + 10) AS BIGINT))"
    weigh = (f"aggregate(sequence(b.low, b.high), named_struct('w', 1D, 'sum', 0D), "
             f"(a, x) -> named_struct('w', a.w * {ratio}, 'sum', a.sum + a.w)).sum")
    find = (f"aggregate(sequence(b.low, b.high), named_struct('w', 1D, 'sum', 0D, 'at', b.low), "
            f"(a, x) -> named_struct('w', a.w * {ratio}, 'sum', a.sum + a.w, "
            f"'at', if(a.sum <= p.u * s, x, a.at))).at")
    bounds = f"transform(array(named_struct('low', {low}, 'high', {high})), b -> " \
             f"transform(array({weigh}), s -> {find})[0])[0]"
    return (f"transform(array(named_struct('t', {total}, 'k', {marked}, 'n', {drawn}, 'u', {u})), "
            f"p -> {bounds})[0]")


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Deal quotas to shards by a multivariate-hypergeometric splitting tree.

    ``quotas`` is one row with ``quotas`` array<long>, blocks by source rank. Returns shard,
    quotas: the sum over the shards is exactly the input, and shards get equal totals but for
    rounding.
    """
    step = _hypergeometric("acc.total", "q", "acc.need",
                           unit_hash(str(seed), "start", "shards", "size(acc.out)"))
    draw = (f"aggregate(quotas, named_struct('total', aggregate(quotas, 0L, (s, q) -> s + q), "
            f"'need', aggregate(quotas, 0L, (s, q) -> s + q) * (shards div 2) div shards, "
            f"'out', CAST(array() AS ARRAY<BIGINT>)), "
            f"(acc, q) -> transform(array({step}), x -> named_struct('total', acc.total - q, "
            f"'need', acc.need - x, 'out', concat(acc.out, array(x))))[0]).out")
    nodes = quotas.select(F.lit(0).alias("start"), F.lit(shards).alias("shards"), "quotas")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        drawn = nodes.select("start", "shards", "quotas",
                             F.expr(f"if(shards > 1, {draw}, quotas)").alias("left"))
        nodes = drawn.selectExpr(
            "inline(filter(array("
            "named_struct('start', start, 'shards', greatest(shards div 2, 1), 'quotas', left), "
            "named_struct('start', start + shards div 2, 'shards', shards - shards div 2, "
            "'quotas', zip_with(quotas, left, (q, x) -> q - x))), "
            "(n, i) -> i = 0 OR shards > 1))").selectExpr("CAST(start AS INT) AS start",
                                                        "CAST(shards AS INT) AS shards", "quotas")
    return nodes.select(F.col("start").alias("shard"), "quotas")


def mix_sources(docs: DataFrame, weights=(1, 2, 3), shards: int = 16, block_words: int = 8192,
                hash_digits: int = 3, seed: int = SEED) -> DataFrame:
    """Choose what each document gives to a mix whose sources have target shares.

    ``docs`` has doc_id, source and size (long, not null); all its columns stay, the new ones
    are source_size, target and ``pieces``: array of (shard, block, slot_key, from_word,
    n_words), one for each run of words that goes into one block. Repeats of a document are
    pieces again. A source gives exactly its rounded target; the document at its end gives
    its first words only. Within a shard, blocks are read in the order of slot_key.

    A row of size 0 gets no pieces. Null is a source of its own, the last; a null doc_id is
    ordered like an empty one; rows that are equal count each. Without rows, or without any
    words, nothing is taken. Reruns agree. Columns named like the new ones are replaced.
    """
    new = ("source_size", "target", "pieces")
    # all columns as one, so that none of them meets a working column
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("__row")
    keyed = (docs.select(kept, "doc_id", "source", "size").withColumn("__key", order_key(F.col("doc_id"), seed))
             .withColumn("__part", F.conv(F.substring("__key", 1, hash_digits), 16, 10).cast("long")))
    parts = stored(keyed.groupBy("source", "__part").agg(F.sum("size").alias("__size")), "parts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("__size").alias("source_size")),
                             weights)
    n_blocks = F.ceil(F.round("target").cast("long") / F.lit(block_words)).cast("long")
    targets = stored(targets.withColumn("quota", F.round("target").cast("long"))
                     .withColumn("blocks", n_blocks), "targets")
    all_quotas = targets.groupBy().agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "blocks"))),
                    lambda x: x["blocks"]).alias("quotas"))
    dealt = (split_quotas(all_quotas, shards, seed)
             .select("shard", F.posexplode("quotas").alias("rank", "n"))
             .withColumn("end", F.sum("n").over(Window.partitionBy("rank").orderBy("shard")))
             .groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))),
                                              lambda x: x["end"]).alias("ends")))
    sources = stored(targets.join(dealt, "rank")
                     .select(F.col("source").alias("__source"), F.col("rank").alias("__rank"),
                             "source_size", "target", F.col("quota").alias("__quota"),
                             F.col("blocks").alias("__blocks"), F.col("ends").alias("__ends")),
                     "sources")
    group = F.col("__rank").cast("long") * (16 ** hash_digits) + F.col("__part")
    starts = (parts.join(targets.select("source", F.col("rank").alias("__rank")),
                         parts["source"].eqNullSafe(targets["source"]))
              .withColumn("__offset", F.coalesce(
                  F.sum("__size").over(Window.partitionBy("__rank").orderBy("__part")
                                       .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select(group.alias("__group"), "__offset"))
    within = (Window.partitionBy("__group").orderBy("__key", "size", "doc_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (keyed.join(sources, keyed["source"].eqNullSafe(sources["__source"]))
              .withColumn("__group", group)
              .join(stored(starts, "starts"), "__group")
              .withColumn("__start", F.col("__offset")
                          + F.coalesce(F.sum("size").over(within), F.lit(0))))
    # (from_word, n_words, position in the source's stream) of each pass over the source
    passes = ("transform(sequence(0L, CAST(__quota div greatest(source_size, 1L) AS BIGINT)), "
              "e -> named_struct('at', e * source_size + __start, 'n', "
              "greatest(0L, least(size, __quota - e * source_size - __start))))")
    cut = (f"flatten(transform(filter({passes}, r -> r.n > 0), r -> transform("
           f"sequence(r.at div {block_words}, (r.at + r.n - 1) div {block_words}), "
           f"b -> named_struct('block', b, "
           f"'from_word', greatest(b * {block_words}L, r.at) - r.at, "
           f"'n_words', least((b + 1) * {block_words}L, r.at + r.n) - greatest(b * {block_words}L, r.at)))))")
    rank = f"pmod(c.block * {_MULTIPLIER}L + {seed}L, __blocks)"
    pieces = (f"transform({cut}, c -> named_struct("
              f"'shard', CAST(size(filter(__ends, x -> x <= {rank})) AS INT), 'block', c.block, "
              f"'slot_key', xxhash64({seed}, __rank, c.block), "
              f"'from_word', c.from_word, 'n_words', c.n_words))")
    return placed.select("__row.*", "source_size", "target", F.expr(pieces).alias("pieces"))


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: a row for each piece of a document that a shard's blocks hold.

    ``docs`` as of :func:`mix_sources`, with the same options. Returns row (its columns as a struct),
    shard, slot_key, from_word and n_words; in the order of the mix within and over partitions: by
    shard, a shard's blocks in the order of slot_key, and the pieces of a block shuffled. Shards are
    cut into ranges of blocks, so no task has a whole one. Only blocks that the splitting tree dealt
    to a shard are in it.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mixed = mix_sources(docs.select(kept, "doc_id", "source", "size"), shards=shards, seed=seed, **options)
    pieces = mixed.select("row", "doc_id", F.inline("pieces")).where(F.col("shard").between(0, shards - 1))
    local = F.xxhash64(F.lit(seed), "slot_key", order_key(F.col("doc_id"), seed), "from_word", "n_words")
    order = ["shard", "slot_key", "block", "__local"]
    return (pieces.withColumn("__local", local).repartitionByRange("shard", "slot_key")
            .sortWithinPartitions(*order).select("row", "shard", "slot_key", "from_word", "n_words"))


def words_of(text: Column, size: Column, from_word: Column, n_words: Column) -> Column:
    """The words of a piece, with what is between them; a whole text as it is."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = F.array_join(F.slice(words, from_word.cast("int") + 1, n_words.cast("int")), "")
    return F.when(n_words == size, text).otherwise(part)
