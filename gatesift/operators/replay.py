"""Replay of a verdict cache with time to live over a request log.

A request is a hit while an earlier write of its key is live. Only misses write, and
hits do not extend the lifetime, so whether a request hits depends on the whole
history of its key. One key may hold a large part of the log, so the log is *not*
grouped by key. It is range-partitioned by (key, time, id), which cuts hot keys into
pieces of even size, and each partition is replayed on its own:

1. Every partition reports how its first and last key end. A partition that lies
   inside one key does not know the expiry it starts from; it reports its exit as a
   step function of that expiry. It reads its rows as a stream: starting expiries that
   have led to the same write are one step from then on, and none lies further from
   its first row than the longest lifetime, so it holds what one lifetime allows.
2. Step functions of consecutive partitions are composed in tasks, ``_FAN`` at a time,
   into those of ever longer runs, and the starting expiries handed down again the same
   way: a parallel prefix over the partitions of a key, in rounds that grow with the
   logarithm of their number. The driver sees a row per partition.
3. Every partition is replayed from its starting expiry.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions.keys import ttl_seconds
from gatesift.session import shared_dir

# Step functions that a task composes at a time.
_FAN = 32

_NEVER = -(2 ** 62)
_REPORT = (
    "part INT, kind INT, first_key STRING, last_key STRING, last_us BIGINT, "
    "upper_us BIGINT, exit_us BIGINT, exit_written_us BIGINT"
)
_STEPS = "chain INT, idx INT, last_us BIGINT, upper_us BIGINT, exit_us BIGINT, exit_written_us BIGINT"
_VALUES = "chain INT, idx INT, expiry BIGINT, written BIGINT"


def ttl_replay(log: DataFrame, key: str = "cache_key", ts: str = "ts",
               order: str = "request_id", ttl: Column | None = None,
               cache: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``cache_hit``, ``written_at`` and ``expires_at`` to a request log.

    ``ttl`` is in seconds and defaults to the one of ``analysis_type``. A request at
    ``ts`` hits iff ``ts < expires_at`` of the last write; requests at the same time
    are taken in the order of ``order``. A lifetime of 0 or less is never live. Rows without
    key, time or lifetime take no part: the three new columns are null. ``cache`` may hold entries that are live
    beforehand (``cache_key``, ``written_at``, ``expires_at``; one row per key). Pass a
    narrow log: all its columns are shuffled once.
    """
    spark = log.sparkSession
    shared = shared_dir(spark)
    lifetime = ttl_seconds(F.col("analysis_type")) if ttl is None else ttl
    columns = log.columns
    taking_part = F.col(key).isNotNull() & F.col(ts).isNotNull() & lifetime.isNotNull()
    apart = log.filter(~taking_part).select(
        *columns, F.lit(None).cast("boolean").alias("cache_hit"),
        F.lit(None).cast("timestamp").alias("written_at"),
        F.lit(None).cast("timestamp").alias("expires_at"))
    rows = log.filter(taking_part).withColumns({
        "_gs_key": F.col(key).cast("string"),
        "_gs_us": F.unix_micros(F.col(ts).cast("timestamp")),
    })
    rows = rows.withColumn("_gs_exp", F.col("_gs_us") + lifetime.cast("bigint") * 1_000_000)
    if cache is None:
        rows = rows.withColumns({"_gs_seed": F.lit(_NEVER), "_gs_seed_w": F.lit(_NEVER)})
    else:
        live = cache.select(
            F.col("cache_key").alias("_gs_key"),
            F.unix_micros(F.col("expires_at").cast("timestamp")).alias("_gs_seed"),
            F.unix_micros(F.col("written_at").cast("timestamp")).alias("_gs_seed_w"))
        rows = rows.join(live, "_gs_key", "left").fillna(
            {"_gs_seed": _NEVER, "_gs_seed_w": _NEVER})

    by = [F.col("_gs_key"), F.col("_gs_us"), F.col(order)]
    ranged = rows.repartitionByRange(partitions, *by) if partitions \
        else rows.repartitionByRange(*by)
    # the range bounds come from a sample, so the layout is fixed before it is read twice
    ranged = ranged.sortWithinPartitions(*by) \
                   .withColumn("_gs_part", F.spark_partition_id()).checkpoint()

    longest = ranged.agg(F.max(F.greatest(
        F.col("_gs_exp") - F.col("_gs_us"), F.col("_gs_seed") - F.col("_gs_us")))).first()[0]
    entries = _entries(ranged, longest or 0, f"{shared.rstrip('/')}/replay-{uuid.uuid4().hex}")

    replayed = ranged.mapInArrow(
        _replayer(entries, columns),
        f"{_ddl(ranged.select(*columns))}, cache_hit BOOLEAN, _gs_w BIGINT, _gs_x BIGINT")
    return replayed.select(
        *columns, "cache_hit",
        F.timestamp_micros(F.col("_gs_w")).alias("written_at"),
        F.timestamp_micros(F.col("_gs_x")).alias("expires_at"),
    ).unionByName(apart)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _make_stepper():
    """The replay of one sorted batch, as a closure that ships by value."""
    import numpy as np

    def step(keys, us, exp, seed, seed_w, carry):
        """Miss mask, last write and its expiry per row; and the carry for the next batch.

        ``carry`` is (key, expiry, write) at the end of the batch before, or None.
        """
        n = len(us)
        codes, first_key, last_key = keys
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        run = np.zeros(n, dtype=np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        ends = np.append(starts[1:], n)
        # what each run starts from: its seed, or the carry if it goes on
        entry, entry_w = seed[starts].copy(), seed_w[starts].copy()
        if carry is not None and carry[0] == first_key:
            entry[0], entry_w[0] = carry[1], carry[2]

        # "first row of a run at or after a time" for all rows at once: times become
        # ranks within the batch, and (run, rank) becomes one sorted integer
        ordered = np.sort(us)
        place = run * (n + 1) + np.searchsorted(ordered, us, side="left")

        def first_at_or_after(values, runs):
            at = np.searchsorted(
                place, runs * (n + 1) + np.searchsorted(ordered, values, side="left"))
            return np.where(at < ends[runs], at, n)

        following = first_at_or_after(exp, run)
        # an entry that is dead when written leaves the next row of its key a miss
        own = np.arange(n)
        following = np.where(following > own, following, np.where(own + 1 < ends[run], own + 1, n))
        miss = np.zeros(n + 1, dtype=bool)
        at = first_at_or_after(entry, np.arange(len(starts)))
        while True:
            at = at[at < n]
            if not len(at):
                break
            miss[at] = True
            at = following[at]
        miss = miss[:n]
        last = np.maximum.accumulate(np.where(miss, np.arange(n), -1))
        own = last >= starts[run]
        at_write = np.maximum(last, 0)
        written = np.where(own, us[at_write], entry_w[run])
        expires = np.where(own, exp[at_write], entry[run])
        return miss, written, expires, (last_key, int(expires[-1]), int(written[-1]))

    return step


def _make_reader():
    import numpy as np

    def read(batch):
        def ints(name):
            return batch.column(batch.schema.get_field_index(name)).to_numpy(
                zero_copy_only=False).astype(np.int64)
        names = batch.column(batch.schema.get_field_index("_gs_key"))
        codes = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        keys = (codes, names[0].as_py(), names[len(names) - 1].as_py())
        return (keys, ints("_gs_us"), ints("_gs_exp"), ints("_gs_seed"), ints("_gs_seed_w"))

    return read


def _replayer(entries: dict[int, tuple[str, int, int]], columns: list[str]):
    """Replay a partition from its entry; ``entries`` has one item per cut key at most."""
    step, read = _make_stepper(), _make_reader()

    def replay(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        carry, first = None, True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if first:
                part = batch.column(batch.schema.get_field_index("_gs_part"))[0].as_py()
                carry, first = entries.get(part), False
            miss, written, expires, carry = step(*read(batch), carry)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            arrays += [pa.array(~miss), pa.array(written.astype(np.int64)),
                       pa.array(expires.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                arrays, names=[*columns, "cache_hit", "_gs_w", "_gs_x"])

    return replay


def _reporter(longest: int):
    """One summary row per partition, and the steps of partitions inside one key."""
    step, read = _make_stepper(), _make_reader()

    def report(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["part", "kind", "first_key", "last_key", "last_us", "upper_us", "exit_us",
                 "exit_written_us"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string()] + [pa.int64()] * 4

        def rows(**values):
            n = len(values["part"])
            return pa.RecordBatch.from_arrays(
                [pa.array(values.get(name, [None] * n), type=kind)
                 for name, kind in zip(names, types)], names=names)

        none = np.zeros(0, dtype=np.int64)
        # starting expiries up to ``upper`` lead to the expiry and write on the same place
        upper, expiry, write = none, none, none
        part = first_key = carry = last_us = limit = None
        single = True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, us, exp, seed, seed_w = read(batch)
            if part is None:
                part = batch.column(batch.schema.get_field_index("_gs_part"))[0].as_py()
                first_key, limit = keys[1], us[0] + longest
            single = single and keys[2] == first_key
            if single:
                # follow each row's chain of misses to its end in this batch by pointer doubling
                n, own = len(us), np.arange(len(us))
                end = np.maximum(np.searchsorted(us, exp, side="left"), own + 1)
                end = np.where(end < n, end, own)
                while True:
                    further = end[end]
                    if (further == end).all():
                        break
                    end = further
                at = np.searchsorted(us, expiry, side="left")
                going, at = at < n, end[np.minimum(at, n - 1)]
                expiry, write = np.where(going, exp[at], expiry), np.where(going, us[at], write)
                # steps that start at rows of this batch, as far as a starting expiry can reach
                before = np.append(us[0] - 1 if last_us is None else last_us, us[:-1])
                new = np.flatnonzero((us > before) & (before < limit))
                upper = np.concatenate((upper, us[new]))
                expiry = np.concatenate((expiry, exp[end[new]]))
                write = np.concatenate((write, us[end[new]]))
                upper, expiry, write = _merged(upper, expiry, write)
            else:
                upper, expiry, write = none, none, none
            carry = step(keys, us, exp, seed, seed_w, carry)[3]
            last_us = int(us[-1])
        if part is None:
            return
        for start in range(0, len(upper), 10_000):
            cut = slice(start, start + 10_000)
            yield rows(part=[part] * len(upper[cut]), kind=[1] * len(upper[cut]),
                       upper_us=upper[cut], exit_us=expiry[cut], exit_written_us=write[cut])
        yield rows(part=[part], kind=[0], first_key=[first_key], last_key=[carry[0]],
                   last_us=[last_us], exit_us=[carry[1]], exit_written_us=[carry[2]])

    return report


def _merged(upper, expiry, write):
    """Neighbouring steps that lead to the same write as one."""
    import numpy as np

    if not len(upper):
        return upper, expiry, write
    ends = np.append((expiry[1:] != expiry[:-1]) | (write[1:] != write[:-1]), True)
    return upper[ends], expiry[ends], write[ends]


def _functions(steps) -> list[tuple]:
    """(idx, last time, upper, expiry, write) of each step function in a table, by idx."""
    import numpy as np

    columns = [steps[c].to_numpy() for c in ("idx", "last_us", "upper_us", "exit_us", "exit_written_us")]
    order = np.lexsort((columns[2], columns[0]))
    idx, last, upper, expiry, write = (c[order] for c in columns)
    cuts = np.flatnonzero(np.append(True, idx[1:] != idx[:-1])) if len(idx) else []
    return [(int(idx[i]), int(last[i]), upper[i:j], expiry[i:j], write[i:j])
            for i, j in zip(cuts, [*cuts[1:], len(idx)])]


def _then(expiry, write, last: int, upper, expiries, writes):
    """What a step function makes of expiries: those beyond its last row pass."""
    import numpy as np

    at = np.minimum(np.searchsorted(upper, expiry, side="left"), len(upper) - 1)
    ends = expiry <= last
    return np.where(ends, expiries[at], expiry), np.where(ends, writes[at], write)


def _compose(fan: int):
    """The step functions of consecutive partitions as one."""
    def compose(steps):
        import numpy as np
        import pyarrow as pa

        chain, functions = steps["chain"][0].as_py(), _functions(steps)
        first, last, upper, expiry, write = functions[0]
        for _, end, uppers, expiries, writes in functions[1:]:
            expiry, write = _then(expiry, write, end, uppers, expiries, writes)
            beyond = uppers > last
            upper, expiry, write = _merged(
                np.concatenate((upper, uppers[beyond])), np.concatenate((expiry, expiries[beyond])),
                np.concatenate((write, writes[beyond])))
            last = end
        n = len(upper)
        return pa.table({
            "chain": pa.array([chain] * n, pa.int32()), "idx": pa.array([first // fan] * n, pa.int32()),
            "last_us": pa.array([last] * n, pa.int64()), "upper_us": upper, "exit_us": expiry,
            "exit_written_us": write})

    return compose


def _evaluate(steps, values):
    """What each of consecutive partitions starts from, and the one behind them, given the first."""
    import numpy as np
    import pyarrow as pa

    out = []
    if values.num_rows and steps.num_rows:
        chain = values["chain"][0].as_py()
        expiry, write = (values[c].to_numpy()[:1] for c in ("expiry", "written"))
        for idx, last, upper, expiries, writes in _functions(steps):
            out.append((chain, idx, int(expiry[0]), int(write[0])))
            expiry, write = _then(expiry, write, last, upper, expiries, writes)
        out.append((chain, idx + 1, int(expiry[0]), int(write[0])))
    columns = list(zip(*out)) or [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(np.array(c, dtype=np.int64), pa.int64()).cast(k) for c, k in zip(columns, kinds)],
                    names=["chain", "idx", "expiry", "written"])


def _entries(ranged: DataFrame, longest: int, path: str) -> dict[int, tuple[str, int, int]]:
    """The (key, expiry, write) each partition starts from, where it goes on with a key."""
    spark = ranged.sparkSession
    needed = ranged.select("_gs_part", "_gs_key", "_gs_us", "_gs_exp", "_gs_seed", "_gs_seed_w")
    needed.mapInArrow(_reporter(longest), _REPORT).write.parquet(path)
    reports = spark.read.schema(_REPORT).parquet(path)
    # one row per partition of the shuffle
    parts = sorted(reports.filter("kind = 0").drop("kind", "upper_us").collect(),
                   key=lambda r: r["part"])

    # partitions inside one key that starts in an earlier one: runs of them are chains
    links, starts = [], []
    entered: dict[int, tuple[int, int]] = {}  # position in ``parts`` -> (chain, idx)
    for i, (before, here) in enumerate(zip(parts, parts[1:]), 1):
        if not here["first_key"] == here["last_key"] == before["last_key"]:
            continue
        if i - 1 in entered:
            chain, idx = entered[i - 1]
            entered[i] = chain, idx + 1
        else:
            entered[i] = len(starts), 0
            starts.append((len(starts), 0, before["exit_us"], before["exit_written_us"]))
        links.append((here["part"], *entered[i], here["last_us"]))
    found = _chained(reports, links, starts, path) if links else {}

    entries: dict[int, tuple[str, int, int]] = {}
    for i, (before, here) in enumerate(zip(parts, parts[1:]), 1):
        if before["last_key"] == here["first_key"]:
            if i - 1 in entered:
                chain, idx = entered[i - 1]
                exits = found[chain, idx + 1]
            else:
                exits = before["exit_us"], before["exit_written_us"]
            entries[here["part"]] = (here["first_key"], *exits)
    return entries


def _chained(reports: DataFrame, links: list[tuple], starts: list[tuple],
             path: str) -> dict[tuple[int, int], tuple[int, int]]:
    """{(chain, idx): (expiry, write)} at the start of each link of a chain and behind its last.

    ``links`` and ``starts`` have at most a row per partition of the shuffle.
    """
    spark = reports.sparkSession
    linked = spark.createDataFrame(links, "part INT, chain INT, idx INT, last_us BIGINT")
    level = reports.filter("kind = 1").drop("last_us").join(F.broadcast(linked), "part").selectExpr(
        *[f.split()[0] for f in _STEPS.split(", ")])
    levels, longest = [level], 1 + max(idx for _, _, idx, _ in links)
    group = F.floor(F.col("idx") / _FAN).cast("int").alias("group")
    while longest > _FAN:
        folder = f"{path}-level-{len(levels)}"
        levels[-1].groupBy("chain", group).applyInArrow(_compose(_FAN), _STEPS).write.parquet(folder)
        levels.append(spark.read.schema(_STEPS).parquet(folder))
        longest = -(-longest // _FAN)
    values = spark.createDataFrame(starts, _VALUES)
    for level in reversed(levels):
        values = (level.groupBy("chain", group)
                  .cogroup(values.groupBy("chain", F.col("idx").alias("group")))
                  .applyInArrow(_evaluate, _VALUES))
    return {(r["chain"], r["idx"]): (r["expiry"], r["written"]) for r in values.collect()}
