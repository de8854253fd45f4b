"""URL filters: a blocked Bloom filter before an exact hash join, without user functions.

The listed entries are canonical URL prefixes ``host/path``. A URL is expanded to the few
canonical keys that an entry could have: suffixes of its host, as many labels as listed hosts
have, times prefixes of its path, as long as listed paths are. The filter, whose size is
fixed, is broadcast and passes on keys that may be listed; an exact join on the key removes
what it passed wrongly. No listed key is ever missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]

# Blocks of 64 bits: 131,072 rows of two longs are the most that is ever broadcast. A list
# too long for them only makes the filter pass on more; the exact join stays exact.
MAX_BLOCKS = 1 << 17
_KEYS_PER_BLOCK = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? #, A-Z lower-cased; '' without."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; '' for a null or a URL without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    """(verdict, rule) pairs as a DataFrame."""
    return spark.createDataFrame(rules or RULES, "verdict STRING, rule STRING")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """Four of the 64 bits of a block."""
    bits = F.xxhash64(F.lit(2), key)
    out = F.lit(0).cast("long")
    for i in range(4):
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, word) rows of the filter of the column ``rule``; empty blocks have no row."""
    return (keys.groupBy(_block(F.col("rule"), blocks).alias("block"))
            .agg(F.bit_or(_mask(F.col("rule"))).alias("word")))


def expand(hosts: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """All keys under which a (host, path) may be listed: adds ``key``, a row for each."""
    labels = sorted({n for n, _ in shapes})
    lengths = sorted({n for _, n in shapes})
    suffixes = F.array(*[F.substring_index("host", ".", -n) for n in labels] or [F.lit("")])
    prefixes = F.array(*[F.substring("path", 1, n) for n in lengths] or [F.lit("")])
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return hosts.withColumn("key", F.explode(F.array_distinct(keys)))


def judge_urls(pages: DataFrame, rules: DataFrame, unlisted: str = "allow",
               max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Judge each page by the longest listed entry that fits its URL.

    ``pages`` has a column url, ``rules`` verdict and rule; all columns of pages stay, and
    host, path, rule (null if none fits) and verdict are added, in place of columns of those
    names. An entry fits its host and all subdomains, if the path starts with the entry's
    path. A null URL or one without :// has empty host and path and fits nothing. If an entry
    is listed twice, block counts. Equal rows get equal answers. Each different (host, path)
    is looked up once; entries may be many, but hosts of more than a few hundred labels or
    paths of as many different lengths would make the expansion long.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    rules = (rules.where("rule IS NOT NULL").groupBy("rule")
             .agg(F.max("verdict").alias("verdict")))
    path_at = F.locate("/", F.col("rule"))
    labels = F.size(F.split(F.substring_index("rule", "/", 1), "\\."))
    # at most labels x path lengths rows
    shapes = [tuple(r) for r in rules.select(
        labels.alias("n"), (F.length("rule") - path_at + 1).alias("p")).distinct().collect()]
    n_rules = rules.count()
    blocks = max(1, min(max_blocks, 1 << (-(-n_rules // _KEYS_PER_BLOCK)).bit_length()))
    parsed = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    keyed = expand(parsed.where("host <> ''").select("host", "path").distinct(), shapes)
    # the filter's rows are bounded by max_blocks, whatever the list
    may = (keyed.withColumn("block", _block(F.col("key"), blocks))
           .join(F.broadcast(bloom_filter(rules, blocks)), "block")
           .withColumn("mask", _mask(F.col("key")))
           .where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")))
    listed = (may.join(rules, may["key"] == rules["rule"])
              .groupBy("host", "path")
              .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
              .select("host", "path", "best.rule", "best.verdict"))
    return (parsed.join(listed, ["host", "path"], "left")
            .select(*pages.columns, "host", "path", "rule",
                    F.coalesce("verdict", F.lit(unlisted)).alias("verdict")))
