"""The queries of this subpackage, opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift.llm.ann import nearest_neighbours
from gatesift.llm.common import held_out, n_words, stored, table
from gatesift.llm.compression import score_quality
from gatesift.llm.conversation_repair import damaged, diagnose, repaired_digests, repaired_rows
from gatesift.llm.lm_scoring import score_difference
from gatesift.llm.mixing import mixed_rows, source_targets
from gatesift.llm.ngram_join import ngram_components
from gatesift.llm.packing import packed_sequences
from gatesift.llm.prefix_trie import ordered_turns, prefix_trie, with_family_heads
from gatesift.llm.quality_rules import apply_rules
from gatesift.llm.sharding import shard_records, written_shards
from gatesift.llm.simhash import simhash_components
from gatesift.llm.toxic_grammar import score_toxicity
from gatesift.llm.url_filter import judge_urls, rule_table

MIX_SHARDS = 16
OUTPUT_SHARDS = 40


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of texts that share 80 % of their shingles, and its links."""
    return ngram_components(table(spark, sf_dir, "documents"), with_links=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives to a mix of all sources at target weights."""
    sized = stored(table(spark, sf_dir, "documents").select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", n_words(F.col("text")).alias("size")),
        "sized")
    mix = stored(mixed_rows(sized, shards=MIX_SHARDS), "mix")
    taken = mix.groupBy("row.row_id").agg(F.sum("n_words").alias("taken"))
    sources = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    targets = source_targets(sources).select(F.col("source").alias("s"), "source_size", "target")
    return (sized.join(targets, F.col("source").eqNullSafe(F.col("s"))).join(taken, "row_id", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much likelier each document is in the language of the good ones than in all."""
    labels = table(spark, sf_dir, "labels")
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id")))
    return score_difference(table(spark, sf_dir, "documents"), good)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the pattern grammar."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and whether the rules keep it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).drop("text", "failed_rules")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed_sequences(docs).drop("row_id", "ids")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by compression."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shuffled shards of equal row counts."""
    key = ["doc_id", "size", "text_crc32"]
    text = F.coalesce("text", F.lit(""))
    digests = [(F.octet_length(text) + 16).cast("long").alias("size"),
               F.crc32(text.cast("binary")).alias("text_crc32")]
    records = table(spark, sf_dir, "documents").select("doc_id", *digests, "text")
    placed = written_shards(shard_records(records, key, OUTPUT_SHARDS))
    placed = placed.select("doc_id", *digests, "shard", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each vector whose id is divisible by 100."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).drop("url")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix that rebuilt conversations start with, and what sharing it saves."""
    turns = ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie(with_family_heads(stored(turns, "turns")))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of texts whose fingerprints differ in few bits."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and the cheapest edits that mend it."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(given)
    diagnosis = stored(diagnose(rows), "diagnosis")
    digests = repaired_digests(repaired_rows(rows, diagnosis))
    every = given.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = F.col("conv_id")
    found = diagnosis.join(digests.select(ids.alias("d"), "repaired_sha256"),
                           ids.eqNullSafe(F.col("d")), "left").drop("d").withColumnRenamed("conv_id", "f")
    return every.join(found, ids.eqNullSafe(F.col("f")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


REGISTRY = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixing": op2_mixing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sharding": op8_sharding,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_url_filter": op10_url_filter,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
    "op13_conversation_repair": op13_conversation_repair,
}
