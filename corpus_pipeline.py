"""The training-data pipeline: five operators, one after another, over the documents.

Each stage reads what the one before it kept, written as Parquet. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift.llm.common import n_words, stored, table
from gatesift.llm.compression import score_quality
from gatesift.llm.mixing import mixed_rows, words_of
from gatesift.llm.ngram_join import BROADCAST_ROWS, ngram_components
from gatesift.llm.packing import packed_sequences
from gatesift.llm.toxic_grammar import score_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts.

    It learns from the labelled rows among the documents of this stage.
    """
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't find toxic."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id.

    Documents without words are linked with nothing, so all stay; of rows that repeat an id
    and its text, one stays. Rows without an id can't be told apart, and stay.
    """
    groups = stored(ngram_components(docs).select("doc_id", "component_id"), "groups")
    out = _without(docs, groups.where("doc_id <> component_id").select("doc_id").distinct())
    repeated = stored(groups.where("doc_id IS NOT NULL").groupBy("doc_id").count()
                      .where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    again = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(out, repeated).unionByName(_without(again, groups.where(
        "doc_id <> component_id").select("doc_id").distinct()))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not listed; a list of at most a million ids is broadcast."""
    ids = stored(ids, "ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at target weights, in its order: what the blocks of its shards hold.

    A document that a block's end cuts is two rows, each with its part of the text (and, if there
    is such a column, its own n_chars); one that is taken more than once is as many rows.
    """
    mix = mixed_rows(docs.withColumn("size", n_words(F.col("text"))))
    text = words_of(F.col("row.text"), F.col("row.size"), F.col("from_word"), F.col("n_words"))
    cut = mix.select("row", "n_words", text.alias("part"))
    own = {"text": F.col("part")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_words") == F.col("row.size"), F.col("row.n_chars")).otherwise(
            F.char_length("part").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token ids, placed in sequences of 2048.

    A copy that the mix repeats has a row_id of its own.
    """
    return packed_sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

# Learned models and random orders are not expressible: tests compare stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
