"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift.session import shared_dir

# A word is a run of anything but these white space characters (Java, RE2 and Python syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet into the shared folder and read again.

    Cuts the lineage: a lost executor costs a read, not the whole history. The folder is the
    caller's ``spark.checkpoint.dir``; what is written there stays until that is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a row are not to be learned from: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def unit_hash(*columns) -> str:
    """SQL for a uniform number in [0, 1) that depends on the given SQL expressions only."""
    return f"(shiftrightunsigned(xxhash64({', '.join(columns)}), 11) / 9007199254740992D)"


def learn_from(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label), none of them held out.

    The rows whose hashed id is smallest, so reruns agree. The labels are chosen first and
    bounded by ``rows``; only those documents' texts are moved, and of rows that share an id one
    is left, so the bound holds whatever repeats. Ids with contradicting labels are left out.
    """
    value = F.col(label).cast("int")
    chosen = (labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
              .groupBy("doc_id").agg(F.min(value).alias("label"), F.max(value).alias("most"))
              .where("label = most").select("doc_id", "label")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(stored(chosen, "chosen"), "doc_id")
    return (texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
            .select("doc_id", "text", "label"))


def give_back_memory() -> None:
    """Return what a worker no longer uses to the system: workers stay, and later tasks differ."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
