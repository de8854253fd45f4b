"""Quality classifier by compression.

Two Zstandard dictionaries are trained, one on good and one on bad labelled texts. A text that is
like the good ones compresses better with theirs. The normalised difference of both compressed
sizes, with the compressed size per byte beside it (degenerate text compresses far better than
prose with either), is calibrated into a score by a logistic regression on labelled rows that the
dictionaries were not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import give_back_memory, learn_from, stored
from gatesift.llm.logistic import Logistic

LEVEL = 6
# Bounds of what is learned from: labelled rows, and bytes of their whole texts. Rows that the
# second leaves no room for are left out whole.
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 24_000_000
# A dictionary's bytes, and of the stretches that it is made up of.
DICTIONARY_BYTES = 400_000
STRETCH_BYTES = 500
_TRAINED_AT_ONCE = 4_096  # whole texts are read in pieces of so many bytes


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on whole texts; of too few to train on, the texts themselves."""
    pieces = [raw[i:i + _TRAINED_AT_ONCE] for raw in map(str.encode, texts)
              for i in range(0, len(raw), _TRAINED_AT_ONCE)]
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 4)
    try:
        return zstandard.train_dictionary(size, pieces, k=min(STRETCH_BYTES, size // 8), d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(pieces)


class SizeFeatures:
    """By how much better a text compresses with one dictionary than with the other, and how well."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for raw in (good, bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=known, write_content_size=False))

    def __call__(self, text: str | None) -> tuple[float, float]:
        raw = (text or "").encode()
        good, bad = (len(c.compress(raw)) for c in self.compressors)
        return (bad - good) / max(good, bad), float(np.log((good + bad) / 2 / (len(raw) + 1)))


def _features(good: bytes, bad: bytes):
    @F.pandas_udf("difference double, ratio double")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        measure = SizeFeatures(good, bad)
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=["difference", "ratio"])
    return features


def _scores(good: bytes, bad: bytes, model: Logistic):
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = SizeFeatures(good, bad)
        for texts in batches:
            yield pd.Series(model.score([measure(t) for t in texts]))
        del measure
        give_back_memory()
    return scores


def _whole_rows(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Rows in the order of their hashed ids as long as their texts fit the bound."""
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen, room = [], most_bytes
    for doc_id, n in sizes:
        if n <= room:
            chosen.append(doc_id)
            room -= n
    return rows if len(chosen) == len(sizes) else rows.where(F.col("doc_id").isin(chosen))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality",
                sample_rows: int = SAMPLE_ROWS):
    """Learn from labelled rows that are not held out; returns a column function of a text.

    At most ``sample_rows`` of them, and ``SAMPLE_BYTES`` of whole texts: two thirds train the
    dictionaries, a third calibrates. What comes to the driver is bounded by the parameters of this
    module. Null texts and labels other than 0 and 1 are not learned from. With no rows of one
    label, all texts get one score: the smoothed share of label 1, 0.5 without any.
    """
    turn = F.pmod(F.xxhash64(F.lit("turn"), "doc_id"), F.lit(3))
    sample = stored(learn_from(docs, labels, label, sample_rows).where("text <> ''")
                    .withColumn("turn", turn), "quality-sample")
    texts = {0: [], 1: []}
    training = _whole_rows(sample.where("turn < 2"), SAMPLE_BYTES)
    for value, text in training.orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "text").collect():
        texts[value].append(text)
    if not texts[0] or not texts[1]:
        share = (len(texts[1]) + 1) / (len(texts[0]) + len(texts[1]) + 2)
        return lambda text: F.lit(float(share))
    good, bad = _dictionary(texts[1]), _dictionary(texts[0])
    measured = (sample.where("turn = 2").select("doc_id", "label", _features(good, bad)("text").alias("f"))
                .select("doc_id", "label", "f.difference", "f.ratio").orderBy("doc_id").collect())
    model = Logistic.fit(np.array([(r.difference, r.ratio) for r in measured]).reshape(-1, 2),
                         [r.label for r in measured])
    score = _scores(good, bad, model)
    return lambda text: score(text)


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text",
                  threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score every whole text: adds score (0 to 1) and predicted (1 if it is at least threshold).

    A null text scores like an empty one, by its sizes like any other; very long texts are compressed
    whole; equal texts get equal scores; of rows that share a labelled id one is learned from; columns named like the new ones are replaced; an empty table gives an empty one.
    """
    score = fit_quality(docs, labels, sample_rows=sample_rows)
    docs = docs.drop("score", "predicted")
    return (docs.withColumn("score", score(F.col(text)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
