"""Model verdicts: a lookup that never fails a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.functions.text import has_content
from gatesift.operators.validate import decide, text_findings


def with_model_verdicts(df: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Add ``blocked`` and ``llm_score`` by key; rows without a verdict pass.

    ``verdicts`` has one row per key and ``blocked``, ``llm_score`` or both. Feed the new
    columns to ``validate_text(..., blocked="blocked", llm_score="llm_score")``.
    """
    known = verdicts.select(key, *[
        (F.col(name) if name in verdicts.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in (("blocked", "boolean"), ("llm_score", "double"))])
    joined = df.join(known, key, "left")
    return joined.select(
        *df.columns,
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        F.coalesce("llm_score", F.lit(1.0)).alias("llm_score"))


def decide_with_verdicts(findings: DataFrame, verdicts: DataFrame, key: str, **options) -> DataFrame:
    """Verdicts from :func:`gatesift.operators.validate.text_findings` and model verdicts by key.

    Texts were read before the join, so only their findings are moved.
    """
    known = with_model_verdicts(findings, verdicts, key)
    return decide(known, blocked="blocked", llm_score="llm_score", **options).drop("blocked")


def decide_with_scorer(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: str,
                       text: str = "text", **options) -> DataFrame:
    """Verdicts of texts that ``scorer: (key, text) -> (key, llm_score)`` scores.

    Both read the texts in passes of their own and meet by key without them. A scorer that is a
    column, such as a ``pandas_udf`` of the text, needs no key and no join: give it to
    :func:`gatesift.operators.validate.validate_text` as ``llm_score``.
    """
    scored = scorer(df.select(key, text).filter(has_content(text)))
    return decide_with_verdicts(text_findings(df, text), scored, key, **options)


def with_scorer(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: str,
                text: str = "text") -> DataFrame:
    """Score non-blank texts with ``scorer: (key, text) -> (key, llm_score)`` and join.

    The scorer may use a ``pandas_udf``; texts it leaves out count as 1.0.
    """
    scored = scorer(df.select(key, text).filter(has_content(text)))
    return with_model_verdicts(df, scored, key)
