"""Keyword, rule and level dictionaries.

A keyword dictionary is a table of any length, for ``keyword_table_matches``. The detectors
themselves take a Python list, which becomes part of the plan: the caller's choice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift import rules


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """``keyword`` rows of a JSON array of strings; a missing file has no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], "keyword STRING")
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("keyword"))


def keywords_table(spark: SparkSession) -> DataFrame:
    """The built-in dictionary."""
    return spark.createDataFrame([(k,) for k in rules.KEYWORDS], "keyword STRING")


def rules_table(spark: SparkSession, profile: str = "text") -> DataFrame:
    """The signatures of a profile with their place in the report order."""
    rows = [
        (f.name, i, p, f.raw, "all" if f.every else "first")
        for f in rules.families(profile).values() for i, p in enumerate(f.patterns)
    ]
    return spark.createDataFrame(
        rows, "family STRING, position INT, pattern STRING, case_sensitive BOOLEAN, mode STRING")


def levels_table(spark: SparkSession) -> DataFrame:
    rows = [(n, lv.threshold, lv.deep_analysis, lv.rule_weight, lv.llm_weight)
            for n, lv in rules.LEVELS.items()]
    return spark.createDataFrame(
        rows, "level STRING, threshold DOUBLE, deep_analysis BOOLEAN, rule_weight DOUBLE, "
              "llm_weight DOUBLE")
