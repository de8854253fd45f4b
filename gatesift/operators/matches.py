"""Long form of the detectors: which signatures and keywords occur where."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions import text as T
from gatesift.functions.detectors import stage


def rule_matches(df: DataFrame, text: str = "text", profile: str = "text") -> DataFrame:
    """One row per (row, signature it contains): ``family``, ``position``, ``pattern``.

    The rules are literals in the plan, so nothing is joined or shuffled. A family's
    list is walked only for texts that the family's combined test hits.
    """
    staged = stage(df, text, str(profile == "file").lower())
    kept = [c for c in df.columns if c != text]
    found = []
    for family in rules.families(profile).values():
        indexed = (f"transform({T.string_array(family.patterns)}, (p, i) -> named_struct("
                   f"'family', {T.quote(family.name)}, 'position', i, 'pattern', p))")
        found.append(
            f"CASE WHEN {staged.hit(family.name)} THEN filter({indexed}, "
            f"r -> contains({staged.target(family)}, r.pattern)) END")
    lists = staged.df.selectExpr(*kept, "flatten(array_compact(array("
                                 + ", ".join(found) + "))) AS _gs_found")
    # the plain generator would first filter on the list, and so build it twice
    return lists.selectExpr(*kept, "inline_outer(_gs_found)").filter("family IS NOT NULL")


def keyword_matches(df: DataFrame, text: str = "text",
                    keywords: Sequence[str] = rules.KEYWORDS) -> DataFrame:
    """One row per (row, dictionary keyword it contains as a whole word): ``keyword``.

    One-word keywords are intersected with the tokens of the row's own text; the few
    others are searched for, and hits are checked for word boundaries. The keywords become
    part of the plan; see :func:`keyword_table_matches` for a dictionary of any length.
    """
    single, other = T.split_keywords(keywords)
    kept = [c for c in df.columns if c != text]
    staged = df.select(*kept, F.expr(T.unicode_lower_sql(text)).alias("_gs_lower"))
    found = []
    if single:
        found.append(f"array_intersect({T.tokens_sql('_gs_lower')}, {T.string_array(single)})")
    found += [f"CASE WHEN {T.whole_word_sql('_gs_lower', w)} THEN array({T.quote(w)}) "
              f"ELSE {T.NO_STRINGS} END" for w in other]
    lists = staged.selectExpr(*kept, f"concat({', '.join(found or [T.NO_STRINGS])}) AS _gs_found")
    return lists.selectExpr(*kept, "explode_outer(_gs_found) AS keyword") \
                .filter("keyword IS NOT NULL")


def keyword_table_matches(df: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """The same for a dictionary that is a table of any length, with a column ``keyword``.

    Texts and keywords are cut into runs of word characters and runs of others. A keyword
    occurs as a whole word where as many consecutive runs as it has equal it, so the windows
    of those lengths that begin like a keyword are joined with the dictionary, which is broadcast
    unless it is large. The driver gets the different lengths, and the characters that keywords of
    each begin with. Null and empty keywords match nothing.
    """
    kept = [c for c in df.columns if c != text]
    entries = (keywords.select(F.expr(T.unicode_lower_sql("keyword")).alias("_gs_window"))
               .filter("_gs_window <> ''").distinct())
    kinds = (entries.groupBy(F.expr(f"size({T.runs_sql('_gs_window')})").alias("n"),
                             F.expr(f"_gs_window RLIKE {T.quote('^' + T.WORD)}").alias("word"))
             .agg(*_places("_gs_window"), F.min(F.length("_gs_window")).alias("least"),
                  _n_bytes("_gs_window")).collect())
    windows = [T.run_windows_sql("_gs_lower", kind.n, kind.word, [
        kind[f"_gs_place{i}"] for i in range(min(kind.least, _FRAGMENT))]) for kind in kinds]
    folded = df.select(*kept, F.expr(T.unicode_lower_sql(text)).alias("_gs_lower"))
    found = folded.selectExpr(
        *kept, f"explode(array_distinct(concat({', '.join(windows or [T.NO_STRINGS])}))) AS _gs_window")
    if sum(kind._gs_bytes for kind in kinds) <= _BROADCAST:
        entries = F.broadcast(entries)
    return found.join(entries, "_gs_window").select(*kept, F.col("_gs_window").alias("keyword"))


_FRAGMENT = 3        # characters that a pattern and a text with it share at least
_STRETCH = 65_536    # characters cut into fragments at a time
_BROADCAST = 32_000_000  # bytes of a dictionary that every task gets at a time


def _fragments_sql(text: str, places: list[list[int]]) -> str:
    """The different runs of characters of a text that have one of the code points of its place
    at each place, cut stretch by stretch."""
    n = len(places)
    found = (f"regexp_extract_all(substring({text}, i * {_STRETCH} + 1, {_STRETCH + n - 1}), "
             f"{T.quote(f'(?s)(?=({T.places_regex(places)}))')}, 1)")
    stretches = f"sequence(0, cast(greatest(length({text}) - 1, 0) / {_STRETCH} AS int))"
    return f"array_distinct(flatten(transform({stretches}, i -> array_distinct({found}))))"


def _places(column: str) -> list[Column]:
    """Aggregates: the code points that strings begin with, place by place."""
    return [F.collect_set(F.expr(f"ascii(substring({column}, {i + 1}, 1))")).alias(f"_gs_place{i}")
            for i in range(_FRAGMENT)]


def _n_bytes(column: str) -> Column:
    """Aggregate: about the memory that rows of a dictionary take."""
    return F.sum(F.octet_length(column) + 100).alias("_gs_bytes")


def rule_table_matches(df: DataFrame, rule_table: DataFrame, text: str = "text",
                       profile: str = "text") -> DataFrame:
    """The same as :func:`rule_matches` for rules that are a table of any length.

    ``rule_table`` has ``family``, ``position``, ``pattern`` and ``case_sensitive``; see
    :func:`gatesift.sources.dictionaries.rules_table`. A text that contains a pattern has each of its
    fragments of three characters, so patterns are found by one of them, the one with most
    punctuation: the different fragments of a text are joined with those of the table, and what
    meets is searched for in the text. How many different fragments a table has is bounded by its
    alphabet, not its length. The driver gets which fragment lengths (patterns may be shorter) and
    cases there are, with the characters at each place of their fragments: only such pieces are cut.
    The table is broadcast, a large one in parts, each with a pass over the texts: no text is shuffled.
    Patterns are lower-case unless case matters; null and empty ones match nothing.
    """
    kept = [c for c in df.columns if c != text]
    length = f"least(length(pattern), {_FRAGMENT})"
    parts = f"transform(sequence(1, length(pattern) - {length} + 1), i -> substring(pattern, i, {length}))"
    marks = f"transform({parts}, p -> struct(length(regexp_replace(p, '[\\\\p{{L}}\\\\p{{N}}_ ]', '')) AS n, p AS p))"
    entries = rule_table.filter("pattern <> ''").selectExpr(
        "family", "position", "pattern", "coalesce(case_sensitive, false) AS _gs_raw",
        f"array_max({marks}).p AS _gs_fragment")
    kinds = (entries.groupBy(F.length("_gs_fragment").alias("n"), "_gs_raw")
             .agg(*_places("_gs_fragment"), _n_bytes("pattern")).collect())
    folded = df.select(*kept, F.col(text).alias("_gs_text"), F.expr(T.fold_sql(text, profile)).alias("_gs_lower"))
    lists = []
    for kind in kinds:
        cut = _fragments_sql("_gs_text" if kind._gs_raw else "_gs_lower",
                             [kind[f"_gs_place{i}"] for i in range(kind.n)])
        lists.append(f"transform({cut}, f -> struct(f AS f, {str(kind._gs_raw).lower()} AS r))")
    if not lists:  # no rules
        return df.filter("false").select(*kept, *[
            F.lit(None).cast(rule_table.schema[c].dataType).alias(c) for c in ("family", "position", "pattern")])
    cut = folded.selectExpr(*kept, "_gs_text", "_gs_lower", f"inline(concat({', '.join(lists)})) AS (_gs_f, _gs_r)")
    meets = (F.col("_gs_f") == F.col("_gs_fragment")) & (F.col("_gs_r") == F.col("_gs_raw"))
    n = -(-sum(kind._gs_bytes for kind in kinds) // _BROADCAST)
    parts = [entries] if n == 1 else [
        entries.filter(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k) for k in range(n)]
    found = [cut.join(F.broadcast(part), meets)
             .filter("contains(CASE WHEN _gs_raw THEN _gs_text ELSE _gs_lower END, pattern)")
             .select(*kept, "family", "position", "pattern") for part in parts]
    return reduce(DataFrame.unionAll, found)
