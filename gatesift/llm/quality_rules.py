"""Quality rules: a threshold table compiled into one Spark projection.

No user functions, no shuffle: everything about a text is computed from its own arrays of
words and lines, inside one projection over the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
# Frequent short words of the languages of the corpus, lower case.
STOP_WORDS = ("the and of to in is a that it for was as on by with are this be "
              "der die und das ist nicht ein zu mit für auf von "
              "le la les et de des un une que est dans pour "
              "el los las que en por una con para no").split()

# (metric, least, greatest): a text whose metric is outside is not kept; None is no bound.
THRESHOLDS = [
    ("word_length", 1.5, 20.0),
    ("symbol_ratio", None, 0.08),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.60),
    ("upper_ratio", None, 0.50),
    ("line_words", 1.5, None),
]


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes a value once and uses it by name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words() -> str:
    """SQL: words that lie in a 5-word window found twice or more, from the array ``w``.

    Windows are compared by 64-bit hashes. Texts without a repeated window, most of them, are
    done after one hash set; in others, windows are sorted by hash, those with an equal
    neighbour are put back into text order, and each adds the words that the one before it
    did not cover.
    """
    hashes = ("transform(sequence(0, size(w) - 5), "
              "i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))")
    ordered = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"
    found = ("sort_array(transform(filter(transform(o, (x, j) -> named_struct('i', x.i, 'two', "
             "coalesce(get(o, j - 1).h = x.h, false) OR coalesce(get(o, j + 1).h = x.h, false))), "
             "x -> x.two), x -> x.i))")
    covered = ("aggregate(f, named_struct('end', -1, 'n', 0L), (a, i) -> named_struct('end', i + 5, "
               "'n', a.n + (i + 5 - greatest(a.end, i)))).n")
    repeated = _let(ordered, "o", _let(found, "f", covered))
    return ("if(size(w) < 5, 0L, " + _let(
        hashes, "h", f"if(size(array_distinct(h)) = size(h), 0L, {repeated})") + ")")


def _words() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return ("named_struct('n_words', CAST(size(w) AS BIGINT), "
            "'word_chars', CAST(length(array_join(w, '')) AS BIGINT), "
            f"'n_repeat_words', {_repeat_words()}, "
            f"'n_stop', CAST(size(filter(w, x -> lower(x) IN ({stop}))) AS BIGINT))")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct ``m`` of counts and ratios of the text column."""
    column = f"coalesce(`{text}`, '')"
    space = "[\\\\x20\\\\x09-\\\\x0D]"
    words = _let(f"array_remove(split({column}, '{space}+'), '')", "w", _words())
    lines = _let(f"filter(split({column}, '\\n', -1), x -> x RLIKE '{space.replace('[', '[^')}')", "l",
                 "named_struct('n_lines', CAST(size(l) AS BIGINT), "
                 "'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT))")
    symbols = (f"CAST(length({column}) - length(regexp_replace({column}, '[{SYMBOLS}]+', '')) "
               "AS BIGINT)")
    upper = f"length(regexp_replace({column}, '[^\\\\p{{Lu}}]+', ''))"
    return docs.withColumn("m", F.expr(_let(
        f"named_struct('w', {words}, 'l', {lines}, 's', {symbols}, 'u', {upper})", "r",
        "named_struct('n_words', r.w.n_words, 'word_chars', r.w.word_chars, 'n_symbols', r.s, "
        "'n_dup_lines', r.l.n_dup_lines, 'n_repeat_words', r.w.n_repeat_words, "
        "'word_length', r.w.word_chars / greatest(r.w.n_words, 1L), "
        "'symbol_ratio', r.s / greatest(r.w.word_chars, 1L), "
        "'stop_word_ratio', r.w.n_stop / greatest(r.w.n_words, 1L), "
        "'dup_line_ratio', r.l.n_dup_lines / greatest(r.l.n_lines, 1L), "
        "'upper_ratio', r.u / greatest(r.w.word_chars, 1L), "
        "'line_words', r.w.n_words / greatest(r.l.n_lines, 1L))")))


def _passes(metric: str, least: float | None, greatest: float | None) -> str:
    bounds = [f"m.{metric} >= {least}D"] * (least is not None)
    bounds += [f"m.{metric} <= {greatest}D"] * (greatest is not None)
    return " AND ".join(bounds)


def apply_rules(docs: DataFrame, text: str = "text", thresholds=None, min_words: int = 10,
                max_repeat_percent: int = 20) -> DataFrame:
    """Judge every whole text by the threshold table.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed (too
    few words, or too many of them in repeated 5-word windows), failed_rules (names of the
    metrics outside their thresholds) and kept (boolean). A null text counts as an empty one,
    which fails; equal rows get equal answers; columns named like the new ones are replaced;
    an empty table gives an empty one.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop("m", "base_failed", "failed_rules", "kept", *(c for c in new if c != text))
    rules = [(m, _passes(m, low, high)) for m, low, high in thresholds or THRESHOLDS]
    failed = ", ".join(f"if({test}, null, '{metric}')" for metric, test in rules)
    base = (f"m.n_words < {min_words} OR "
            f"100 * m.n_repeat_words > {max_repeat_percent} * m.n_words")
    # a one-row generator: what is read from m below does not compute it again
    measured = with_measures(docs, text).withColumn("m", F.explode(F.array("m")))
    return measured.select(
        *docs.columns, *[F.col(f"m.{c}") for c in new], F.expr(base).alias("base_failed"),
        F.expr(f"array_compact(array({failed}))").alias("failed_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
