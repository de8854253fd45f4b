"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes by a lexicon transducer: insult, threat, target, negation,
reported speech, clause end. Insults and their weights are learned from labels, as words and
as word beginnings; the other classes are closed lists. Three small transducers read a
clause's classes side by side and are composed into one by the product of their states: it writes,
for each insult or threat, whether it is negated, reported or neither, and where a clause ends,
whether the clause is aimed at somebody, named before or behind the insult. So a clause matches by
kind (plain, aimed, negated, reported), and weighs by kind what its strongest match does; words
outside of matched clauses count for nothing. What the clauses of a text weigh is calibrated into
a score by a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import give_back_memory, learn_from, stored
from gatesift.llm.logistic import Logistic

# Bounds of what is learned: labelled rows, and entries of the lexicon.
SAMPLE_ROWS = 10_000
LEXICON_ENTRIES = 5_000
PREFIXES = range(4, 9)
AIMED_FACTOR = 1.5  # of an insult that is aimed at somebody

INSULT, THREAT, TARGET, NEGATION, REPORT, END = "ITGNRE"

CLOSED = {
    THREAT: "kill hurt destroy shoot burn stab hang beat töten schlagen vernichten verbrennen "
            "tuer frapper détruire brûler matar golpear destruir quemar".split(),
    TARGET: "you your yours he him she her they them du dich dir ihr euch sie tu toi te vous il "
            "elle ils elles lui leur tú ti usted ustedes vosotros él ella ellos ellas".split(),
    NEGATION: "not no never nor neither without nicht kein keine nie ohne ne pas jamais sans "
              "nunca jamás sin tampoco".split(),
    REPORT: "said says say wrote writes called claimed quoted reported sagte sagt schrieb nannte "
            "behauptete dit écrit déclaré appelé dijo dice escribió llamó afirmó".split(),
}
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,|\n]")
_WORD = re.compile(r"[^\W\d_]+")

# ------------------------------------------------------------------ transducers
# A transducer is (start state, step): step(state, class) -> next state; what it says about
# an insult or threat is its state when that is read.


def _negation(state: int, symbol: str) -> int:
    """Words left under the last negation, which reaches over three."""
    return 0 if symbol == END else 3 if symbol == NEGATION else max(0, state - 1)


def _report(state: int, symbol: str) -> int:
    """1 after a verb of saying, to the end of the clause."""
    return 0 if symbol == END else 1 if symbol == REPORT else state


def _target(state: int, symbol: str) -> int:
    """1 after somebody has been addressed or named, to the end of the clause."""
    return 0 if symbol == END else 1 if symbol == TARGET else state


SYMBOLS = [INSULT, THREAT, TARGET, NEGATION, REPORT, END, ""]
KINDS = [kind + state for kind in (INSULT, THREAT) for state in ("plain", "aimed", "negated", "reported")]


def compose() -> dict[tuple[tuple[int, int, int], str], tuple[tuple[int, int, int], str]]:
    """The product machine: (states, class) -> (next states, what is written).

    An insult or threat is written as open where it is neither negated nor reported; the end of its
    clause writes what open ones are.
    """
    machine = {}
    for states in product(range(4), range(2), range(2)):
        for symbol in SYMBOLS:
            negated, reported, aimed = states
            written = ""
            if symbol in (INSULT, THREAT):
                written = symbol + ("negated" if negated else "reported" if reported else "open")
            elif symbol == END:
                written = "aimed" if aimed else "plain"
            machine[states, symbol] = ((_negation(negated, symbol), _report(reported, symbol),
                                        _target(aimed, symbol)), written)
    return machine


class Grammar:
    """The composed machine over a learned lexicon; turns a text into features."""

    WIDTH = len(KINDS) + 2
    _MOST_CACHED = 50_000  # words

    def __init__(self, words: dict[str, float], prefixes: dict[str, float]):
        self.words, self.prefixes = words, prefixes
        self.closed = {w: c for c, ws in CLOSED.items() for w in ws}
        self.machine = compose()
        self.cache: dict[str, tuple[str, float]] = {}

    def _look_up(self, token: str) -> tuple[str, float]:
        if not token[0].isalpha():
            return END, 0.0
        weight = self.words.get(token, 0.0)
        for n in PREFIXES:
            if n >= len(token):
                break
            weight = max(weight, self.prefixes.get(token[:n], 0.0))
        if weight > 0:
            return INSULT, weight
        kind = self.closed.get(token, "")
        return kind, 2.0 if kind == THREAT else 0.0

    def clauses(self, text: str | None) -> tuple[list[dict[str, float]], int]:
        """What each matched clause weighs by kind, and how many clauses there are."""
        tokens = _TOKEN.findall((text or "").lower())
        cache = self.cache
        if len(cache) > self._MOST_CACHED:
            cache.clear()
        for token in set(tokens):
            if token not in cache:
                cache[token] = self._look_up(token)
        out, number, states, matches = [], 0, (0, 0, 0), {}
        for symbol, weight in [*(cache[t] for t in tokens), (END, 0.0)]:
            if not symbol and states == (0, 0, 0):
                continue
            states, written = self.machine[states, symbol]
            if symbol == END:
                number += 1
                if matches:
                    out.append({k.replace("open", written): w for k, w in matches.items()})
                    matches = {}
            elif written:
                matches[written] = max(matches.get(written, 0.0), weight)
        return out, number

    def __call__(self, text: str | None) -> list[float]:
        """The sums of the clauses' weights by kind, the strongest clause, and what a clause weighs."""
        matched, number = self.clauses(text)
        sums = {kind: sum(c.get(kind, 0.0) for c in matched) for kind in KINDS}
        strongest = max((c.get(INSULT + "plain", 0.0) + AIMED_FACTOR * c.get(INSULT + "aimed", 0.0)
                         for c in matched), default=0.0)
        meant = sum(sums[i + k] for i in (INSULT, THREAT) for k in ("plain", "aimed"))
        return [math.log1p(sums[k]) for k in KINDS] + [strongest, meant / math.sqrt(number + 2)]


# --------------------------------------------------------------------- learning
def _patterns(text: str) -> set[str]:
    """Words of a text, with $ behind, and their beginnings."""
    out = set()
    for word in set(_WORD.findall(text.lower())):
        out.add(word + "$")
        out.update(word[:n] for n in PREFIXES if n < len(word))
    return out


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[label].update(_patterns(text))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({
            "pattern": pa.array(names, pa.string()),
            "clean": pa.array([counts[0][n] for n in names], pa.int64()),
            "toxic": pa.array([counts[1][n] for n in names], pa.int64())})


def learn_lexicon(rows: DataFrame, least_texts: int = 3, least_log_odds: float = 1.2):
    """Words and word beginnings that mark toxic texts, with their log-odds as weights.

    ``rows`` has text and label. The weight is a cautious one: the log-odds less 1.64
    standard errors, at least ``least_log_odds``.
    """
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1):
        return {}, {}
    n1, n0 = totals.get(1, 0) + 1, totals.get(0, 0) + 1
    counted = (rows.select("text", "label")
               .mapInArrow(_count_patterns, "pattern string, clean long, toxic long")
               .groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
               .where(F.col("toxic") >= least_texts))
    odds = F.log((F.col("toxic") + 0.5) / n1) - F.log((F.col("clean") + 0.5) / n0)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = (counted.withColumn("weight", odds - 1.64 * error).where(F.col("weight") > least_log_odds)
              .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "pattern").limit(LEXICON_ENTRIES).collect())
    words = {r.pattern[:-1]: r.weight for r in chosen if r.pattern.endswith("$")}
    return words, {r.pattern: r.weight for r in chosen if not r.pattern.endswith("$")}


def _udf(words, prefixes, model: Logistic | None):
    kind = "double" if model else "array<double>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(words, prefixes)
        for texts in batches:
            rows = [grammar(t) for t in texts]
            yield pd.Series(model.score(rows) if model else rows)
        del grammar
        give_back_memory()
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.7,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score every whole text: adds score (0 to 1) and predicted (1 if it is at least threshold).

    Learns from at most ``sample_rows`` labelled rows that are not held out, two thirds for
    the lexicon and a third for the calibration; null texts and labels other than 0 and 1 are
    left out. With one label only, all texts get one score: its smoothed share. A null text
    scores like an empty one; very long texts are read whole, a token at a time; equal texts get
    equal scores; of rows that share a labelled id one is learned from; columns named like the new
    ones are replaced; an empty table gives an empty one.
    """
    turn = F.pmod(F.xxhash64(F.lit("turn"), "doc_id"), F.lit(3))
    sample = stored(learn_from(docs, labels, "toxic", sample_rows)
                    .withColumn("turn", turn).repartition(12, "doc_id"), "toxic-sample")
    words, prefixes = learn_lexicon(sample.where("turn < 2"))
    measured = (sample.where("turn = 2")
                .select("doc_id", "label", _udf(words, prefixes, None)("text").alias("f"))
                .orderBy("doc_id").collect())
    model = Logistic.fit(np.array([r.f for r in measured]).reshape(-1, Grammar.WIDTH),
                         [r.label for r in measured])
    docs = docs.drop("score", "predicted")
    return (docs.withColumn("score", _udf(words, prefixes, model)(text))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
