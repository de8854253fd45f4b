"""Language-model scoring by cross-entropy difference.

Two bigram models that match in everything but their text, a target's and the background's,
share one vocabulary: the words of all documents and one unknown word. A document's score is its
loss per token under the target model less that under the background model: the lower, the more
it is like the target.

Counts cover every row, word and pair; words and pairs are told apart by 64-bit hashes. They grow
with the corpus, and no task holds them all:

1. The documents are dealt to blocks of a few megabytes of text. A block sends each of its different
   words and pairs once, with its counts, to the task that owns that range of hashes, packed into
   sorted runs; so a frequent word is one entry a block, not one a token.
2. Each owner adds up its range and answers every run with the totals, in the order of the run: the
   keys needn't be sent again.
3. A block's texts are read again beside its answers, and scored from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import give_back_memory, stored
from gatesift.llm.shingles import hashed_chunks, mix

BLOCK_BYTES = 8_000_000      # of text, on average
OWNED_KEYS = 2_000_000       # words and pairs that a task adds up at a time, on average
TOKEN_BYTES = 6              # of text a token, for the number of tasks only
BEGIN = np.uint64(0x5851F42D4C957F2D)  # the word before a text
PAIR_WEIGHT, WORD_WEIGHT = 0.7, 0.29  # what is left is spread evenly over the vocabulary
BROADCAST_ROWS = 1_000_000
WORD, PAIR = 0, 1


def token_slots(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, previous word or text begin, pair) hashes of each token of several texts."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    opens = np.cumsum(counts) - counts
    before[opens[counts > 0]] = BEGIN
    return words, before, mix(before * np.uint64(3) ^ words)


def _encoded(column) -> list[bytes]:
    return [t.encode() if t else b"" for t in column.to_pylist()]


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words, words of each text) of a few rows at a time."""
    for start in range(0, batch.num_rows, 256):
        at = start
        for words, counts in hashed_chunks(_encoded(batch.column(text).slice(start, 256))):
            yield at, words, counts
            at += len(counts)


class _Block:
    """The tokens of some texts: their different words and pairs, sorted, and which each token is."""

    def __init__(self, texts: list[bytes]):
        parts = [(words, counts) for words, counts in hashed_chunks(texts)]
        none = np.zeros(0, np.uint64)
        words = np.concatenate([w for w, _ in parts]) if parts else none
        self.lengths = np.concatenate([c for _, c in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        word, before, pair = token_slots(words, self.lengths)
        self.opening = before == BEGIN
        self.keys, self.places = zip(*(np.unique(k, return_inverse=True) for k in (word, pair)))
        # every word before is a word of the same block; at an opening any place does
        last = max(0, len(self.keys[WORD]) - 1)
        self.before = np.minimum(np.searchsorted(self.keys[WORD], before), last)

    def counts(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(target, background) counts of the words, and of the pairs."""
        of_target = np.repeat(wanted, self.lengths)
        return [(np.bincount(place[of_target], minlength=len(key)), np.bincount(place, minlength=len(key)))
                for key, place in zip(self.keys, self.places)]


def _edges(owners: int) -> np.ndarray:
    """Where the hash range of each owner but the first begins."""
    return np.array([(k << 64) // owners for k in range(1, owners)], np.uint64)


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays as bytes: those of one place together, which compresses sorted and small numbers well."""
    planes = [np.ascontiguousarray(c.astype(np.uint64)[:, None].view(np.uint8).T) for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(-1, 8, n)
    return [np.ascontiguousarray(planes.T).view(np.uint64)[:, 0] for planes in data]


_RUNS = "block long, owner int, kind int, n long, run binary, tokens long, target long, texts long, targets long"
_ANSWERS = "block long, owner int, kind int, n long, totals binary, words long"


def _ask(owners: int):
    """(text, wanted, block) in the order of blocks -> a run for each owner, and a row of sums a block."""
    edges = _edges(owners)
    names = [c.split()[0] for c in _RUNS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()] + [pa.int64()] * 4

    def runs(block: int, texts: list[bytes], wanted: list[bool]) -> pa.RecordBatch:
        wanted = np.array(wanted, bool)
        own = _Block(texts)
        rows = []
        for kind, (target, background) in enumerate(own.counts(wanted)):
            keys = own.keys[kind]
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            rows += [(block, owner, kind, j - i, _packed(keys[i:j], target[i:j], background[i:j]), None, None, None, None)
                     for owner, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        filled = own.lengths > 0
        rows.append((block, -1, None, None, None, int(own.lengths.sum()), int(own.lengths[wanted].sum()),
                     int(filled.sum()), int((filled & wanted).sum())))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, texts, wanted = None, [], []
        for batch in batches:
            values = batch.column(0)
            for row, (flag, of) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if of != block:
                    if texts:
                        yield runs(block, texts, wanted)
                    block, texts, wanted = of, [], []
                texts.append((values[row].as_py() or "").encode())
                wanted.append(flag)
        if texts:
            yield runs(block, texts, wanted)
        give_back_memory()
    return run


def _add_up(rows: pa.Table) -> pa.Table:
    """The runs that one owner got -> the totals of their keys, in the order of each run."""
    sizes = rows.column("n").to_pylist()
    parts = [_unpacked(raw.as_py(), n) for raw, n in zip(rows.column("run"), sizes)]
    keys, target, background = (np.concatenate(c) for c in zip(*parts))
    different, place = np.unique(keys, return_inverse=True)
    totals = [np.bincount(place, weights=x, minlength=len(different)).astype(np.uint64) for x in (target, background)]
    ends = np.cumsum(sizes)
    answers = [_packed(*(t[place[end - n:end]] for t in totals)) for n, end in zip(sizes, ends)]
    words = np.zeros(len(sizes), np.int64)
    if rows.column("kind")[0].as_py() == WORD:
        words[0] = len(different)  # once an owner, for the size of the vocabulary
    out = rows.select(["block", "owner", "kind", "n"]).append_column("totals", pa.array(answers, pa.binary()))
    give_back_memory()
    return out.append_column("words", pa.array(words))


_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _score(sums: dict[str, int]):
    """A block's texts and its answers -> a row a text."""
    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
    even = (1 - PAIR_WEIGHT - WORD_WEIGHT) / (sums["words"] + 1)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block([(t.as_py() or "").encode() for t in texts.column("text")])
        order = answers.sort_by([("kind", "ascending"), ("owner", "ascending")])
        totals = []
        for kind in (WORD, PAIR):
            parts = [_unpacked(raw, n) for k, n, raw in zip(*(
                order.column(c).to_pylist() for c in ("kind", "n", "totals"))) if k == kind]
            found = [np.concatenate(c).astype(float) for c in zip(*parts)] or [np.zeros(0)] * 2
            if len(found[0]) != len(block.keys[kind]):
                raise ValueError("the documents changed between two readings: give a written table")
            totals.append(found)
        tokens = block.lengths
        text = np.repeat(np.arange(len(tokens)), tokens)
        losses = []
        for side, name in enumerate(("target", "background")):
            word, pair = totals[WORD][side], totals[PAIR][side]
            context = (np.where(block.opening, sums[f"{name}_texts"], word[block.before]) if len(text)
                       else np.zeros(0))
            p = (PAIR_WEIGHT * np.minimum(pair[block.places[PAIR]] / np.maximum(context, 1), 1.0)
                 + WORD_WEIGHT * word[block.places[WORD]] / max(1, sums[f"{name}_tokens"]) + even)
            losses.append(np.bincount(text, -np.log2(p), len(tokens)) / np.maximum(tokens, 1))
        give_back_memory()
        return pa.table([texts.column("doc_id").cast(pa.int64()), pa.array(tokens), *map(pa.array, losses),
                         pa.array(losses[0] - losses[1])], names=names)
    return run


def score_difference(docs: DataFrame, targets: DataFrame, block_bytes: int = BLOCK_BYTES,
                     owned_keys: int = OWNED_KEYS) -> DataFrame:
    """Cross-entropy difference of every document.

    ``docs`` has doc_id (long) and text, ``targets`` the doc_id of the documents that the
    target model is trained on; the background model is trained on all. Returns doc_id,
    n_tokens, target_loss and background_loss (bits a token) and score, their difference; all
    0 for a text that is null or without words. Repeated rows are counted and returned each;
    without targets, the target model is the even distribution. An empty table gives an empty
    one; further columns are not looked at. ``docs`` is read three times and must give the same
    rows each time, as a written table does. Very long texts are read whole, each in one task.
    """
    wanted = stored(targets.select("doc_id").where("doc_id IS NOT NULL").distinct()
                    .withColumn("wanted", F.lit(True)), "targets")
    few = wanted.count() <= BROADCAST_ROWS
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows = max(1, n * block_bytes // max(size, 1))
    owners = max(1, 2 * size // (TOKEN_BYTES * owned_keys))
    # a partition's rows are numbered from a multiple of 2**33
    number = F.monotonically_increasing_id()
    block = F.shiftleft(F.shiftright(number, 33), 33) + F.floor(number.bitwiseAND((1 << 33) - 1) / rows)
    dealt = docs.select("doc_id", "text", block.alias("block"))
    marked = dealt.join(F.broadcast(wanted) if few else wanted, "doc_id", "left").select(
        "text", F.coalesce("wanted", F.lit(False)).alias("wanted"), "block")
    if not few:
        marked = marked.repartition("block").sortWithinPartitions("block")  # the join has moved them
    runs = marked.mapInArrow(_ask(owners), _RUNS)
    asked = stored(runs, "runs")
    answers = stored(asked.where("owner >= 0").groupBy("owner", "kind").applyInArrow(_add_up, _ANSWERS), "answers")
    sums = asked.where("owner < 0").agg(
        F.sum("tokens").alias("background_tokens"), F.sum("target").alias("target_tokens"),
        F.sum("texts").alias("background_texts"), F.sum("targets").alias("target_texts")).first().asDict()
    sums = {k: v or 0 for k, v in {**sums, "words": answers.agg(F.sum("words")).first()[0]}.items()}
    return (dealt.groupBy("block").cogroup(answers.select("block", "owner", "kind", "n", "totals").groupBy("block"))
            .applyInArrow(_score(sums), _SCORES))
