"""Best-fit packing of tokenised documents into sequences.

Bounded-space online best-fit: a packer holds a fixed number of open bins, kept by their free
space, with a bitset of the free spaces that occur. A piece goes into the bin where it leaves
the least space; if none can take it, a new bin opens, and if too many are open, the fullest
closes first. Pieces come in the order of their hashes.

Packers work side by side on groups of pieces, dealt out by hash. The number of groups follows from
the size of the texts, so a piece with its ids moves once, to the packer of its group, which also
writes the sequences: none spans groups.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gatesift.llm.common import give_back_memory, stored

CAPACITY = 2048
OPEN_BINS = 64
GROUP_PIECES = 5_000
TOKEN_BYTES = 4        # of text, on average, for the number of groups only
SPECIAL = "<|endoftext|>"
_IDS_AT_ONCE = 500_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Text -> ids (uint32), by the tokenizer file; its rank file encodes the same faster.

    The rank file knows no special token, so texts that spell it out take the tokenizer.
    """
    slow = []  # loaded only when it is needed
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            slow[:] = slow or [Tokenizer.from_file(path)]
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return encode


def cut(n_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    starts = [0, *range(first, n_tokens, capacity)]
    return list(zip(starts, np.diff([*starts, n_tokens]).tolist()))


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
             packed: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens, each document closed by id 0.

    Returns doc_id, row_id, piece, start, length, ids_crc32 and ids: an array or, if ``packed``,
    their bytes, two or four an id, as :func:`pack` takes them too. A null text is an empty one: a
    piece of one token. Repeated rows give their pieces again, under a row_id of their own, which
    holds for a table that is read the same way again; other columns of ``docs`` are not looked at;
    an empty table gives an empty one.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("row_id", T.LongType()),
                           T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType()),
                           T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            texts, first, size, held = batch.column(2), 0, 0, []
            for row in range(batch.num_rows):
                held.append(np.append(encode(texts[row].as_py() or ""), np.uint32(0)).astype("<u4"))
                size += len(held[-1])
                # a few documents at a time, so that many ids are never held at once
                if size > _IDS_AT_ONCE or row == batch.num_rows - 1:
                    yield pieces(batch.slice(first, len(held)), held)
                    first, size, held = row + 1, 0, []
        del encode
        _encoder.cache_clear()
        give_back_memory()

    def pieces(rows: pa.RecordBatch, held: list[np.ndarray]) -> pa.RecordBatch:
        places = [(row, number, start, length) for row, ids in enumerate(held)
                  for number, (start, length) in enumerate(cut(len(ids), capacity))]
        at, number, start, length = (np.array(c, np.int64) for c in zip(*places))
        crc = [zlib.crc32(held[row][i:i + n].tobytes()) for row, _, i, n in places]
        flat = np.concatenate(held)
        if packed:
            ids = _bytes_of(flat, length)
        else:
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()),
                                           pa.array(flat.view("<i4")))
        at = pa.array(at)
        return pa.RecordBatch.from_arrays(
            [rows.column(0).take(at), rows.column(1).take(at), pa.array(number, pa.int32()), pa.array(start),
             pa.array(length), pa.array(crc, pa.int64()), ids], names=schema.names)

    return (docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), "text")
            .mapInArrow(run, schema))


def _bytes_of(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive ids as a binary each: two bytes an id if they all fit, else four."""
    ids = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids
    ends = np.append(0, np.cumsum(lengths)) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)),
                                                             pa.py_buffer(ids.tobytes())])


def _ids_of(packed: list[bytes], lengths: list[int]) -> pa.Array:
    """The inverse for rows of several batches."""
    widths = {len(x) // n for x, n in zip(packed, lengths)}
    if len(widths) == 1:
        flat = np.frombuffer(b"".join(packed), f"<u{widths.pop()}").astype("<i4")
    else:
        flat = np.concatenate([np.frombuffer(x, f"<u{len(x) // n}").astype("<i4") for x, n in zip(packed, lengths)])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat))


def best_fit(lengths: list[int], capacity: int = CAPACITY,
             open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in arrival order."""
    bins, offsets = [], []
    by_space: dict[int, list[int]] = {}
    spaces = n_open = n_bins = 0  # spaces: bit s is set if an open bin has s free
    for length in lengths:
        fits = spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            if n_open == open_bins:
                fullest = (spaces & -spaces).bit_length() - 1
                by_space[fullest].pop()
                if not by_space[fullest]:
                    spaces ^= 1 << fullest
                n_open -= 1
            chosen, space = n_bins, capacity
            n_bins += 1
            n_open += 1
        bins.append(chosen)
        offsets.append(capacity - space)
        if space == length:
            n_open -= 1
        else:
            by_space.setdefault(space - length, []).append(chosen)
            spaces |= 1 << space - length
    return bins, offsets


def _pack_group(capacity: int, open_bins: int, columns: list[str], packed: bool):
    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("__group")[0].as_py()
        # the order of hashes, whatever order the rows came in
        order = pc.sort_indices(rows.select(["__order", "row_id", "piece"]), [
            ("__order", "ascending"), ("row_id", "ascending"), ("piece", "ascending")]).to_numpy()
        lengths = rows.column("length").to_numpy()[order]
        bins, offsets = best_fit(lengths.tolist(), capacity, open_bins)
        place = np.lexsort((offsets, bins))
        out = rows.select(columns).take(pa.array(order[place]))
        if packed:
            ids = _ids_of(out.column("ids").to_pylist(), lengths[place].tolist())
            out = out.set_column(out.schema.get_field_index("ids"), "ids", ids)
        out = out.append_column("sequence_id", pa.array((group << 32) + np.array(bins, np.int64)[place]))
        out = out.append_column("offset", pa.array(np.array(offsets, np.int64)[place]))
        give_back_memory()
        return out
    return run


def group_count(docs: DataFrame, group_pieces: int = GROUP_PIECES, capacity: int = CAPACITY) -> int:
    """Groups for the pieces of documents (column text), guessed from the size of their texts."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, -(-(n + size // (TOKEN_BYTES * capacity)) // group_pieces))


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         group_pieces: int = GROUP_PIECES, groups: int | None = None) -> DataFrame:
    """Put pieces into sequences: adds sequence_id and offset (long).

    ``pieces`` has row_id, piece and length (1 to ``capacity``); all its columns stay, ids that are
    bytes become arrays. Each row is an
    item, equal rows too. A packer holds its group, ``group_pieces`` on average, whatever the number
    of rows; each group wastes about half of its open bins' space at its end. ``groups`` is how many
    there are; without it the pieces are counted, which makes them twice. A partition of the result
    holds whole sequences, one after another in order of offset. An empty table stays empty; columns
    named like the new ones are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    if groups is None:
        groups = max(1, -(-pieces.count() // group_pieces))
    order = F.xxhash64("row_id", "piece")
    packed = "ids" in pieces.columns and isinstance(pieces.schema["ids"].dataType, T.BinaryType)
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*(ids if packed and f.name == "ids" else f for f in pieces.schema.fields),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return (pieces.withColumns({"__group": F.pmod(order, F.lit(groups)).cast("long"), "__order": order})
            .groupBy("__group").applyInArrow(_pack_group(capacity, open_bins, pieces.columns, packed), schema))


def packed_sequences(docs: DataFrame) -> DataFrame:
    """Documents as sequences, written: all pieces of one in one file, in order of offset.

    See :func:`tokenise` and :func:`pack` for the columns; ids move as bytes. ``docs`` is read twice,
    for the size of its texts and for the texts: give it a written table.
    """
    return stored(pack(tokenise(docs, packed=True), groups=group_count(docs)), "sequences")
