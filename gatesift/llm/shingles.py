"""Words and word shingles of texts as 64-bit hashes, computed on whole byte arrays.

A word is a run of anything but 0x20 and 0x09 to 0x0D, with A-Z lower-cased; these are single
bytes in UTF-8, so texts need not be decoded. A word's hash is a polynomial over random
values of its bytes, mixed; a shingle's is a weighted sum of its words' hashes, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE_WORDS = 5
_CHUNK = 2_000_000  # bytes hashed at a time: some 40 bytes of work space each

_rng = np.random.Generator(np.random.PCG64(20240601))
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_PLACES = _rng.integers(0, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of the base, at least n of them."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _BASE)])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each hash over all 64 bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_words(raw: np.ndarray) -> np.ndarray:
    solid = _SOLID[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64)
    opens = np.flatnonzero(first[at])
    lengths = np.diff(opens, append=len(at))
    place = np.arange(len(at)) - np.repeat(opens, lengths)
    terms = _VALUES[raw[at]] * _power(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, opens) + lengths.astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of a text, in order. Long texts are cut between words."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= _CHUNK:
        return _hash_words(raw)
    out, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + _CHUNK)
        gaps = np.flatnonzero(~_SOLID[raw[end:]][:_CHUNK]) if end < len(raw) else []
        while end < len(raw) and not len(gaps):  # a word longer than a chunk
            end = min(len(raw), end + _CHUNK)
            gaps = np.flatnonzero(~_SOLID[raw[end:end + _CHUNK]])
        end += int(gaps[0]) if len(gaps) else 0
        out.append(_hash_words(raw[start:end]))
        start = end
    return np.concatenate(out)


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    if len(words) < width:  # the slices below would count from the end
        return np.zeros(0, np.uint64)
    sums = np.full(len(words) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        sums += words[k:len(words) - width + 1 + k] * _PLACES[k]
    return mix(sums)


def hashed_chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, words of each text) of a few texts at a time: many short ones, or a long one."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < _CHUNK // 4):
            size += len(texts[end]) + 1
            end += 1
        raw = b" ".join(texts[start:end])
        words = word_hashes(raw)
        if end - start == 1:
            counts = np.array([len(words)])
        else:
            first = _SOLID[np.frombuffer(raw, np.uint8)]
            first[1:] &= ~first[:-1].copy()
            ends = np.cumsum([len(t) + 1 for t in texts[start:end]])
            counts = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
        yield words, counts
        start = end


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted different shingles of each text; of fewer words, one for all; of none, empty."""
    out = []
    for words, counts in hashed_chunks(texts):
        windows, at = _windows(words, SHINGLE_WORDS), 0
        for n in counts.tolist():
            if n > SHINGLE_WORDS:
                own = np.sort(windows[at:at + n - SHINGLE_WORDS + 1])
                new = own[1:] != own[:-1]
                out.append(own if new.all() else own[np.append(True, new)])
            else:
                out.append(_windows(words[at:at + n], n) if n else np.zeros(0, np.uint64))
            at += n
    return out


def shingle_set(text: bytes) -> np.ndarray:
    return shingle_sets([text])[0]
