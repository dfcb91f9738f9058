"""Word shingles of texts as 64-bit hashes, computed over whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SEPARATORS = (9, 10, 11, 12, 13, 32)

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes in a row, offsets of the texts); null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text); A-Z count as a-z."""
    data, offsets = text_bytes(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    separator = np.zeros(256, bool)
    separator[list(SEPARATORS)] = True
    value = np.arange(256, dtype=np.uint64)
    value[65:91] += np.uint64(32)
    inside = ~separator[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True  # a text start; also ends the word before
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    powers, inverse = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((value[data] + np.uint64(1)) * powers[:n], out=total[1:])
    hashes = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    per_text = np.diff(np.searchsorted(s, offsets))
    return hashes, per_text


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text in ascending order, all in a row; number of them per text). A shingle is ``k`` words
    in a row; a text of fewer words is one shingle; a text without words has none."""
    w, n = words(texts)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    text_of_word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    keep = place < counts[text_of_word]
    at = np.flatnonzero(keep)
    owner = text_of_word[at]
    have = np.minimum(n[owner], k)
    h = have.astype(np.uint64)
    padded = np.concatenate([w, np.zeros(k, np.uint64)])
    for j in range(k):
        factor = np.uint64(pow(int(BASE), 2 * j + 3, 1 << 64))
        h += np.where(j < have, padded[at + j] * factor, np.uint64(0))
    h = mix(h).view(np.int64)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], np.bincount(owner[fresh], minlength=len(n)).astype(np.int64)
