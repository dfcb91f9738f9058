"""Distinct words of Arrow text batches, with hashed features of each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from memspark.llm.shingles import BASE, _power_tables, mix, text_bytes


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capital letters of Latin-1 in UTF-8."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes of all words in a row, their lengths, words per text). A word is a run of ASCII letters and of bytes beyond
    ASCII, so the bytes of all words are those inside one: no index of each byte is built."""
    data, offsets = text_bytes(texts)
    n = len(data)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    data = _folded(data)
    inside = (data >= 0x80) | ((data >= 97) & (data <= 122))
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    s = np.flatnonzero(start)
    return data[inside], np.flatnonzero(end) + 1 - s, np.diff(np.searchsorted(s, offsets))


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the distinct words in a row, their offsets, distinct word of every word, words per text)."""
    packed, lengths, n = word_spans(texts)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    d = coded.dictionary
    d_offsets = np.frombuffer(d.buffers()[1], np.int64)[d.offset:d.offset + len(d) + 1] if len(d) else np.zeros(1, np.int64)
    d_data = np.frombuffer(d.buffers()[2] or b"", np.uint8)[:d_offsets[-1]]
    return d_data, d_offsets, coded.indices.to_numpy(), n


def prefix_sums(data: np.ndarray) -> np.ndarray:
    powers, _ = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal spans get equal hashes in any buffer."""
    _, inverse = _power_tables(len(total))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * BASE)
