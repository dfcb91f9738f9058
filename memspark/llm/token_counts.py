"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word between ASCII white space with a blank before it. The distinct pre-tokens of a batch form a trie, whose
nodes are made level by level from the sorted pre-tokens. The best unigram score and its number of tokens are computed once
per node, that is once per shared beginning, from the nodes above it; the count at a pre-token's last node is its token count.
"""

from __future__ import annotations

import pandas as pd
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import common
from memspark.llm.shingles import SEPARATORS, text_bytes
from memspark.llm.wordbag import prefix_sums, span_hashes

#: Where so few pre-tokens go on, each has left the shared part of the trie and is finished on its own.
FEW = 8
#: Added to a piece's rank before the logarithm (Zipf's law); score of each byte of a character that is no piece.
RANK_OFFSET, BYTE_SCORE = 2.7, -30.0


class Scores:
    """Pieces of a sentencepiece model with a score each: minus the logarithm of the rank, so frequent pieces score best."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score: dict[bytes, float] = {}
        rank = 0
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if piece:
                score.setdefault(piece, -float(np.log(rank + RANK_OFFSET)))
            rank += 1
        self.score = score
        pieces = sorted(score)
        end = np.cumsum([len(p) for p in pieces])
        hashes = span_hashes(prefix_sums(np.frombuffer(b"".join(pieces), np.uint8)), np.concatenate([[0], end[:-1]]), end)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.array([score[p] for p in pieces])[order]
        self.lengths = sorted({len(p) for p in pieces})
        self.longest = max(self.lengths[-1], 4)  # a character has four bytes at most
        bits = np.uint64(64 - 20)
        self.bits, self.first = bits, np.searchsorted(self.hashes >> bits, np.arange((1 << 20) + 1, dtype=np.uint64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Score of every hash; minus infinity for what is no piece."""
        top = (h >> self.bits).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        out = np.full(len(h), -np.inf)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            hit = self.hashes[at[open_]] == h[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out


_scores: dict = {}


def scores_of(path: str) -> Scores:
    if path not in _scores:
        _scores[path] = Scores(path)
    return _scores[path]


def finish(word: bytes, at: int, best: list[float], count: list[int], scores: Scores) -> int:
    """Token count of one pre-token from byte ``at`` on; ``best`` and ``count`` hold the best scores and their numbers of
    tokens at the places up to there."""
    for j in range(at + 1, len(word) + 1):
        top, n = -np.inf, 0
        for length in scores.lengths:
            if length > j:
                break
            value = scores.score.get(word[j - length:j])
            if value is not None and best[-length] + value > top:
                top, n = best[-length] + value, count[-length] + 1
        if j == len(word) or word[j] & 0xC0 != 0x80:
            size = 1
            while size < min(4, j) and word[j - size] & 0xC0 == 0x80:
                size += 1
            if best[-size] + size * BYTE_SCORE > top:
                top, n = best[-size] + size * BYTE_SCORE, count[-size] + size
        best, count = [*best[-scores.longest:], top], [*count[-scores.longest:], n]
    return count[-1]


def trie_counts(text: np.ndarray, start: np.ndarray, length: np.ndarray, scores: Scores) -> np.ndarray:
    """Token counts of pre-tokens (spans of ``text``) in ascending order of their bytes."""
    out = np.zeros(len(start), np.int64)
    if not len(start):
        return out
    total, tail = prefix_sums(text), (text & 0xC0) == 0x80
    width = scores.longest + 1
    node = np.zeros((width, len(start)), np.int64)  # of every pre-token, per level
    best: list[np.ndarray] = [np.zeros(1)] + [np.zeros(0)] * scores.longest
    count: list[np.ndarray] = [np.zeros(1, np.int64)] + [np.zeros(0, np.int64)] * scores.longest
    active = np.arange(len(start))
    for level in range(1, int(length.max()) + 1):
        active = active[length[active] >= level]
        if len(active) <= FEW:
            for i in active.tolist():
                at = [(x % width, node[x % width, i]) for x in range(max(0, level - width), level)]
                out[i] = finish(text[start[i]:start[i] + length[i]].tobytes(), level - 1, [float(best[x][y]) for x, y in at],
                                [int(count[x][y]) for x, y in at], scores)
            break
        parent, byte = node[(level - 1) % width, active], text[start[active] + level - 1]
        fresh = np.ones(len(active), bool)
        fresh[1:] = (parent[1:] != parent[:-1]) | (byte[1:] != byte[:-1])
        node[level % width, active] = np.cumsum(fresh) - 1
        head = active[fresh]  # one pre-token of every node
        at = start[head] + level
        top, n = np.full(len(head), -np.inf), np.zeros(len(head), np.int64)
        for size in scores.lengths:
            if size > level:
                break
            above = node[(level - size) % width, head]
            value = best[(level - size) % width][above] + scores.find(span_hashes(total, at - size, at))
            better = value > top
            top[better], n[better] = value[better], count[(level - size) % width][above[better]] + 1
        # whole characters that are no piece count as their bytes; a character ends where no byte of it follows
        ends = (at == len(text)) | ~tail[np.minimum(at, len(text) - 1)] | (length[head] == level)
        for size in range(1, min(4, level) + 1):
            whole = ends & ~tail[at - size]
            for b in range(1, size):
                whole &= tail[at - b]
            k = np.flatnonzero(whole)
            above = node[(level - size) % width, head[k]]
            value = best[(level - size) % width][above] + size * BYTE_SCORE
            better = value > top[k]
            top[k[better]], n[k[better]] = value[better], count[(level - size) % width][above[better]] + size
        best[level % width], count[level % width] = top, n
        done = active[length[active] == level]
        out[done] = n[node[level % width, done]]
    return out


def count_tokens(texts: pa.Array, scores: Scores) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, pre-tokens) of every text."""
    data, offsets = text_bytes(texts)
    separator = np.zeros(256, bool)
    separator[list(SEPARATORS)] = True
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:len(data)]
    end[:-1] &= ~inside[1:] | first[1:len(data)]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    per_text = np.diff(np.searchsorted(s, offsets))
    if not len(s):
        return np.zeros(len(per_text), np.int64), per_text
    bounds = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
    packed = data[np.repeat(s - bounds[:-1], e - s) + np.arange(bounds[-1])]
    coded = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))]
                                  ).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    w = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[:w[-1]]
    length = np.diff(w) + 1
    text = np.full(len(raw) + len(words), 32, np.uint8)
    at = np.cumsum(length) - length
    text[np.arange(len(raw)) + np.repeat(np.arange(1, len(words) + 1), length - 1)] = raw
    counts = trie_counts(text, at, length, scores)
    of_word = np.empty(len(words), np.int64)
    of_word[order.to_numpy()] = counts
    rows = np.repeat(np.arange(len(per_text)), per_text)
    return np.bincount(rows, of_word[coded.indices.to_numpy()], len(per_text)).astype(np.int64), per_text


def with_token_counts(df: DataFrame, text: str, vocabulary: str, tokens: str = "n_tokens", pretokens: str = "n_pretokens") -> DataFrame:
    """All columns of ``df`` and two counts (which replace columns of these names). Null texts and texts without words have
    none. ``vocabulary`` is the path of a sentencepiece model that every executor can read."""
    @F.pandas_udf("tokens long, pretokens long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
        parts = [count_tokens(b.column(0), scores_of(vocabulary)) for b in common.slices([column], 0, 4 << 20)]
        return pd.DataFrame({k: np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i, k in enumerate(("tokens", "pretokens"))})

    both = "both_counts_" + "_".join(df.columns)[:200]  # clashes with no column
    out = df.withColumn(both, counted(F.col(text).cast("string")))
    return out.withColumns({tokens: F.col(both)["tokens"], pretokens: F.col(both)["pretokens"]}).drop(both)
