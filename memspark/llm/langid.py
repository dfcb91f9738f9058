"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get one probability per language, by expectation maximisation over all segmentations
of a bounded sample. A text's likelihood under a language is the product over its words of the summed probability of every
segmentation, computed by the forward algorithm. Words are scored once per batch, for all languages at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm import common
from memspark.llm.wordbag import _folded, distinct_words, prefix_sums, span_hashes

#: Rounds of expectation maximisation; pseudo-count of every piece; longer words are fitted in parts of so many bytes.
ROUNDS, SMOOTHING, FITTED_BYTES = 3, 0.1, 64
#: Probability of a character that is no piece, in every language.
UNKNOWN = 1e-7
#: Where so few words of a batch go on, they are finished one after the other.
FEW = 8
#: Bytes of text that a task splits into words and scores at a time.
SLICE = 2 << 20
SLOTS = 1 << 20


class Pieces:
    """The lower-case letter pieces of a sentencepiece model; a word start counts as a blank before the word."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = set()
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            piece = model.id_to_piece(i)
            rest = piece.removeprefix("▁")
            if rest and not rest.isalpha():
                continue
            raw = _folded(np.frombuffer(rest.encode(), np.uint8)).tobytes()
            texts.add((b" " if rest != piece else b"") + raw)
        self.texts = sorted(t for t in texts if t)
        self.index = {t: i for i, t in enumerate(self.texts)}
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        end = np.cumsum([len(t) for t in self.texts])
        self.lengths = sorted({len(t) for t in self.texts})
        self.longest = max(self.lengths[-1], 4)  # a character has four bytes at most
        hashes = span_hashes(prefix_sums(data), np.concatenate([[0], end[:-1]]), end)
        self.hashes, order = np.sort(hashes), np.argsort(hashes)
        self.ids = order
        slot = (self.hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        self.slots = np.full(SLOTS, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(slot))[::-1]
        self.crowded = np.bincount(slot, minlength=SLOTS) > 1

    def __len__(self) -> int:
        return len(self.texts)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of every hash, or -1."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        at = self.slots[slot]
        hit = (at >= 0) & (self.hashes[at] == h)
        found = np.where(hit, self.ids[at], -1)
        again = np.flatnonzero(self.crowded[slot] & ~hit)
        if len(again):
            place = np.minimum(np.searchsorted(self.hashes, h[again]), len(self.hashes) - 1)
            found[again] = np.where(self.hashes[place] == h[again], self.ids[place], -1)
        return found


_pieces: dict = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _with_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a blank before each, longest first: (bytes, starts, lengths) and nothing else changes."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    n = n[order] + 1
    start = np.cumsum(n) - n
    out = np.full(int(n.sum()), 32, np.uint8)
    inner = n - 1
    at = np.repeat(start + 1 - (np.cumsum(inner) - inner), inner) + np.arange(int(inner.sum()))
    src = np.repeat(offsets[:-1][order] - (np.cumsum(inner) - inner), inner) + np.arange(int(inner.sum()))
    out[at] = data[src]
    return out, start, n, order


def log_likelihoods(data: np.ndarray, offsets: np.ndarray, pieces: Pieces, probabilities: np.ndarray, chunk: int = 20000) -> np.ndarray:
    """Log of the summed probability of all segmentations, per word (rows) and language (columns of ``probabilities``)."""
    out = np.zeros((len(offsets) - 1, probabilities.shape[1]))
    padded = np.vstack([probabilities, np.zeros((1, probabilities.shape[1]))])  # the last row is for -1, no piece
    text, start, n, order = _with_starts(data, offsets)
    for c in range(0, len(order), chunk):
        s, m = start[c:c + chunk], n[c:c + chunk]
        lo, hi = s[0], s[-1] + m[-1]
        out[order[c:c + chunk]] = _forward(text[lo:hi], s - lo, m, pieces, padded)
    return out


def _finish(word: bytes, at: int, window: list[np.ndarray], logs: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log of the sum for one word from byte ``at`` on; ``window`` has the sums at the places up to there, divided by the
    exponential of ``logs``."""
    for j in range(at + 1, len(word) + 1):
        now = np.zeros(p.shape[1])
        for length in pieces.lengths:
            if length > j:
                break
            i = pieces.index.get(word[j - length:j])
            if i is not None:
                now = now + window[-length] * p[i]
        if j == len(word) or word[j] & 0xC0 != 0x80:
            size = 1
            while size < min(4, j) and word[j - size] & 0xC0 == 0x80:
                size += 1
            now = now + window[-size] * UNKNOWN
        if now.max() > 0 and j % 4 == 0:
            scale = now.max()
            now, window, logs = now / scale, [x / scale for x in window], logs + np.log(scale)
        window = [*window[-pieces.longest:], now]
    return np.log(np.maximum(window[-1], 1e-300)) + logs


def _forward(text: np.ndarray, start: np.ndarray, n: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Words are ordered longest first, so the words that go on after a step are the first ones."""
    total = prefix_sums(text)
    tail = (text & 0xC0) == 0x80  # bytes inside a character
    alive = np.searchsorted(-n, -np.arange(n[0] + 2), side="right")  # words of at least so many bytes
    width = pieces.longest + 1
    window = np.zeros((width, len(n), p.shape[1]))
    window[0] = 1.0
    logs, result = np.zeros((len(n), 1)), np.zeros((len(n), p.shape[1]))
    for j in range(1, n[0] + 1):
        k = alive[j]
        s = start[:k]
        if k <= FEW:
            for i in range(k):
                before = [window[x % width, i] for x in range(max(0, j - width), j)]
                result[i] = _finish(text[s[i]:s[i] + n[i]].tobytes(), j - 1, before, logs[i], pieces, p)
            break
        now = np.zeros((k, p.shape[1]))
        for length in pieces.lengths:
            if length > j:
                break
            found = pieces.find(span_hashes(total, s + j - length, s + j))
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                now[hit] += window[(j - length) % width, hit] * p[found[hit]]
        whole = np.ones(k, bool)  # does a character end here?
        more = alive[j + 1] if j + 1 < len(alive) else 0
        whole[:more] = ~tail[start[:more] + j]
        for size in range(1, min(4, j) + 1):  # the character itself, if it is no piece
            first = ~tail[s + j - size]
            for b in range(1, size):
                first &= tail[s + j - b]
            at = np.flatnonzero(first & whole)
            now[at] += window[(j - size) % width, at] * UNKNOWN
        if j % 4 == 0:
            scale = now.max(1, keepdims=True)
            scale[scale == 0] = 1
            now /= scale
            window[:, :k] /= scale
            logs[:k] += np.log(scale)
        window[j % width, :k] = now
        done = slice(more, k)
        result[done] = np.log(np.maximum(now[done], 1e-300)) + logs[done]
    return result


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, word of every part): words cut into parts of FITTED_BYTES or a little more, between characters."""
    bounds, owner = [0], []
    for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while end - start > FITTED_BYTES + 3:
            start += FITTED_BYTES
            while data[start] & 0xC0 == 0x80 and start < end - 1:
                start += 1
            bounds.append(start)
            owner.append(i)
        bounds.append(end)
        owner.append(i)
    return np.array(bounds, np.int64), np.array(owner, np.int64)


def expected_counts(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected number of uses of every piece over all segmentations of the weighted words, for one language. Characters that
    are no piece count as in the forward sums."""
    counts = np.zeros(len(pieces) + 1)
    text, start, n, order = _with_starts(data, offsets)
    tail = np.append((text & 0xC0) == 0x80, False)  # bytes inside a character
    p = np.append(p, 0.0)

    def unknown(s: np.ndarray, j: int, size: int) -> np.ndarray:
        """Words whose bytes j - size to j are one character."""
        whole = ~tail[s + j - size] & ~tail[s + j]
        for b in range(1, size):
            whole &= tail[s + j - b]
        return np.flatnonzero(whole)

    for c in range(0, len(order), 4000):
        s, m, w = start[c:c + 4000], n[c:c + 4000], weight[order[c:c + 4000]]
        total, longest = prefix_sums(text), int(m[0])
        edges = []
        forward = np.zeros((longest + 1, len(m)))
        forward[0] = 1
        for j in range(1, longest + 1):
            k = int(np.searchsorted(-m, -j, side="right"))
            for length in pieces.lengths:
                if length > j:
                    break
                found = pieces.find(span_hashes(total, s[:k] + j - length, s[:k] + j))
                hit = np.flatnonzero(found >= 0)
                forward[j, hit] += forward[j - length, hit] * p[found[hit]]
                edges.append((j, length, hit, found[hit]))
            for size in range(1, min(4, j) + 1):
                hit = unknown(s[:k], j, size)
                forward[j, hit] += forward[j - size, hit] * UNKNOWN
        backward = np.zeros((longest + 1, len(m)))
        backward[m, np.arange(len(m))] = 1
        at = len(edges)
        for j in range(longest, 0, -1):
            for size in range(1, min(4, j) + 1):
                hit = unknown(s[:int(np.searchsorted(-m, -j, side="right"))], j, size)
                backward[j - size, hit] += backward[j, hit] * UNKNOWN
            while at and edges[at - 1][0] == j:
                at -= 1
                _, length, hit, found = edges[at]
                backward[j - length, hit] += backward[j, hit] * p[found]
        z = np.maximum(forward[m, np.arange(len(m))], 1e-300)
        for j, length, hit, found in edges:
            use = w[hit] * forward[j - length, hit] * p[found] * backward[j, hit] / z[hit]
            counts += np.bincount(found, use, len(counts))
    return counts[:-1]


@dataclass
class Model:
    languages: list[str]
    probabilities: np.ndarray  # piece by language
    vocabulary: str


def fit(df: DataFrame, key: str, text: str, lang: str, vocabulary: str, learn: Column, most_documents: int = 400) -> Model:
    """Fit on at most ``most_documents`` rows per language (by smallest hash of their key) among those for which ``learn``, a
    condition on the key, holds and that have a language and a text."""
    rows = df.where(learn & F.col(key).isNotNull() & F.col(lang).isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    ids = rows.select(F.col(key).alias("key"), F.col(lang).alias("lang")).distinct().withColumn(
        "place", F.row_number().over(order)).where(F.col("place") <= most_documents).drop("place")
    ids = common.stored(ids)  # most_documents rows per language
    texts = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(ids), "key").select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, 4 << 20):
            langs = batch.column(0).to_pylist()
            data, offsets, word, n = distinct_words(batch.column(1))
            names = sorted(set(langs))
            owner = np.repeat([names.index(x) for x in langs], n)
            pairs, counts = np.unique(owner * (len(offsets)) + word, return_counts=True)
            words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.copy()), pa.py_buffer(data.copy())])
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in pairs // len(offsets)], pa.string()),
                 words.take(pa.array(pairs % len(offsets))).cast(pa.binary()), pa.array(counts)], ["lang", "word", "n"])

    words = common.stored(sample.mapInArrow(split, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(
        common.shuffle_partitions(df.sparkSession)))
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    size = len(pieces_of(vocabulary))
    p = np.full((size, len(languages)), 1.0 / max(size, 1))
    for _ in range(ROUNDS if languages else 0):
        def expect(frames: Iterator[pd.DataFrame], p: np.ndarray = p) -> Iterator[pd.DataFrame]:
            pieces = pieces_of(vocabulary)
            for frame in frames:
                for name, part in frame.groupby("lang"):
                    raw = part["word"].tolist()
                    data = np.frombuffer(b"".join(raw), np.uint8)
                    offsets, word = _parts(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
                    c = expected_counts(data, offsets, part["n"].to_numpy(float)[word], pieces,
                                        p[:, languages.index(name)])
                    used = np.flatnonzero(c > 0)
                    yield pd.DataFrame({"lang": name, "piece": used, "n": np.round(c[used] * 1e6).astype(np.int64)})

        # whole millionths, so that sums do not depend on the order of the tasks
        sums = words.mapInPandas(expect, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        c = np.full((size, len(languages)), SMOOTHING)
        for r in sums.toLocalIterator():  # pieces times languages
            c[r["piece"], languages.index(r["lang"])] += r["n"] / 1e6
        p = c / c.sum(0)
    return Model(languages, p, vocabulary)


def predict(model: Model, text: Column, with_background: bool = False) -> Column:
    """struct(lang, score, evidence): the likeliest language and its posterior probability under equal priors; ties go to the
    first by name. ``evidence`` is how far the text's log-likelihood under that language exceeds the one under a background in
    which all pieces are equally probable (null if not asked for). A null text, a text without a letter, or a model without
    languages gives ``und`` and 0."""
    known_languages = len(model.languages)

    @F.arrow_udf("lang string, score double, evidence double")
    def predicted(texts: pa.Array) -> pa.Array:
        names, scores, evidence = [], [], []
        pieces = pieces_of(model.vocabulary)
        probabilities = model.probabilities
        if with_background:
            probabilities = np.column_stack([probabilities, np.full(len(pieces), 1 / len(pieces))])
        for batch in common.slices([pa.RecordBatch.from_arrays([texts.cast(pa.string())], ["t"])], 0, SLICE):
            column = batch.column(0)
            data, offsets, word, n = distinct_words(column)
            if not model.languages or not len(word):
                logs = np.zeros((len(n), known_languages + with_background or 1))
            else:
                per_word = log_likelihoods(data, offsets, pieces, probabilities)
                row = np.repeat(np.arange(len(n)), n)
                logs = np.stack([np.bincount(row, per_word[word, k], len(n)) for k in range(per_word.shape[1])], 1)
            background, logs = logs[:, -1], logs[:, :known_languages or 1]
            best = logs.argmax(1)
            more = logs.max(1) - background
            score = 1 / np.exp(np.maximum(logs - logs.max(1, keepdims=True), -700)).sum(1)
            for i, t in enumerate(column):
                known = bool(model.languages) and n[i] > 0 and any(c.isalpha() for c in t.as_py())
                names.append(model.languages[best[i]] if known else "und")
                scores.append(float(score[i]) if known else 0.0)
                evidence.append(float(more[i]) if known and with_background else None)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64())],
                                          ["lang", "score", "evidence"])

    return predicted(text)
