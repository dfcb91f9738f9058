"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; other documents are unlabelled, as toxic ones may be among them. A linear
numpy classifier is fitted to the risk estimate pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)), where pi is
the class prior; when the second part turns negative, the step goes against it. Features are hashed words and word
beginnings, chosen by how much more often positives have them. Scoring is a map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm import common
from memspark.llm.shingles import mix
from memspark.llm.wordbag import distinct_words, prefix_sums, span_hashes

#: Hash space of the features, and the word beginnings (in bytes) that are features besides the whole word.
SPACE = 1 << 20
BEGINNINGS = (4, 5, 6, 7, 8)
#: Bounds of the fitting sample, and of the features kept.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 4000, 12000, 512
#: A feature's share of a document's words is worth at most 1, which it reaches at one word in so many.
FULL_AT = 50


@dataclass
class Model:
    features: np.ndarray  # ascending hashes
    weights: np.ndarray
    bias: float


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of distinct words."""
    total, start, end = prefix_sums(data), offsets[:-1], offsets[1:]
    features, words = [span_hashes(total, start, end) % np.uint64(SPACE)], [np.arange(len(start))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(end - start > k)
        features.append(mix(span_hashes(total, start[longer], start[longer] + k) + np.uint64(77)) % np.uint64(SPACE))
        words.append(longer)
    return np.concatenate(features).astype(np.int64), np.concatenate(words)


def feature_counts(texts: pa.Array, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the features in each text and the words per text; with ``known``, only these features, as
    their positions in it."""
    data, offsets, word, n = distinct_words(texts)
    feature, owner = word_features(data, offsets)
    if known is not None:
        at = np.searchsorted(known, feature)
        at[at == len(known)] = 0
        hit = known[at] == feature if len(known) else np.zeros(len(feature), bool)
        feature, owner = at[hit], owner[hit]
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(offsets)))
    per_word = np.diff(first)
    keep = per_word[word] > 0
    rows, word = np.repeat(np.arange(len(n)), n)[keep], word[keep]
    m = per_word[word]
    at = np.repeat(first[word] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
    pairs, counts = np.unique(np.repeat(rows, m) * SPACE + feature[at], return_counts=True)
    return pairs // SPACE, pairs % SPACE, counts, n


def _values(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, FULL_AT * counts / np.maximum(words, 1))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1,
             decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative positive-unlabelled logistic risk (full batch, Adam)."""
    w, m, v = np.zeros(positive.shape[1] + 1), np.zeros(positive.shape[1] + 1), np.zeros(positive.shape[1] + 1)
    w[-1] = -1.0

    def risk(x: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        z = sign * np.clip(x @ w[:-1] + w[-1], -30, 30)
        slope = -sign / (1 + np.exp(z))
        return np.log1p(np.exp(-z)).mean(), np.append(x.T @ slope, slope.sum()) / len(x)

    for step in range(1, steps + 1):
        _, up = risk(positive, 1.0)
        against, down = risk(positive, -1.0)
        total, all_down = risk(unlabelled, -1.0)
        rest = all_down - prior * down
        slope = prior * up + rest if total - prior * against >= 0 else -rest
        slope[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(df: DataFrame, key: str, text: str, labels: DataFrame, label: str, learn: Column) -> Model:
    """Fit on a bounded sample of the rows for which ``learn``, a condition on the key, holds.

    ``labels`` has the key and a label: 1 confirms a toxic row, other values and missing labels confirm nothing. Positives are
    the confirmed rows, unlabelled text is any rows; of more than the bounds, the smallest by hash of the key are taken. The
    prior is the share of 1 among the non-null labels. Without a positive or an unlabelled row all scores are about 0.
    """
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull())
    counted = known.agg(F.count(label), F.count_if(F.col(label) == 1)).first()
    prior = counted[1] / counted[0] if counted[0] else 0.0
    order = [F.xxhash64(key), F.col(key)]
    positive = known.where(F.col(label) == 1).select(key).distinct().orderBy(*order).limit(MOST_POSITIVE)
    other = df.where(learn & F.col(key).isNotNull()).select(key).distinct().orderBy(*order).limit(MOST_UNLABELLED)
    picked = common.stored(positive.withColumn("toxic", F.lit(True)).union(other.withColumn("toxic", F.lit(False))))
    texts = df.select(key, F.col(text).cast("string").alias("text"))
    sample = common.stored(texts.join(F.broadcast(picked), key).select("text", "toxic").repartition(
        common.shuffle_partitions(df.sparkSession)))  # broadcast: MOST_POSITIVE + MOST_UNLABELLED keys
    sizes = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not sizes[0] or not sizes[1]:
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 0, 4 << 20):
            row, feature, _, _ = feature_counts(batch.column(0), None)
            toxic = batch.column(1).to_numpy(zero_copy_only=False)[row]
            ids, at = np.unique(feature, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.bincount(at, toxic, len(ids)).astype(np.int64)),
                 pa.array(np.bincount(at, ~toxic, len(ids)).astype(np.int64))], ["feature", "p", "u"])

    counts = sample.mapInArrow(present, "feature long, p long, u long").groupBy("feature").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u")).where("p >= 4")
    lift = F.col("p") * F.log(((F.col("p") + 0.5) / (sizes[0] + 1)) / ((F.col("u") + 0.5) / (sizes[1] + 1)))
    best = counts.withColumn("lift", lift).where("lift > 0").orderBy(F.desc("lift"), "feature").limit(MOST_FEATURES)
    features = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 0, 4 << 20):
            row, at, count, n = feature_counts(batch.column(0), features)
            x = _values(count, n[row])
            split = np.searchsorted(row, np.arange(1, len(n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.split(at, split)), pa.array(np.split(x, split))], ["toxic", "at", "x"])

    parts = {True: [], False: []}
    for r in sample.mapInArrow(values, "toxic boolean, at array<long>, x array<double>").toLocalIterator():
        x = np.zeros(len(features), np.float32)  # at most MOST_POSITIVE + MOST_UNLABELLED rows of MOST_FEATURES
        x[r["at"]] = r["x"]
        parts[r["toxic"]].append(x)
    # sorted, so that the order in which tasks end does not matter
    positive, unlabelled = (np.frombuffer(b"".join(sorted(x.tobytes() for x in parts[k])), np.float32).reshape(
        -1, len(features)) for k in (True, False))
    weights, bias = fit_nnpu(positive, unlabelled, prior)
    return Model(features, weights, bias)


def score(model: Model, text: Column) -> Column:
    """Probability-like score of a text, 0 to 1; null and wordless texts get the score of a text without any feature."""
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = []
        for batch in common.slices([pa.RecordBatch.from_arrays([texts.cast(pa.string())], ["t"])], 0, 2 << 20):
            row, at, count, n = feature_counts(batch.column(0), model.features)
            z = model.bias + np.bincount(row, _values(count, n[row]) * model.weights[at], len(n))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return scored(text)
