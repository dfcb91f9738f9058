"""Plug-in models: embedders, cross-encoders, extractors and verifiers run over Arrow batches.

The callables are supplied by the caller. Only a deterministic hashed bag-of-words embedder is built in.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Embedder:
    name: str
    version: str
    dimensions: int
    embed: Callable[[pd.Series], list]


_REGISTRY: dict[str, Embedder] = {}
_DEFAULT: list[str] = []


def register_embedder(embedder: Embedder, default: bool = False) -> Embedder:
    _REGISTRY[embedder.version] = embedder
    if default or not _DEFAULT:
        _DEFAULT[:] = [embedder.version]
    return embedder


def get_embedder(version: str | None = None) -> Embedder:
    return _REGISTRY[version or _DEFAULT[0]]


def list_embedders() -> list[tuple[str, str, int, bool]]:
    return [(e.name, e.version, e.dimensions, v == _DEFAULT[0]) for v, e in sorted(_REGISTRY.items())]


class _Slots(dict):
    """Slot of each word, made when the word is first seen."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big") % self.dimensions
        return slot


#: Bytes outside of a-z, 0-9 and _, as spaces; the bytes of other characters are all among them.
_WORD_BYTES = bytes(b if b in b"abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256))


def hashed_embedder(dimensions: int = 64) -> Embedder:
    """Unit vectors of word counts; a word's slot is the first four bytes of its MD5 digest modulo the dimensions."""
    def embed(texts: pd.Series) -> list:
        slots, out = _Slots(dimensions), []
        for text in texts:
            words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
            idx = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
            v = np.bincount(idx, minlength=dimensions).astype("float64")
            norm = math.sqrt(np.dot(v, v))
            out.append(v / norm if norm else v)
        return out

    return Embedder("hashed-words", f"hashed-{dimensions}", dimensions, embed)


HASHED = register_embedder(hashed_embedder(), default=True)


#: Bytes of text that a model gets at a time; one longer text stays whole.
MODEL_BYTES = 4 << 20


def _by_bytes(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that column ``text`` holds about MODEL_BYTES: many long texts never stand in Python at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // MODEL_BYTES
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for start, end in zip(starts, [*starts[1:], len(part)], strict=True):
            yield batch.slice(start, end - start)


def embed_docs(docs: DataFrame, text: str = "content", embedder: Embedder | None = None, out: str = "embedding",
               keep_text: bool = False, kind: str = "float") -> DataFrame:
    """Add the vector and model version of each text, batch by batch; empty text gives a zero vector.

    A vector depends on its text alone, so the model gets equal texts of a batch once.

    Stored vectors hold floats. ``kind="double"`` keeps the model's own precision, where ties have to stay ties.
    """
    model = embedder or get_embedder()
    rest = [f for f in docs.schema if keep_text or f.name != text]
    schema = T.StructType([*rest, T.StructField(out, T.ArrayType(T.DoubleType() if kind == "double" else T.FloatType())), T.StructField("model_version", T.StringType())])
    names, version, dims, fn = [f.name for f in schema], model.version, model.dimensions, model.embed
    dtype = "float64" if kind == "double" else "float32"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches, text):
            coded = pc.fill_null(batch.column(text), "").dictionary_encode()
            texts, rows = coded.dictionary.to_pandas(), len(batch)
            blank = (texts == "").to_numpy()
            vecs = [np.zeros(dims, dtype=dtype) if b else np.asarray(v, dtype=dtype) for v, b in zip(fn(texts), blank)]
            flat = np.stack(vecs)[coded.indices.to_numpy()].ravel() if rows else np.zeros(0, dtype)
            made = {out: pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype="int32") * dims), pa.array(flat)),
                    "model_version": pa.array([version] * rows, pa.string())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)

    return docs.mapInArrow(run, schema)


def cross_encoder_column(score: Callable[[pd.Series, pd.Series], pd.Series], query: Column, text: Column) -> Column:
    """A (query, text) -> logit scorer as a column."""
    @F.pandas_udf("double")
    def logits(q: pd.Series, t: pd.Series) -> pd.Series:
        return score(q, t)

    return logits(query, text)


def shared_words_logit(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """A simple stand-in scorer: shared distinct words against query words, mapped to a logit around 0."""
    word = re.compile(r"[a-z0-9_]+")
    out = []
    for q, t in zip(queries, texts):
        qs = set(word.findall((q or "").lower()))
        hit = len(qs & set(word.findall((t or "").lower())))
        out.append(4.0 * hit / len(qs) - 2.0 if qs else -2.0)
    return pd.Series(out, dtype="float64")


def run_extractor(rows: DataFrame, extract: Callable[[pd.Series], pd.Series], text: str = "text",
                  out: str = "response") -> DataFrame:
    """Replace a text column by the structured response a caller's model gives for it."""
    schema = T.StructType([*[f for f in rows.schema if f.name != text], T.StructField(out, T.StringType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches, text):
            response = pa.array(extract(batch.column(text).to_pandas()), pa.string(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([response if n == out else batch.column(n) for n in names], names)

    return rows.mapInArrow(run, schema)


def run_verifier(rows: DataFrame, verify: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """(id, verdict, keep): only a verdict that says INVALID drops a row."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "verdict": verify(pdf).astype(str)})

    out = rows.mapInPandas(run, "id long, verdict string")
    return out.withColumn("keep", ~F.contains(F.upper("verdict"), F.lit("INVALID")))
