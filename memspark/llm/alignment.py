"""Alignment of two tokenizers over a corpus, as Arrow columns.

A slice of texts is cut into stretches that begin with a space; both vocabularies start a new token there, so equal stretches of a
slice are encoded and aligned once. Their two lists of ids are flattened with the parent index of every id, ends are cumulative
byte widths restarted at every stretch, and a full outer hash join on (stretch, end) gives every place where a token of either
side ends: one row per link, as a pair of tokens overlaps in one run of bytes and that run ends where the earlier of the two
does. Rows found on both sides end a group. Each slice counts its pairs with ``Table.group_by``; Spark merges the counts.

Corpus-wide counts then return to the slices: each slice kept its documents as lists of stretches and its stretches as lists of
pairs, and meets the counts of its own pairs only. Nothing that grows with the corpus is broadcast or held by one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm import common, packing

#: Texts of so many bytes are aligned together; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: What a row of a slice is: a document with its stretches, a pair with its number, all stretches' pairs.
DOCUMENT, PAIR, STRETCHES = 0, 1, 2
_vocabularies: dict = {}


def _byte_of_symbol() -> dict[str, int]:
    """The printable symbols by which byte-level vocabularies write bytes: printable bytes of Latin-1 stand for themselves, the
    others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabularies:
    """Both vocabularies with the bytes of every id. ``a`` is the path of a byte-level vocabulary beside which a rank file of the
    same name lies, ``b`` that of a sentencepiece model."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        symbols = _byte_of_symbol()
        with open(a, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        self.a_width = np.zeros(max(entries.values()) + 1, np.int64)
        for token, i in entries.items():
            self.a_width[i] = len(token) if all(c in symbols for c in token) else len(token.encode())
        self.encode_a, _ = packing._encoder(a.removesuffix(".json") + ".tiktoken")
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.b_bytes = np.empty(self.b.get_piece_size(), object)
        for i in range(len(self.b_bytes)):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        self.b_width = np.array([len(x) for x in self.b_bytes])


def vocabularies(a: str, b: str) -> Vocabularies:
    if (a, b) not in _vocabularies:
        _vocabularies[a, b] = Vocabularies(a, b)
    return _vocabularies[a, b]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pa.array(values))


def encode_stretches(stretches: pa.Array, v: Vocabularies) -> tuple[pa.LargeListArray, pa.LargeListArray, np.ndarray]:
    """(ids of A, ids of B, which stretches keep their bytes) of distinct stretches, each of which begins with a space. A stretch that
    does not keep its bytes has no ids."""
    a, a_size = packing._encode_distinct(stretches, v.encode_a, v.a_width)
    raw = [x.as_py() for x in stretches]
    b_lists = v.b.encode([x[1:].decode() for x in raw], num_threads=1)
    b_size = np.fromiter(map(len, b_lists), np.int64, len(b_lists))
    b = np.fromiter((i for x in b_lists for i in x), np.int64, int(b_size.sum()))
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    sound = np.bincount(np.repeat(np.arange(len(raw)), b_size), v.b_width[b], len(raw)).astype(np.int64) == length
    if not sound.all() or b"".join(v.b_bytes[b]) != b"".join(raw):
        end = np.cumsum(b_size)
        sound = np.array([b"".join(v.b_bytes[b[e - n:e]]) == x for e, n, x in zip(end.tolist(), b_size.tolist(), raw, strict=True)], bool)
        a, a_size = a[np.repeat(sound, a_size)], a_size * sound
        b, b_size = b[np.repeat(sound, b_size)], b_size * sound
    return _lists(a.astype(np.int32), a_size), _lists(b.astype(np.int32), b_size), sound


class Links(NamedTuple):
    """Links in byte order, stretch by stretch, and the groups' text of every stretch."""
    stretch: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray  # per stretch
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: pa.Array


def _ends(ids: pa.LargeListArray, width: np.ndarray, at: str) -> pa.Table:
    """(doc, end, at): one row per id with its list's number, the byte where it ends in its list, and its place."""
    parent, flat = pc.list_parent_indices(ids), pc.list_flatten(ids)
    total = pc.cumulative_sum(pc.take(pa.array(width), flat))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), pc.take(ids.offsets, parent))
    return pa.table({"doc": parent, "end": pc.subtract(total, before), at: pa.array(np.arange(len(flat)))})


def _join(texts: pa.Array, sizes: np.ndarray, separator: str) -> pa.Array:
    """Runs of ``sizes`` texts each, joined."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(offsets, texts.cast(pa.large_string())), pa.scalar(separator, pa.large_string()))


def link(a: pa.LargeListArray, b: pa.LargeListArray, a_width: np.ndarray, b_width: np.ndarray) -> Links:
    """All links between two tokenizations of the same byte strings."""
    n = len(a)
    left, right = _ends(a, a_width, "a_at"), _ends(b, b_width, "b_at")
    ends = left.join(right, ["doc", "end"], join_type="full outer", use_threads=False, coalesce_keys=True)
    doc, end = ends["doc"].to_numpy(), ends["end"].to_numpy()
    order = pa.array(np.lexsort((end, doc)))
    a_at, b_at = (pc.take(ends[c].combine_chunks() if ends[c].num_chunks != 1 else ends[c].chunk(0), order) for c in ("a_at", "b_at"))
    both = np.flatnonzero(pc.and_(pc.is_valid(a_at), pc.is_valid(b_at)).to_numpy(zero_copy_only=False))
    doc = doc[order.to_numpy()]
    # a token that ends later covers the bytes before its end
    a_all, b_all = pc.fill_null_backward(a_at), pc.fill_null_backward(b_at)
    sides = [_join(pc.list_flatten(ids), np.diff(at.take(pa.array(both)).to_numpy() + 1, prepend=0), ",") for ids, at in ((a, a_at), (b, b_at))]
    n_groups = np.bincount(doc[both], minlength=n)
    texts = _join(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), n_groups, ";")
    return Links(doc, pc.take(pc.list_flatten(a), a_all).to_numpy(), pc.take(pc.list_flatten(b), b_all).to_numpy(),
                 pc.list_value_length(a).to_numpy().astype(np.int64), pc.list_value_length(b).to_numpy().astype(np.int64), n_groups, texts)


def cut(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(distinct stretches, stretch of every place, stretches per text) of the texts with a space before each; empty texts have
    none."""
    nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    spaced = pc.binary_join_element_wise(nothing, pc.fill_null(texts, "").cast(pa.large_string()), space).cast(pa.large_binary())
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset:spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    starts = packing.chunk_starts(data, offsets[:-1])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    place = np.append(starts, len(data)).astype(np.int64)
    stretches = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(data.tobytes())])
    filled = (np.diff(offsets) > 1)[owner]
    coded = (stretches if filled.all() else stretches.filter(pa.array(filled))).dictionary_encode()
    return coded.dictionary, coded.indices, np.bincount(owner[filled], minlength=len(texts))


def align_slice(batch: pa.RecordBatch, number: int, v: Vocabularies, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one slice (key, text): its documents, its pairs with their counts, its stretches."""
    distinct, of_place, n_places = cut(batch.column(1))
    a, b, sound = encode_stretches(distinct, v)
    links = link(a, b, v.a_width, v.b_width)
    of_place, docs = of_place.to_numpy().astype(np.int64), len(n_places)
    doc = np.repeat(np.arange(docs), n_places)
    whole = np.bincount(doc[~sound[of_place]], minlength=docs) == 0
    of_place, doc = of_place[whole[doc]], doc[whole[doc]]
    n_places = n_places * whole
    n_links = np.bincount(links.stretch, minlength=len(distinct))
    sums = [np.bincount(doc, x[of_place], docs).astype(np.int64) for x in (links.n_a, links.n_b, links.n_groups, n_links)]
    texts = _join(links.groups.take(pa.array(of_place)), n_places, ";").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[:docs + 1]
    view = memoryview(texts.buffers()[2] or b"")
    shas = [hashlib.sha256(view[s:e]).hexdigest() if k else "" for s, e, k in zip(at[:-1].tolist(), at[1:].tolist(), n_places.tolist(), strict=True)]

    # pairs of the slice: places of a stretch in documents, summed over its links
    times = np.bincount(of_place, minlength=len(distinct))
    pairs = pa.table({"a": links.a, "b": links.b, "n": times[links.stretch]}).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
    pair_a, pair_b, pair_n = (pairs[c].to_numpy() for c in ("a", "b", "n_sum"))
    code = pair_a.astype(np.int64) << 32 | pair_b
    order = np.argsort(code)
    pair_of_link = order[np.searchsorted(code, links.a.astype(np.int64) << 32 | links.b, sorter=order)]

    def rows(kind: int, size: int, **columns) -> pa.RecordBatch:
        columns |= {"slice": pa.array(np.full(size, number, np.int64)), "kind": pa.array(np.full(size, kind, np.int8))}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    yield rows(DOCUMENT, docs, key=batch.column(0), sha=pa.array(shas, pa.string()),
               items=pa.ListArray.from_arrays(offsets(n_places), pa.array(of_place.astype(np.int32))),
               **{c: pa.array(x) for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True)})
    yield rows(PAIR, len(pair_n), a=pa.array(pair_a), b=pa.array(pair_b), n=pa.array(pair_n), place=pa.array(np.arange(len(pair_n))))
    yield rows(STRETCHES, 1, items=pa.ListArray.from_arrays([0, len(pair_of_link)], pa.array(pair_of_link.astype(np.int32))),
               sizes=pa.ListArray.from_arrays([0, len(n_links)], pa.array(n_links.astype(np.int32))))


def slices(df: DataFrame, key: str, text: str, a: str, b: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of all slices, stored by the caller. Slices are numbered by partition, so the numbers hold within one stored table."""
    fields = [("slice", "long", pa.int64()), ("kind", "byte", pa.int8()), ("key", df.schema[key].dataType.simpleString(), None),
              ("n_a", "long", pa.int64()), ("n_b", "long", pa.int64()), ("n_groups", "long", pa.int64()), ("n_links", "long", pa.int64()),
              ("sha", "string", pa.string()), ("items", "array<int>", pa.list_(pa.int32())), ("sizes", "array<int>", pa.list_(pa.int32())),
              ("a", "int", pa.int32()), ("b", "int", pa.int32()), ("n", "long", pa.int64()), ("place", "int", pa.int32())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, v = TaskContext.get().partitionId() << 32, vocabularies(a, b)
        for batch in common.slices(batches, 1, slice_bytes):
            schema = pa.schema([(name, kind or batch.schema.field(0).type) for name, _, kind in fields])
            yield from align_slice(batch, number, v, schema)
            number += 1

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        rows, ", ".join(f"{name} {kind}" for name, kind, _ in fields))


def pair_counts(stored: DataFrame) -> DataFrame:
    """(a, b, count, best): corpus-wide links of every pair of ids, and whether no other pair of its b has more. A b has as many
    pairs as vocabulary A has ids at most."""
    counts = stored.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("count")).where("count > 0")
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(df: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """Per row: ``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose bytes a vocabulary does not keep, have no tokens: zeros and ''. Rows with equal or null keys
    are rows of their own, and each counts. Texts of any length stay whole. An empty table gives no rows. Other columns are not
    read. ``a`` and ``b`` are paths that every executor can read.
    """
    stored = common.stored(slices(df, key, text, a, b))
    own = stored.where(F.col("kind") == PAIR).select(F.col("slice").alias("of_slice"), "place", "a", "b")
    counts = own.join(pair_counts(stored), ["a", "b"]).select("of_slice", "place", "count", "best")
    texts = stored.where(F.col("kind") != PAIR).select("slice", "kind", "key", "n_a", "n_b", "n_groups", "n_links", "sha", "items", "sizes")
    kind = stored.schema["key"].dataType.simpleString()

    def summed(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        docs, own = rows.filter(pc.equal(rows["kind"], DOCUMENT)), rows.filter(pc.equal(rows["kind"], STRETCHES))
        pair_of_link, sizes = (pc.list_flatten(own[c]).to_numpy() for c in ("items", "sizes"))
        value = np.zeros((2, max(len(pairs), int(pair_of_link.max(initial=-1)) + 1)), np.int64)
        place, count = pairs["place"].to_numpy(), pairs["count"].to_numpy()
        value[0, place], value[1, place] = pairs["best"].to_numpy(), count
        upto = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(value[:, pair_of_link], axis=1)], axis=1)
        end = np.cumsum(sizes)
        per_stretch = upto[:, end] - upto[:, end - sizes]
        items, n = pc.list_flatten(docs["items"]).to_numpy(), pc.list_value_length(docs["items"]).to_numpy().astype(np.int64)
        upto = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(per_stretch[:, items], axis=1)], axis=1)
        end = np.cumsum(n)
        best, total = upto[:, end] - upto[:, end - n]
        return pa.table({"key": docs["key"], **{c: docs[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": best,
                         "count_sum": total, "groups_sha256": docs["sha"]})

    out = texts.groupBy("slice").cogroup(counts.groupBy("of_slice")).applyInArrow(
        summed, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("key", key)
