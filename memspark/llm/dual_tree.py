"""Compression of vectors to codes: a codebook per part position, fitted by Lloyd's rounds over two trees.

Components become integers, vectors are cut into equal parts, and every part position has a codebook of at most 16 entries. Blocks
of vectors hold a tree over the parts of each position, with the bounding box and the componentwise sum of every node; they are
stored once. A round walks these trees together with a tree over the entries: a pair of nodes is dropped when its least distance
exceeds the greatest distance of another pair, a node with one entry left is assigned whole by its cached sum, and only leaves
that stay uncertain compare parts with entries, in integers. All bounds are integers too, so codes and sums are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import common

#: A block of vectors holds so many components at most (one longer vector is a block of its own); a leaf so many parts.
BLOCK_VALUES, LEAF = 1 << 20, 16
BLOCK = "points binary, places binary, low binary, high binary, total binary"


class Tree(NamedTuple):
    """Trees over the same number of points for every part position. Level l splits the points at ``bounds[l]``; nodes of all
    levels lie one behind the other, level l from 2**l - 1."""
    points: np.ndarray  # position, point in tree order, component
    places: np.ndarray  # position, point in tree order: its place before
    bounds: list[np.ndarray]
    low: np.ndarray  # position, node, component
    high: np.ndarray
    total: np.ndarray


def _bounds(n: int, leaf: int) -> list[np.ndarray]:
    levels = [np.array([0, n])]
    while -(-n // (len(levels[-1]) - 1)) > leaf:
        parts = 2 * (len(levels[-1]) - 1)
        levels.append(np.arange(parts + 1) * n // parts)
    return levels


def build(points: np.ndarray, leaf: int) -> Tree:
    """Trees over ``points`` (position, point, component): every node is halved along its widest component."""
    positions, n, width = points.shape
    bounds = _bounds(n, leaf)
    places = np.tile(np.arange(n), (positions, 1))
    points = points.copy()
    for at in bounds[:-1]:
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for p in range(positions):
            own = points[p]
            wide = (np.maximum.reduceat(own, at[:-1]) - np.minimum.reduceat(own, at[:-1])).argmax(1)
            order = np.lexsort((own[np.arange(n), wide[node]], node))
            points[p], places[p] = own[order], places[p][order]
    return Tree(points, places, bounds, *_summaries(points, bounds))


def _summaries(points: np.ndarray, bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low and high corner of each node's box and its sum; an empty node has the box of its neighbour and no sum."""
    low, high, total = [], [], []
    for at in bounds:  # no level ends with an empty node
        low.append(np.minimum.reduceat(points, at[:-1], axis=1))
        high.append(np.maximum.reduceat(points, at[:-1], axis=1))
        total.append(np.add.reduceat(points, at[:-1], axis=1) * (np.diff(at) > 0)[:, None])
    return tuple(np.concatenate(x, axis=1) for x in (low, high, total))


class Assigned(NamedTuple):
    whole: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # level, and positions, nodes, entries assigned as wholes
    position: np.ndarray  # of every part compared in an uncertain leaf
    place: np.ndarray  # its place in tree order
    entry: np.ndarray
    compared: int  # distances computed in leaves


def assign(tree: Tree, entries: Tree) -> Assigned:
    """The nearest entry of every part; among equally near ones the entry that comes first. The trees have the same positions."""
    positions = len(tree.points)
    deep, entry_deep = len(tree.bounds) - 1, len(entries.bounds) - 1
    where, node, other = np.arange(positions), np.zeros(positions, np.int64), np.zeros(positions, np.int64)
    level = entry_level = 0
    whole = []
    while True:
        a, b = node + (1 << level) - 1, other + (1 << entry_level) - 1
        low, high, entry_low, entry_high = tree.low[where, a], tree.high[where, a], entries.low[where, b], entries.high[where, b]
        near = np.maximum(np.maximum(entry_low - high, low - entry_high), 0)
        far = np.maximum(high - entry_low, entry_high - low)
        near, far = (near * near).sum(1), (far * far).sum(1)
        # pairs are sorted by position and node
        group = np.concatenate([[True], (where[1:] != where[:-1]) | (node[1:] != node[:-1])])
        first, group = np.flatnonzero(group), np.cumsum(group) - 1
        kept = near <= np.minimum.reduceat(far, first)[group]
        where, node, other, group = where[kept], node[kept], other[kept], group[kept]
        alone = np.bincount(group, minlength=len(first))[group] == 1
        at = entries.bounds[entry_level]
        settled = alone & (at[other + 1] - at[other] == 1)
        if settled.any():
            p = where[settled]
            whole.append((level, p, node[settled], entries.places[p, at[other[settled]]]))
            where, node, other = where[~settled], node[~settled], other[~settled]
        if not len(where) or (level == deep and entry_level == entry_deep):
            break
        if entry_level < entry_deep:
            entry_level += 1
            at = entries.bounds[entry_level]
            where, node = np.repeat(where, 2), np.repeat(node, 2)
            other = np.repeat(2 * other, 2) + np.tile([0, 1], len(other))
            there = at[other + 1] > at[other]
            where, node, other = where[there], node[there], other[there]
        if level < deep:
            level += 1
            where, other = np.tile(where, 2), np.tile(other, 2)
            node = np.concatenate([2 * node, 2 * node + 1])
            order = np.lexsort((node, where))
            where, node, other = where[order], node[order], other[order]
    none = np.zeros(0, np.int64)
    if not len(where):
        return Assigned(whole, none, none, none, 0)
    at, k = tree.bounds[deep], entries.points.shape[1]
    size = at[node + 1] - at[node]
    pair = np.repeat(np.arange(len(where)), size)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size - at[node], size)
    entry_at = entries.bounds[entry_deep][other]
    gap = tree.points[where[pair], place] - entries.points[where, entry_at][pair]
    best = np.full(positions * tree.points.shape[1], np.iinfo(np.int64).max)
    flat = where[pair] * tree.points.shape[1] + place
    np.minimum.at(best, flat, (gap * gap).sum(1) * k + entries.places[where, entry_at][pair])
    seen = np.flatnonzero(best < np.iinfo(np.int64).max)
    return Assigned(whole, seen // tree.points.shape[1], seen % tree.points.shape[1], best[seen] % k, len(pair))


def sums(tree: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(parts of every position and entry, their componentwise sums)."""
    found = assign(tree, entries)
    positions, k, width = entries.points.shape
    count, total = np.zeros((positions, k), np.int64), np.zeros((positions, k, width), np.int64)
    for level, p, node, entry in found.whole:
        at = tree.bounds[level]
        np.add.at(count, (p, entry), at[node + 1] - at[node])
        np.add.at(total, (p, entry), tree.total[p, node + (1 << level) - 1])
    group = found.position * k + found.entry
    count += np.bincount(group, minlength=positions * k).reshape(positions, k)
    order = np.argsort(group, kind="stable")
    if len(order):
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        own = np.add.reduceat(tree.points[found.position, found.place][order], first)
        total.reshape(-1, width)[group[order][first]] += own
    return count, total


def codes(tree: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every position and point, in the points' order before the tree was built."""
    found = assign(tree, entries)
    positions, n, _ = tree.points.shape
    code = np.zeros((positions, n), np.int64)
    for level, p, node, entry in found.whole:
        at = tree.bounds[level]
        size = at[node + 1] - at[node]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - at[node], size)
        code[np.repeat(p, size), place] = np.repeat(entry, size)
    code[found.position, found.place] = found.entry
    position = np.arange(positions)[:, None]
    original = np.empty_like(entries.points)
    original[position, entries.places] = entries.points
    gap = tree.points - original[position, code]
    out = np.empty((2, positions, n), np.int64)
    out[0][position, tree.places], out[1][position, tree.places] = code, (gap * gap).sum(2)
    return out[0], out[1]


def integers(vectors: pa.Array, scale: int, parts: int, width: int) -> np.ndarray:
    """(position, vector, component): floor(scale * x) of every component, zeros behind the end of shorter vectors."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), parts * width), np.int64)
    flat = np.floor(scale * pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.ascontiguousarray(out.reshape(len(vectors), parts, width).transpose(1, 0, 2))


def _pack(tree: Tree) -> list[pa.Array]:
    arrays = (tree.points, tree.places, tree.low, tree.high, tree.total)
    return [pa.array([np.ascontiguousarray(x, "<i8").tobytes()], pa.binary()) for x in arrays]


def _unpack(batch: pa.RecordBatch, i: int, parts: int, width: int) -> Tree:
    points, places, low, high, total = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in BLOCK_COLUMNS)
    points = points.reshape(parts, -1, width)
    n = points.shape[1]
    return Tree(points, places.reshape(parts, n), _bounds(n, LEAF), *(x.reshape(parts, -1, width) for x in (low, high, total)))


BLOCK_COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]


def blocks(kept: DataFrame, scale: int, parts: int, width: int) -> DataFrame:
    """(keys, labels, block) of ``kept`` (key, label, vector): one row per block of vectors."""
    step = max(1, BLOCK_VALUES // (parts * width))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                own = batch.slice(start, step)
                lists = [pa.ListArray.from_arrays([0, own.num_rows], pa.concat_arrays([own.column(c)])) for c in (0, 1)]
                tree = build(integers(own.column(2), scale, parts, width), LEAF)
                yield pa.RecordBatch.from_arrays([*lists, *_pack(tree)], ["keys", "labels", *BLOCK_COLUMNS])

    key, label = (kept.schema[c].dataType.simpleString() for c in ("key", "label"))
    return kept.mapInArrow(rows, f"keys array<{key}>, labels array<{label}>, {BLOCK}")


def one_round(stored: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round. Only sums leave the tasks, a row per position, entry and component of each task."""
    parts, k, width = codebooks.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = build(codebooks, 1)
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                more = sums(_unpack(batch, i, parts, width), entries)
                count += more[0]
                total += more[1]
        used = np.repeat(count.ravel() > 0, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used), pa.int64()), pa.array(np.repeat(count.ravel(), width)[used], pa.int64()),
                                          pa.array(total.ravel()[used], pa.int64())], ["place", "n", "total"])

    summed = stored.select(*BLOCK_COLUMNS).mapInArrow(partial, "place long, n long, total long").groupBy("place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = codebooks.copy()
    flat = out.reshape(-1)
    for r in summed.collect():  # at most a row per component of the codebooks
        flat[r["place"]] = int(r["total"]) // r["n"]
    return out


def compress(df: DataFrame, key: str, vector: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(``key``, code, error, label_error, codebooks_sha256) of every row whose ``vector`` is neither null nor holds null or
    non-finite components.

    The codebooks start with the vectors of the smallest keys (null keys last, rows with one key by their vectors) and hold fewer
    entries if there are fewer rows. Rows with equal or null keys are rows of their own. Vectors are as wide as the longest, cut
    to a multiple of ``parts``: shorter ones, empty ones too, count as if zeros followed. Equal labels, nulls among themselves,
    share the label's error. Components so large that a squared distance could exceed a long raise a ValueError before any round.
    An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    double = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kept = double.where(F.col("vector").isNotNull() & ~F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    longest, most = kept.agg(F.max(F.size("vector")), F.max(largest)).first()
    width = max(1, -(-(longest or 0) // parts))
    if most and 4 * parts * width * (most * scale + 1) ** 2 * entries >= 2**63:
        raise ValueError(f"components up to {most} are too large for squared distances in 64-bit integers")
    first = kept.orderBy(F.col("key").asc_nulls_last(), "vector", "label").limit(entries).select("vector").collect()
    if not first:
        codebooks = np.zeros((parts, 1, width), np.int64)
    else:
        codebooks = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), scale, parts, width)
    stored = common.stored(blocks(kept, scale, parts, width))
    for _ in range(rounds if first else 0):
        codebooks = one_round(stored, codebooks)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = build(codebooks, 1)
        for batch in batches:
            for i in range(batch.num_rows):
                code, error = codes(_unpack(batch, i, parts, width), tree)
                digits = [bytes(row).hex() for row in np.ascontiguousarray(code.T.astype(np.uint8))]
                keys, labels = (batch.column(c)[i].values for c in ("keys", "labels"))
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array(digits, pa.string()), pa.array(error.sum(0), pa.int64())],
                                                 ["key", "label", "code", "error"])

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("key", "label")}
    rows = common.stored(stored.mapInArrow(coded, f"key {kinds['key']}, label {kinds['label']}, code string, error long"))
    errors = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    sha = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist() if first else [])).encode()).hexdigest()
    return rows.join(errors, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
