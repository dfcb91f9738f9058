"""Approximate nearest neighbours by cross-polytope hashing.

A hash table applies pseudo-random rotations (three rounds of random signs and a fast Hadamard transform) to the unit vectors
and takes two polytopes one after the other: the nearest signed axis of a rotation, and the nearest among the first few signed axes
of another. How many these are grows with the square root of the table, so that buckets get smaller as it grows. A query
probes the pairs of axes nearest to it in every table. The vectors in probed buckets are its candidates; they are ranked by the
exact inner product in double precision. Queries that find too few candidates probe more, in the end every bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm import common

#: Hash tables, and buckets that a query probes in each.
TABLES, PROBES = 24, 48
#: Rows whose probes are computed at a time.
PROBE_ROWS = 512
#: Vectors of a bucket that one task compares with the queries probing it.
BUCKET_ROWS = 4096
#: Queries that one task holds for a bucket.
QUERY_ROWS = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axis_scores(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Per row the coordinates on the 2 d' signed axes of a table's rotated space (d' the next power of two)."""
    d = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), d))
    x[:, :vectors.shape[1]] = vectors
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x /= np.where(norm > 0, norm, 1)
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def _valid(v: Column) -> Column:
    """Non-empty, without null or non-finite components, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def last_axes(n: int, d: int) -> int:
    """Axes of a table's second polytope for ``n`` vectors of ``d`` components."""
    most = max(0, int(d - 1).bit_length())
    return 1 << min(most, max(0, round(float(np.log2(max(1.0, np.sqrt(n) / 7))))))


def probed(x: np.ndarray, table: int, last: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first axis, second axis) of the ``probes`` nearest buckets of every row in a table, nearest first. A bucket is as far as
    the squares of the gaps between its axes' coordinates and the largest ones."""
    one, two = axis_scores(x, 2 * table, seed), axis_scores(x, 2 * table + 1, seed)
    half = two.shape[1] // 2
    two = np.concatenate([two[:, :last], two[:, half:half + last]], axis=1)
    if probes == 1:
        return np.arange(len(x)), one.argmax(1), two.argmax(1)
    best = [np.argsort(-y, axis=1, kind="stable")[:, :probes] for y in (one, two)]
    gaps = [np.take_along_axis(y, b, 1) for y, b in zip((one, two), best, strict=True)]
    gaps = [(g[:, :1] - g) ** 2 for g in gaps]
    cost = (gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(len(x), -1)
    nearest = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    row = np.repeat(np.arange(len(x)), nearest.shape[1])
    wide = best[1].shape[1]
    return row, best[0][row, (nearest // wide).ravel()], best[1][row, (nearest % wide).ravel()]


def _dealt(df: DataFrame, tables: int, last: int, probes: int, seed: int) -> DataFrame:
    """(id, vector, tab, axis, subs): ``df`` once per table and probed first axis, with the second axes probed beside it."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PROBE_ROWS):
                batch = whole.slice(start, PROBE_ROWS)
                x = _matrix(batch.column(1)).astype(np.float64)
                for t in range(tables):
                    row, axis, sub = probed(x, t, last, probes, seed)
                    order = np.lexsort((sub, axis, row))
                    row, axis, sub = row[order], axis[order], sub[order]
                    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (axis[1:] != axis[:-1])])
                    first = np.flatnonzero(fresh)
                    rows = pa.array(row[first])
                    subs = pa.ListArray.from_arrays(np.append(first, len(row)).astype(np.int32), pa.array(sub.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(first), t, np.int32)),
                         pa.array(axis[first].astype(np.int32)), subs], ["id", "vector", "tab", "axis", "subs"])

    id_type = df.schema["id"].dataType.simpleString()
    return df.select("id", "vector").mapInArrow(assign, f"id {id_type}, vector array<double>, tab int, axis int, subs array<int>")


def _buckets(subs: pd.Series) -> dict[int, np.ndarray]:
    """Rows by second axis."""
    n = subs.map(len).to_numpy()
    row, sub = np.repeat(np.arange(len(n)), n), np.concatenate(subs.tolist())
    order = np.argsort(sub, kind="stable")
    names, first = np.unique(sub[order], return_index=True)
    return dict(zip(names.tolist(), np.split(row[order], first[1:]), strict=True))


def _nearest(k: int):
    def nearest(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": queries["id"][:0], "class": vectors["id"][:0], "score": np.zeros(0)})
        if not len(queries) or not len(vectors):
            return empty
        q, v = np.stack(queries["vector"]).astype(np.float64), np.stack(vectors["vector"]).astype(np.float64)
        here, rows, cols = _buckets(vectors["subs"]), [], []
        for sub, asking in _buckets(queries["subs"]).items():
            if sub not in here:
                continue
            # the matrix product ranks roughly; what may be among the best is summed again in a fixed order, so that equal
            # vectors get equal scores wherever they are
            rough = q[asking] @ v[here[sub]].T
            if rough.shape[1] > k:
                cut = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
                row, col = np.nonzero(rough >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None])
            else:
                row, col = (x.ravel() for x in np.indices(rough.shape))
            rows.append(asking[row])
            cols.append(here[sub][col])
        if not rows:
            return empty
        row, col = np.concatenate(rows), np.concatenate(cols)
        exact = np.zeros(len(row))
        for d in range(q.shape[1]):
            exact += q[row, d] * v[col, d]
        ids = vectors["id"].to_numpy()[col]
        order = np.lexsort((ids, -exact, row))
        row, ids, exact = row[order], ids[order], exact[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        top = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
        return pd.DataFrame({"query_id": queries["id"].to_numpy()[row[top]], "class": ids[top], "score": exact[top]})

    return nearest


def _found(asking: DataFrame, index: DataFrame, k: int, tables: int, last: int, probes: int, seed: int) -> DataFrame:
    """(query_id, class, score): the best ``k`` in every cell that a query probes. A cell is a table's first axis, split by the
    numbers of its vectors and queries."""
    probing = common.stored(_dealt(asking, tables, last, probes, seed))
    index = index.where(F.col("tab") < tables)
    sizes = index.groupBy("tab", "axis").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("parts"))
    sizes = F.broadcast(common.stored(sizes))  # tables * 2 d' rows
    index = index.join(sizes, ["tab", "axis"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    load = probing.groupBy("tab", "axis").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("q_parts"))
    load = F.broadcast(common.stored(load))
    probing = probing.join(sizes, ["tab", "axis"]).join(load, ["tab", "axis"]).withColumn(
        "q_part", F.pmod(F.xxhash64("id"), F.col("q_parts")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    index = index.join(load, ["tab", "axis"]).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    cell = ["tab", "axis", "part", "q_part"]
    index = index.select("id", "vector", "subs", *cell).toDF("id", "vector", "subs", *[f"i_{c}" for c in cell])
    probing = probing.select("id", "vector", "subs", *cell)
    id_type = asking.schema["id"].dataType.simpleString()
    return probing.groupBy(*cell).cogroup(index.groupBy(*[f"i_{c}" for c in cell])).applyInPandas(
        _nearest(k), f"query_id {id_type}, class {id_type}, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` classes of every query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "class")
    found = found.groupBy("query_id", "class").agg(F.max("score").alias("score"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def products(df: DataFrame, vector: str, is_query: Column, tables: int = TABLES, probes: int = PROBES, seed: int = 0) -> tuple[int, int, int]:
    """(vectors, queries, inner products of the first pass) of a search, to judge its cost."""
    d = df.agg(F.max(F.size(vector))).first()[0] or 1
    rows = df.where(_valid(F.col(vector).cast("array<double>"))).select(
        F.monotonically_increasing_id().alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    n, asking = rows.count(), rows.where("asks")
    bucket = ["tab", "axis", "sub"]
    counts = [_dealt(x, tables, last_axes(n, d), p, seed).select("tab", "axis", F.explode("subs").alias("sub")).groupBy(*bucket).agg(
        F.count(F.lit(1)).alias(c)) for x, p, c in ((rows, 1, "x"), (asking, probes, "y"))]
    return n, asking.count(), counts[0].join(counts[1], bucket).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0


def search(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES,
           seed: int = 0) -> DataFrame:
    """The ``k`` nearest found of every query row: query_id, rank (from 1), ``key``, score (inner product, in double).

    Candidates are all rows but the query's own id; a query has ``k`` of them, or all if there are fewer. Ties go to the smaller id.
    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with a null id. Shorter
    vectors count as if zeros followed. Equal vectors are searched once and stand for their smallest ``k + 1`` ids, which is
    as many as a result can hold. Equal ids count once per distinct vector; as a query, an id asks with the smallest of its
    vectors. An empty table gives no rows. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = common.stored(rows.where(F.col("id").isNotNull() & _valid(F.col("vector"))))
    d = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("vector"))))

    one = rows.withColumn("digest", F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))).select("digest", "id", "vector")
    by_vector = Window.partitionBy("digest").orderBy("id")
    copies = common.stored(one.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1))
    heads = copies.where("place = 1").select("id", "vector")
    asking = common.stored(rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")))
    n = heads.count()
    last = last_axes(n, d)
    index = common.stored(_dealt(heads, tables, last, 1, seed))
    buckets = 4 * (1 << max(0, int(d - 1).bit_length())) * last
    found = common.stored(_best(_found(asking, index, k + 1, tables, last, probes, seed), k + 1))
    while True:
        enough = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k + 1, n))
        short = common.stored(asking.join(enough, "id", "left_anti"))
        if probes >= buckets or short.isEmpty():
            break
        probes = min(8 * probes, buckets)
        more = _found(short, index, k + 1, tables if probes < buckets else 1, last, probes, seed)
        found = common.stored(_best(found.union(more), k + 1))

    heads = copies.where("place = 1").select(F.col("id").alias("class"), "digest")
    named = found.select("query_id", "class", "score").join(heads, "class").join(
        copies.select("digest", F.col("id").alias("near")), "digest").where("near <> query_id")
    ranked = named.groupBy("query_id", "near").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "near")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("near").alias(key), "score")
