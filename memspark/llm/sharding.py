"""Consistent-hash ring with virtual nodes and bounded loads.

Every row hashes to a position on a ring that ``n_shards * virtual_nodes`` hashed points divide into arcs; an arc belongs
to the shard at its clockwise end. A shard holds at most its bound. Of what lies on its arcs it keeps as much as fits, in
ring order; the overflow of an arc continues clockwise to the next arcs whose shards have room. Only counts per ring
segment leave the executors; their number depends on the ring alone, not on the data.
"""

from __future__ import annotations

from collections import deque

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm import common

RING = 1 << 32
#: The ring is also cut into this many equal cells, so that a segment never holds a large share of the rows.
CELLS = 4096


def ring_segments(n_shards: int, virtual_nodes: int, seed: int = 0) -> list[tuple[int, int, int, int]]:
    """(cell, start, end, shard) of every ring segment in clockwise order; ``end`` is exclusive."""
    points = sorted(
        (xxhash.xxh64_intdigest(f"{seed}:{s}:{v}") % RING, s) for s in range(n_shards) for v in range(virtual_nodes)
    )
    width = RING // CELLS
    cuts = sorted({c * width for c in range(CELLS)} | {p + 1 for p, _ in points if p + 1 < RING} | {0})
    segments, k = [], 0
    for start, end in zip(cuts, [*cuts[1:], RING], strict=True):
        while k < len(points) and points[k][0] < start:
            k += 1
        segments.append((start // width, start, end, points[k % len(points)][1]))
    return segments


def bounds(total: int, n_shards: int, load_factor: float) -> list[int]:
    """Most rows per shard. At load factor 1 the bounds add up to ``total`` and differ by one at most."""
    low, extra = divmod(total, n_shards)
    if load_factor <= 1:
        return [low + (s < extra) for s in range(n_shards)]
    return [max(int(load_factor * total / n_shards), low + 1)] * n_shards


def overflow_plan(segments: list[tuple], counts: list[int], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(segment, first rank, end rank, shard, first slot): where the rows of each segment go, by rank within it."""
    room, used = list(limits), [0] * len(limits)
    plan: list[tuple[int, int, int, int, int]] = []

    def place(segment: int, rank: int, n: int, shard: int) -> None:
        plan.append((segment, rank, rank + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    spill = []
    for i, (segment, n) in enumerate(zip(segments, counts, strict=True)):
        kept = min(n, room[segment[3]])
        if kept:
            place(i, 0, kept, segment[3])
        spill.append(n - kept)
    waiting: deque[list[int]] = deque()  # overflow on its way clockwise: segment, next rank, rows left
    for turn in range(2):  # what reaches the end of the list goes on at its start
        for i, segment in enumerate(segments):
            while waiting and room[segment[3]]:
                at, rank, left = waiting[0]
                n = min(left, room[segment[3]])
                place(at, rank, n, segment[3])
                waiting[0][1:] = [rank + n, left - n]
                if n == left:
                    waiting.popleft()
            if turn == 0 and spill[i]:
                waiting.append([i, counts[i] - spill[i], spill[i]])
    return plan


def shard(df: DataFrame, key: str, text: str, n_shards: int, virtual_nodes: int = 64, load_factor: float = 1.0,
          seed: int = 0) -> DataFrame:
    """Place every row on one of ``n_shards`` shards.

    Returns ``key``, size (UTF-8 bytes of the text + 16; null text: 16), text_crc32, home_shard (the ring's choice before
    bounds), shard, slot (gapless from 0 within a shard). With load factor 1 the shards' row counts differ by one at most;
    with a larger one a shard holds at most that multiple of the mean and fewer rows leave their home. Null keys are
    placed by their text. Repeated rows are rows of their own, next to each other on the ring. An empty table gives no rows.
    Other columns are not read.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(key).alias("key"), common.utf8_bytes(F.col(text)).alias("bytes"),
                       common.crc32(F.col(text)).alias("crc"))
    position = F.pmod(F.xxhash64(F.lit(seed), F.col("key"), F.when(F.col("key").isNull(), F.col("crc"))), F.lit(RING))
    narrow = common.stored(narrow.withColumn("position", position))

    segments = ring_segments(n_shards, virtual_nodes, seed)
    ring = spark.createDataFrame([(i, *s) for i, s in enumerate(segments)],
                                 "segment int, cell int, start long, stop long, home_shard int")
    width = RING // CELLS
    on_ring = narrow.withColumn("cell", F.floor(F.col("position") / width).cast("int")).join(
        F.broadcast(ring), "cell").where("position >= start and position < stop")  # CELLS + n_shards * virtual_nodes rows
    counted = dict(on_ring.groupBy("segment").count().collect())
    counts = [counted.get(i, 0) for i in range(len(segments))]
    plan = overflow_plan(segments, counts, bounds(sum(counts), n_shards, load_factor))
    moves = spark.createDataFrame(plan, "segment int, first long, stop_rank long, shard int, first_slot long")

    rank = F.row_number().over(Window.partitionBy("segment").orderBy("position", "key", "crc", "bytes")) - 1
    placed = (on_ring.select("key", "bytes", "crc", "position", "segment", "home_shard").withColumn("rank", rank)
              .join(F.broadcast(moves), "segment").where("rank >= first and rank < stop_rank"))
    return placed.select(
        F.col("key").alias(key), (F.col("bytes") + 16).alias("size"), F.col("crc").alias("text_crc32"), "home_shard",
        "shard", (F.col("first_slot") + F.col("rank") - F.col("first")).cast("long").alias("slot"))
