"""Mix sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, pass after pass up to ``max_repeats``. An occurrence's virtual finish
time is the source's words up to its end divided by the source's weight. All occurrences are range-sorted by finish time
and taken from the front until the budget, the size of all documents, is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm import common

#: Sub-queues of a source; each holds the documents of one hash range, so that a dominant source is not one task.
BUCKETS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Per source its weight, size and target: weights in turn over the sources by code point (null last), all sizes
    shared by weight, no target above ``max_repeats`` sizes, the excess reshared until none is above.

    The sources' table is one row per source; it is ranked in one window, the documents are not.
    """
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    s = ranked.withColumn("weight", weight).withColumn("limit", F.lit(float(max_repeats)) * F.col("source_size"))
    s = s.withColumn("full_at", F.col("limit") / F.col("weight"))
    order = Window.orderBy("full_at", "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_sizes = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = (all_sizes - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("share", share).withColumn("level", F.min(F.when(F.col("share") <= F.col("full_at"), F.struct(
        F.row_number().over(order).alias("k"), F.col("share").alias("v")))).over(
            Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["v"])
    return s.select("source", "source_size", "weight", F.least(
        F.col("limit"), F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def mix(df: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3,
        seed: int = 0) -> DataFrame:
    """Per row: ``key``, size (words; null text: 0), source (as ``mix_source``), source_size, target, copies, taken.

    ``copies`` is how often the mix takes the row, 0 to ``max_repeats``; taken = copies * size. Documents are taken whole,
    so a source is off its target by less than one document. The shuffled order comes from a digest of seed and key (of
    the text's checksum, if the key is null), so reruns agree; repeated rows are documents of their own. A null source is a source. Without
    any words all targets and copies are 0. Other columns are not read.
    """
    docs = common.stored(df.select(
        F.col(key).alias("key"), F.col(source).alias("source"), common.n_words(F.col(text)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), common.crc32(F.col(text)).cast("string")))
              .cast("binary")).alias("h")))
    # sub-queues follow one another in the order of their hash ranges, so the whole order is that of the digest
    bucket = F.floor(F.conv(F.substring("h", 1, 6), 16, 10).cast("int") / ((1 << 24) // BUCKETS)).cast("int")
    docs = docs.withColumn("bucket", bucket)

    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = common.stored(sums)
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    queue = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(queue), F.lit(0))).join(
        targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "bucket_size")

    within = Window.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    d, s = docs.withColumn("run", F.sum("size").over(within)).alias("d"), heads.alias("s")
    queued = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    queued = common.stored(queued.select(
        "d.key", "d.source", "size", "h", "source_size", "target", "weight", (F.col("start") + F.col("run")).alias("end")))
    budget = sums.agg(F.sum("bucket_size")).first()[0] or 0
    last = _cut(queued.where("size > 0"), budget, max_repeats)
    copies = F.lit(0)
    for n in range(max_repeats if last else 0):
        at = (_finish(F.lit(n)), F.col("source"), F.col("h"), F.col("key"))
        copies = copies + F.when((F.col("size") > 0) & _not_after(at, last), 1).otherwise(0)
    out = queued.withColumn("copies", copies.cast("int"))
    return out.select(F.col("key").alias(key), F.col("size"), F.col("source").alias("mix_source"), "source_size", "target",
                      "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _finish(n: Column) -> Column:
    return (n * F.col("source_size") + F.col("end")) / F.col("weight")


def _cut(queued: DataFrame, budget: int, max_repeats: int) -> tuple | None:
    """The last occurrence that fits the budget, in the order (finish, source, digest, key)."""
    spark = queued.sparkSession
    turns = queued.select("key", "source", "size", "h", "weight", "end", "source_size", F.explode(
        F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("n"))
    order = ["finish", "source", "h", "key"]
    ranged = common.stored(
        turns.select(_finish(F.col("n")).alias("finish"), "source", "h", "key", "size")
        .repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()))
    before = 0
    for row in ranged.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect():  # a row per partition
        if before + row["n"] >= budget:
            break
        before += row["n"]
    else:
        row = None
    if row is None:
        ends = ranged.agg(F.max(F.struct("finish", "source", "h", "key")).alias("m")).first()["m"]
        return tuple(ends) if ends else None
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    hit = (ranged.where(F.col("part") == row["part"]).withColumn("run", running + before).where(F.col("run") <= budget)
           .orderBy(F.col("run").desc(), *[F.col(c).desc() for c in order]).select(*order).first())
    if hit is not None:
        return tuple(hit)
    earlier = ranged.where(F.col("part") < row["part"]).orderBy(*[F.col(c).desc() for c in order]).select(*order).first()
    return tuple(earlier) if earlier else None


def _not_after(at: tuple[Column, ...], last: tuple) -> Column:
    """Lexicographic comparison with nulls first, as in Spark's ascending order."""
    out = F.lit(True)
    for column, value in reversed(list(zip(at, last, strict=True))):
        v = F.lit(value)
        less = F.lit(False) if value is None else column.isNull() | (column < v)
        out = less | (column.eqNullSafe(v) & out)
    return out
