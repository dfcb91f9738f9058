"""Duplicate prompts: the same text in the same session shortly after a prompt that was saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark import vocab
from memspark.operators.ordering import with_positions
from memspark.session import durable

SPAN = 100_000  # positions per window task


def _keyed(prompts: DataFrame) -> DataFrame:
    return prompts.select("session_id", F.sha2("prompt_text", 256).alias("text_key"), "created_at_epoch", "id")


def prompt_dedup(prompts: DataFrame, window_ms: int = vocab.DUPLICATE_PROMPT_WINDOW_MS,
                 saved: DataFrame | None = None) -> DataFrame:
    """(id, session_id, text_key, created_at_epoch) of the prompts that are saved.

    A prompt is dropped when the last saved prompt of the same session and text is less than ``window_ms`` before it, so
    the decision runs in time order. Copies of one instant collapse first. A gap of the window or more starts a new
    run, and runs are independent; they are found over row positions, so a hot session or text is not gathered, and
    each run is folded on its own. ``saved`` holds (session_id, text_key, created_at_epoch) of earlier saved prompts.
    """
    rows = _keyed(prompts)
    if saved is not None:
        rows = rows.unionByName(saved.select("session_id", "text_key", "created_at_epoch", F.lit(None).cast("long").alias("id")))
    once = rows.groupBy("session_id", "text_key", "created_at_epoch").agg(
        F.min("id").alias("id"), F.bool_or(F.col("id").isNull()).alias("earlier"))
    line = durable(with_positions(once, F.col("session_id"), F.col("text_key"), F.col("created_at_epoch")))
    prev = line.select((F.col("_pos") + 1).alias("_pos"), F.col("session_id").alias("s0"), F.col("text_key").alias("k0"),
                       F.col("created_at_epoch").alias("t0"))
    same = (F.col("session_id") == F.col("s0")) & (F.col("text_key") == F.col("k0"))
    close = same & (F.col("created_at_epoch") - F.col("t0") < window_ms)
    marked = durable(line.join(prev, "_pos", "left").withColumn(
        "start", F.when(~F.coalesce(close, F.lit(False)), F.col("_pos"))).withColumn("span", F.floor(F.col("_pos") / SPAN)))
    # last run start at or before each row: within spans of equal size, plus a carry from the spans before
    carry = marked.groupBy("span").agg(F.max("start").alias("m")).select(
        "span", F.max("m").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    within = F.max("start").over(W.partitionBy("span").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0))
    runs = marked.withColumn("within", within).join(carry, "span").withColumn("run", F.coalesce("within", "carry"))
    entry = F.struct("created_at_epoch", "id", "earlier")
    lists = runs.groupBy("session_id", "text_key", "run").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    none = F.slice("items", F.lit(1), F.lit(0))
    kept = F.aggregate(
        "items", F.struct(F.lit(None).cast("long").alias("last"), none.alias("kept")),
        lambda acc, x: F.when(
            acc["last"].isNotNull() & (x["created_at_epoch"] - acc["last"] < window_ms), acc
        ).otherwise(F.struct(x["created_at_epoch"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))),
        lambda acc: acc["kept"])
    out = lists.select("session_id", "text_key", F.explode(kept).alias("k"))
    return out.filter(~F.col("k.earlier")).select("k.id", "session_id", "text_key", "k.created_at_epoch")
