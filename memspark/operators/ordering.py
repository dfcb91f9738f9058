"""Top-k, limits and row positions that hold up when one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.session import broadcast_if_small, durable

SMALL_IDS = 500_000  # ranked ids, about 20 MB


def importance() -> Column:
    return F.coalesce(F.col("importance_score"), F.lit(1.0))


def order_columns(mode: str = "importance") -> list[Column]:
    """Sort expressions for a result order; the id breaks every tie."""
    modes = {
        "date_asc": [F.col("created_at_epoch").asc(), F.col("id").asc()],
        "date_desc": [F.col("created_at_epoch").desc(), F.col("id").desc()],
        "importance": [importance().desc(), F.col("created_at_epoch").desc(), F.col("id").desc()],
    }
    if mode == "relevance":
        return [F.col("score").desc(), F.col("id").asc()]
    return modes.get(mode, modes["importance"])


def top_per_group(df: DataFrame, keys, order, n: int, rank: str = "_rank") -> DataFrame:
    """First n rows of every group. Spark cuts each partition to n rows per group before it shuffles."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def limit_offset(df: DataFrame, order, limit: int = 20, offset: int = 0) -> DataFrame:
    """Page of a sorted result; the limit is clamped to 1..100 and defaults to 20."""
    limit = 20 if limit <= 0 else min(limit, 100)
    return df.orderBy(*order).offset(offset).limit(limit)


def visible_top(obs: DataFrame, n: int, mode: str = "importance", projects: DataFrame | None = None,
                rank: str = "rank") -> DataFrame:
    """The n best rows visible to each project: its own project-scoped rows and all global ones.

    Only ids and sort keys are ranked. Global rows are first cut to the best n overall, so a project receives at most
    2n candidates whatever the sizes. The ranked ids are stored, and the wide rows are then fetched by id: without a
    shuffle of the wide side while the ids are few, by an ordinary join otherwise. ``viewer`` is the project that sees
    a row.
    """
    keys = obs.select("id", "project", F.coalesce("scope", F.lit("project")).alias("scope"), "importance_score",
                      "created_at_epoch")
    cand = visible_candidates(keys, n, mode, projects)
    ranked = durable(top_per_group(cand, "viewer", order_columns(mode), n, rank).select("viewer", "id", rank))
    return obs.join(broadcast_if_small(ranked, SMALL_IDS), "id")


def visible_candidates(rows: DataFrame, n: int, mode: str, projects: DataFrame | None = None) -> DataFrame:
    order = order_columns(mode)
    own = top_per_group(rows.filter(F.col("scope") == "project"), "project", order, n, "_r").drop("_r")
    if projects is None:
        projects = rows.select("project").distinct()
    else:
        own = own.join(projects, "project", "left_semi")
    shared = rows.filter(F.col("scope") == "global").orderBy(*order).limit(n)
    # at most n rows in one array, attached to every project as a scalar subquery
    best_global = shared.agg(F.collect_list(F.struct(*rows.columns)).alias("g")).scalar()
    fan_out = projects.select(F.col("project").alias("viewer"), F.explode(best_global).alias("g")).select("viewer", "g.*")
    return own.withColumn("viewer", F.col("project")).unionByName(fan_out)


def with_positions(df: DataFrame, *order) -> DataFrame:
    """Add ``_pos``, the row's 0-based place in a total order.

    The sort is range-partitioned, so even a single dominant key is spread over tasks. Partition sizes are summed into
    offsets (one row per shuffle partition, hence small enough to broadcast at any data size).
    """
    placed = durable(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (placed.join(F.broadcast(offsets), "_pid").withColumn("_pos", F.col("_off") + F.col("_idx"))
            .drop("_mid", "_pid", "_idx", "_off"))


def number_in_group(df: DataFrame, key: str, order: list[str], out: str = "row_no", start=None) -> DataFrame:
    """1-based number of each row within its key, without gathering a key in one task."""
    pos = with_positions(df, F.col(key), *[F.col(c) for c in order])
    first = pos.groupBy(key).agg(F.min("_pos").alias("_first"))
    base = F.coalesce(F.col(start), F.lit(0)) if start else F.lit(0)
    return pos.join(first, key).withColumn(out, F.col("_pos") - F.col("_first") + 1 + base).drop("_pos", "_first")


def around(df: DataFrame, anchors: DataFrame, before: int = 10, after: int = 10) -> DataFrame:
    """Rows around each anchor on its project's time line. ``anchors`` holds (anchor_id); works for many at once."""
    line = durable(with_positions(df.select("id", "project", "created_at_epoch"), F.col("project"),
                                  F.col("created_at_epoch"), F.col("id")))
    at = line.join(anchors, line["id"] == anchors["anchor_id"]).select(
        "anchor_id", F.col("project"), F.col("_pos").alias("_at"))
    wanted = at.select("anchor_id", "project", "_at",
                       F.explode(F.sequence(F.col("_at") - before, F.col("_at") + after)).alias("_pos"))
    hits = line.join(wanted, ["project", "_pos"]).select(
        "anchor_id", "id", (F.col("_pos") - F.col("_at")).alias("offset"))
    return hits.join(df, "id")


def keep_latest(df: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """Ids beyond the newest n, per key or overall.

    The n-th newest row is found by top-k and everything older is then a plain comparison, so a hot key is never sorted
    in one task.
    """
    newest = F.struct("created_at_epoch", "id")
    slim = df.select(*([key] if key else []), "id", "created_at_epoch")
    if key:
        edge = (top_per_group(slim, key, order_columns("date_desc"), n)
                .groupBy(key).agg(F.min(newest).alias("_edge"), F.count("*").alias("_n"))
                .filter(F.col("_n") == n).drop("_n"))
        return slim.join(edge, key).filter(newest < F.col("_edge")).select(key, "id")
    edge = (slim.orderBy(*order_columns("date_desc")).limit(n)
            .agg(F.when(F.count("*") == n, F.min(newest)).alias("_edge")).scalar())
    return slim.filter(newest < edge).select("id")
