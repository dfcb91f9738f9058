"""Breadth-first neighbourhoods in the relation graph, for many centres at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.session import durable

MAX_DEPTH = 5


def relation_graph(relations: DataFrame, centers: DataFrame, depth: int = 2) -> DataFrame:
    """(center_id, edge_id, source_id, target_id, hop): edges within ``depth`` hops of each centre, both directions.

    Each hop joins the frontier with edge ends by equality. The visited set is kept out by an anti-join, and each
    frontier is written out so that the plan of later hops stays short.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    ends = relations.select(F.col("id").alias("edge_id"), "source_id", "target_id", F.explode(F.array_distinct(
        F.array("source_id", "target_id"))).alias("node"))
    frontier = centers.select(F.col(centers.columns[0]).alias("center_id"), F.col(centers.columns[0]).alias("node")).distinct()
    visited, found = frontier, None
    for hop in range(1, depth + 1):
        touched = frontier.join(ends, "node").select("center_id", "edge_id", "source_id", "target_id").distinct()
        touched = durable(touched.withColumn("hop", F.lit(hop)))
        found = touched if found is None else found.unionByName(touched)
        if hop == depth:
            break
        nodes = touched.select("center_id", F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
        frontier = durable(nodes.join(visited, ["center_id", "node"], "left_anti"))
        visited = visited.unionByName(frontier)
    return found.groupBy("center_id", "edge_id", "source_id", "target_id").agg(F.min("hop").alias("hop"))


def graph_nodes(edges: DataFrame, obs: DataFrame, label_len: int = 30) -> DataFrame:
    """(center_id, node_id, label, type) of the observations in each graph; the centre's type is 'center'."""
    nodes = edges.select("center_id", F.explode(F.array("source_id", "target_id")).alias("node_id"))
    centers = edges.select("center_id", F.col("center_id").alias("node_id"))
    every = nodes.unionByName(centers).distinct()
    t = F.coalesce("title", F.lit(""))
    label = F.when(F.length(t) <= label_len, t).otherwise(F.concat(F.substring(t, 1, label_len - 3), F.lit("...")))
    side = obs.select(F.col("id").alias("node_id"), label.alias("label"), F.col("type").alias("_type"))
    return every.join(side, "node_id").select(
        "center_id", "node_id", "label", F.when(F.col("node_id") == F.col("center_id"), "center").otherwise(F.col("_type")).alias("type"))
