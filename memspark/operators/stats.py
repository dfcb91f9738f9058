"""Aggregates over the memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark import vocab
from memspark.operators.filters import project_or_global
from memspark.operators.ordering import importance


def _feedback_sums():
    fb = F.coalesce("user_feedback", F.lit(0))
    return [
        F.count("*").alias("total"), F.count_if(fb == 1).alias("positive"), F.count_if(fb == -1).alias("negative"),
        F.count_if(fb == 0).alias("neutral"), F.sum(importance().cast("decimal(18,6)")).alias("_score"),
        F.sum(F.coalesce("retrieval_count", F.lit(0))).alias("_retrieved"),
    ]


def _feedback_averages(df: DataFrame) -> DataFrame:
    def mean(c):
        return F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("total")), F.lit(0.0))
    return df.withColumns({"avg_score": mean("_score"), "avg_retrieval": mean("_retrieved")}).drop("_score", "_retrieved")


def feedback_stats(obs: DataFrame, project: str | None = None) -> DataFrame:
    return _feedback_averages(obs.filter(project_or_global(project)).agg(*_feedback_sums()))


def feedback_stats_by_project(obs: DataFrame) -> DataFrame:
    """The same figures for every project; global rows of other projects count for each."""
    cols = ["total", "positive", "negative", "neutral", "_score", "_retrieved"]
    parts = obs.groupBy("project", F.coalesce(F.col("scope") == "global", F.lit(False)).alias("g")).agg(*_feedback_sums())
    shared = parts.filter("g").agg(F.struct(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols]).alias("s")).scalar()
    own = parts.groupBy("project").agg(*[F.coalesce(F.sum(F.when(~F.col("g"), F.col(c))), F.lit(0)).alias(c) for c in cols])
    both = own.withColumn("_shared", shared)
    return _feedback_averages(both.select("project", *[(F.col(c) + F.col("_shared")[c]).alias(c) for c in cols]))


def pattern_stats(patterns: DataFrame) -> DataFrame:
    return patterns.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in vocab.PATTERN_STATUSES],
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_occurrences"),
        F.coalesce(F.try_divide(F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double"), F.count("confidence")),
                   F.lit(0.0)).alias("avg_confidence"),
        *[F.count_if(F.col("type") == t).alias(t.replace("-", "_") + "s") for t in vocab.PATTERN_TYPES],
    )


def relation_stats(relations: DataFrame, high: float = 0.7) -> DataFrame:
    """Counts per relation type and, with relation_type = 'all', overall."""
    return relations.rollup("relation_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("confidence") >= high).alias("high_confidence"),
    ).withColumn("relation_type", F.coalesce("relation_type", F.lit("all")))


def relation_degree(relations: DataFrame) -> DataFrame:
    """Number of edges per node; a self-loop counts once."""
    ends = F.when(F.col("source_id") == F.col("target_id"), F.array("source_id")).otherwise(
        F.array("source_id", "target_id"))
    return relations.select(F.explode(ends).alias("obs_id")).groupBy("obs_id").agg(F.count("*").alias("relations"))


def obs_count(obs: DataFrame) -> DataFrame:
    """Observations each project can see: its own rows plus global rows of the others."""
    parts = obs.groupBy("project").agg(F.count("*").alias("own"), F.count_if(F.col("scope") == "global").alias("g"))
    shared = parts.agg(F.sum("g").alias("g")).scalar()
    return parts.select("project", (F.col("own") - F.col("g") + shared).alias("observations"))


def projects_distinct(sessions: DataFrame, contains: str | None = None) -> DataFrame:
    rows = sessions.filter(F.col("project").isNotNull() & (F.col("project") != ""))
    if contains:
        rows = rows.filter(F.contains(F.lower("project"), F.lit(contains.lower())))
    return rows.select("project").distinct().orderBy("project")


def sessions_today(sessions: DataFrame, now_ms: int) -> DataFrame:
    midnight = F.unix_millis(F.date_trunc("day", F.timestamp_millis(F.lit(now_ms))))
    return sessions.filter(F.col("started_at_epoch") >= midnight).agg(F.count("*").alias("sessions_today"))


RETRIEVAL_COUNTERS = ["requests", "served", "verified", "deleted", "searches", "injections"]


def retrieval_counters():
    return [
        F.count("*").alias("requests"), F.sum("served").alias("served"), F.sum("verified").alias("verified"),
        F.sum("deleted").alias("deleted"), F.count_if(F.col("kind") == "search").alias("searches"),
        F.count_if(F.col("kind") == "inject").alias("injections"),
    ]


def retrieval_stats(log: DataFrame) -> DataFrame:
    """Counters per project and, with project = 'all', overall."""
    return log.rollup("project").agg(*retrieval_counters()).withColumn("project", F.coalesce("project", F.lit("all")))


def retrieval_increment(obs: DataFrame, log: DataFrame) -> DataFrame:
    """Observations with counters advanced by a log of (obs_id, ts)."""
    hits = log.groupBy(F.col("obs_id").alias("id")).agg(
        F.count("*").alias("_n"), F.unix_millis(F.max("ts")).alias("_last"))
    return obs.join(hits, "id", "left").withColumns({
        "retrieval_count": F.coalesce("retrieval_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
        "last_retrieved_at_epoch": F.coalesce("_last", "last_retrieved_at_epoch"),
    }).drop("_n", "_last")


def vector_counts(vectors: DataFrame, current_model: str) -> DataFrame:
    """Vector count, stale count and the rebuild verdict."""
    stale = ~F.col("model_version").eqNullSafe(F.lit(current_model))
    return vectors.agg(F.count("*").alias("vectors"), F.count_if(stale).alias("stale")).withColumn(
        "verdict", F.when(F.col("vectors") == 0, "empty")
        .when(F.col("stale") > 0, F.concat(F.lit("model_mismatch:"), F.col("stale"))))


def max_similarity(hits: DataFrame) -> DataFrame:
    """Best weighted similarity of each row over all variants of a query."""
    return hits.groupBy("query_id", "row_id").agg(F.max("similarity").alias("similarity"))


def project_overview(obs: DataFrame, sessions: DataFrame, vectors: DataFrame, log: DataFrame, now_ms: int) -> DataFrame:
    """One row per project with its visible observations, sessions today, vectors and retrieval counters."""
    midnight = F.unix_millis(F.date_trunc("day", F.timestamp_millis(F.lit(now_ms))))
    s = sessions.groupBy("project").agg(F.count_if(F.col("started_at_epoch") >= midnight).alias("sessions_today"))
    v = vectors.groupBy("project").agg(F.count("*").alias("vectors"))
    r = log.groupBy("project").agg(*retrieval_counters())
    out = obs_count(obs).join(s, "project", "full").join(v, "project", "full").join(r, "project", "full")
    counts = ["observations", "sessions_today", "vectors", *RETRIEVAL_COUNTERS]
    return out.select("project", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
