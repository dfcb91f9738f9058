"""Importance scores: type weight with time decay, plus feedback, concept and retrieval parts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab
from memspark.operators.filters import obs_needs_rescore

DAY_MS = 24 * 3600 * 1000


@dataclass(frozen=True)
class ScoringConfig:
    half_life_days: float = 7.0
    feedback_weight: float = 0.30
    concept_weight: float = 0.20
    retrieval_weight: float = 0.15
    min_score: float = 0.01
    concept_weights: dict = field(default_factory=lambda: dict(vocab.DEFAULT_CONCEPT_WEIGHTS))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def score_parts(now_ms: int, cfg: ScoringConfig = ScoringConfig()) -> dict[str, Column]:
    """The parts of the score as expressions over observation columns."""
    type_weight = F.coalesce(F.try_element_at(literal_map(vocab.TYPE_WEIGHTS), F.col("type")), F.lit(1.0))
    age_days = F.greatest((F.lit(now_ms) - F.col("created_at_epoch")) / F.lit(float(DAY_MS)), F.lit(0.0))
    decay = F.pow(F.lit(0.5), age_days / cfg.half_life_days)
    weights = literal_map(cfg.concept_weights or {"": 0.0})
    boost = F.aggregate(F.coalesce("concepts", F.array().cast("array<string>")), F.lit(0.0),
                        lambda acc, c: acc + F.coalesce(F.try_element_at(weights, c), F.lit(0.0)))
    n = F.coalesce("retrieval_count", F.lit(0))
    retrieval = F.when(n > 0, F.log2(n + F.lit(1.0)) * 0.1 * cfg.retrieval_weight).otherwise(F.lit(0.0))
    core = type_weight * decay
    feedback = F.coalesce("user_feedback", F.lit(0)) * F.lit(cfg.feedback_weight)
    concept = boost * cfg.concept_weight
    return {
        "type_weight": type_weight, "age_days": age_days, "recency_decay": decay, "core_score": core,
        "feedback_part": feedback, "concept_part": concept, "retrieval_part": retrieval,
        "final_score": F.greatest(core + feedback + concept + retrieval, F.lit(cfg.min_score)),
    }


def importance_score(obs: DataFrame, now_ms: int, cfg: ScoringConfig = ScoringConfig(), out="score") -> DataFrame:
    return obs.withColumn(out, score_parts(now_ms, cfg)["final_score"])


def score_components(obs: DataFrame, now_ms: int, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    return obs.withColumns(score_parts(now_ms, cfg))


def concept_weights(table: DataFrame) -> DataFrame:
    """The stored weights, or the built-in ones when the table has no rows."""
    spark = table.sparkSession
    has_rows = table.select(F.lit(1).alias("x")).limit(1).agg(F.count("*").alias("n")).scalar() > 0
    defaults = spark.createDataFrame(list(vocab.DEFAULT_CONCEPT_WEIGHTS.items()), "concept string, weight double")
    return table.select("concept", "weight").unionByName(defaults.filter(~has_rows))


def importance_score_with_table(obs: DataFrame, weights: DataFrame, now_ms: int,
                                cfg: ScoringConfig = ScoringConfig(), out="score") -> DataFrame:
    """Score with concept weights from a table: the concepts of each row are joined and summed per row."""
    parts = score_parts(now_ms, cfg)
    boosts = (obs.select("id", F.explode("concepts").alias("concept")).join(weights, "concept")
              .groupBy("id").agg(F.sum("weight").alias("_boost")))
    total = (parts["core_score"] + parts["feedback_part"] + parts["retrieval_part"]
             + F.coalesce("_boost", F.lit(0.0)) * cfg.concept_weight)
    return obs.join(boosts, "id", "left").withColumn(out, F.greatest(total, F.lit(cfg.min_score))).drop("_boost")


def rescore_batch(obs: DataFrame, now_ms: int, cfg: ScoringConfig = ScoringConfig(),
                  threshold_ms: int = vocab.RESCORE_AFTER_MS, limit: int | None = None) -> DataFrame:
    """New (id, score, time) for rows that need it; one pass over all of them unless a batch size is given."""
    due = obs_needs_rescore(obs, now_ms, threshold_ms, limit)
    return importance_score(due, now_ms, cfg, "importance_score").select(
        "id", "importance_score", F.lit(now_ms).cast("long").alias("score_updated_at_epoch"))


def rescored(obs: DataFrame, now_ms: int, cfg: ScoringConfig = ScoringConfig(),
             threshold_ms: int = vocab.RESCORE_AFTER_MS) -> DataFrame:
    """The whole table after one pass over all rows that are due: ``apply_scores`` of ``rescore_batch``, row by row without a join."""
    at = F.col("score_updated_at_epoch")
    due = at.isNull() | (at < now_ms - threshold_ms)
    return obs.withColumns({
        "importance_score": F.coalesce(F.when(due, score_parts(now_ms, cfg)["final_score"]), "importance_score"),
        "score_updated_at_epoch": F.when(due, F.lit(now_ms).cast("long")).otherwise(at)})


def apply_scores(obs: DataFrame, scores: DataFrame) -> DataFrame:
    new = scores.select("id", F.col("importance_score").alias("_s"), F.col("score_updated_at_epoch").alias("_t"))
    return obs.join(new, "id", "left").withColumns({
        "importance_score": F.coalesce("_s", "importance_score"),
        "score_updated_at_epoch": F.coalesce("_t", "score_updated_at_epoch")}).drop("_s", "_t")


def reset_scores(obs: DataFrame) -> DataFrame:
    return obs.withColumns({"importance_score": F.lit(1.0), "score_updated_at_epoch": F.lit(None).cast("long")})


def apply_feedback(obs: DataFrame, feedback: DataFrame, now_ms: int, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Set the latest valid feedback (id, feedback, at) of each row and rescore the rows it touches."""
    latest = (feedback.filter(F.col("feedback").isin(-1, 0, 1)).groupBy("id")
              .agg(F.max_by("feedback", "at").cast("int").alias("_f")))
    j = obs.join(latest, "id", "left").withColumn("user_feedback", F.coalesce("_f", "user_feedback"))
    hit = F.col("_f").isNotNull()
    return j.withColumns({
        "importance_score": F.when(hit, score_parts(now_ms, cfg)["final_score"]).otherwise(F.col("importance_score")),
        "score_updated_at_epoch": F.when(hit, F.lit(now_ms)).otherwise(F.col("score_updated_at_epoch")),
    }).drop("_f")
