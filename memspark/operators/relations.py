"""Relation detectors over (newer, older) pairs, as columns, and the edge tables they feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab
from memspark.functions.text import let, str_array
from memspark.operators.ordering import order_columns, top_per_group
from memspark.operators.pairs import candidate_pairs

FIVE_MINUTES_MS = 300_000


def n(c: str) -> Column:
    return F.col(f"n_{c}")


def o(c: str) -> Column:
    return F.col(f"o_{c}")


def _result(rtype: Column, confidence: Column, source: str, reason: Column) -> Column:
    return F.struct(rtype.alias("relation_type"), confidence.alias("confidence"),
                    F.lit(source).alias("detection_source"), reason.alias("reason"))


def _first_names(items: Column, k: int) -> Column:
    shown = F.array_join(F.slice(items, 1, k), ", ")
    return F.when(F.size(items) > k, F.concat(shown, F.lit(", ..."))).otherwise(shown)


def rel_file_overlap() -> Column:
    shared = F.array_sort(F.array_intersect(n("files_modified"), o("files_modified")))
    reads = F.filter(n("files_read"), lambda f: F.array_contains(o("files_modified"), f))
    overlap = F.size(shared) + F.size(reads)
    fixes = (n("type") == "bugfix") & o("type").isin("decision", "feature")
    evolves = (n("type") == "refactor") & (o("type") == "discovery")
    supersedes = (n("type") == o("type")) & (F.size(shared) > 0)
    depends = (n("type") == "feature") & (o("type") == "decision")
    rtype = (F.when(fixes, "fixes").when(evolves, "evolves_from").when(supersedes, "supersedes")
             .when(depends, "depends_on").otherwise("relates_to"))
    bonus = F.when(fixes, 0.2).when(evolves, 0.15).when(supersedes, 0.1).when(depends, 0.15).otherwise(0.0)
    confidence = F.least(F.lit(0.5) + overlap * F.lit(0.1) + bonus, F.lit(1.0))
    reason = F.concat_ws(
        "; ",
        F.when(F.size(shared) > 0, F.concat(F.lit("both modified: "), _first_names(shared, 3))),
        F.when(F.size(reads) > 0, F.concat(F.lit("reads files modified by older: "), _first_names(reads, 3))))
    return F.when(overlap > 0, _result(rtype, confidence, "file_overlap", reason))


def rel_concept_overlap() -> Column:
    shared = F.filter(o("concepts"), lambda c: F.array_contains(n("concepts"), c))
    fresh = F.filter(o("concepts"), lambda c: ~F.array_contains(n("concepts"), c))
    total = F.size(F.array_distinct(n("concepts"))) + F.size(fresh)
    high = F.filter(shared, lambda c: F.array_contains(str_array(vocab.HIGH_VALUE_CONCEPTS), c))
    base = F.lit(0.3) + F.try_divide(F.size(shared).cast("double"), total) * 0.5
    confidence = F.least(F.aggregate(high, base, lambda acc, c: acc + F.lit(0.1)), F.lit(1.0))
    reason = F.concat(F.lit("shared concepts: "), _first_names(shared, 5))
    return F.when(F.size(shared) > 0, _result(F.lit("relates_to"), confidence, "concept_overlap", reason))


def rel_type_progression() -> Column:
    steps = F.create_map(*[x for new, old, rel, conf in vocab.TYPE_PROGRESSIONS for x in (
        F.lit(f"{new}<{old}"), F.struct(F.lit(rel).alias("relation_type"), F.lit(conf).alias("confidence")))])
    step = F.try_element_at(steps, F.concat(n("type"), F.lit("<"), o("type")))
    reason = F.concat(o("type"), F.lit(" -> "), n("type"), F.lit(" progression"))
    return F.when(step.isNotNull(), _result(step["relation_type"], step["confidence"], "type_progression", reason))


def rel_temporal() -> Column:
    gap = F.abs(n("created_at_epoch") - o("created_at_epoch"))
    near = (n("sdk_session_id") == o("sdk_session_id")) & (gap <= FIVE_MINUTES_MS)
    confidence = F.lit(0.3) + (F.lit(1.0) - gap / F.lit(float(FIVE_MINUTES_MS))) * 0.4
    return F.when(near, _result(F.lit("relates_to"), confidence, "temporal_proximity",
                                F.lit("same session, close timestamps")))


def narrative_relation(narrative: Column) -> Column:
    """The first phrase of the list found in the narrative; depends on the newer row only."""
    def first_phrase(text: Column) -> Column:
        out = F.lit(None)
        for phrase, rtype, boost in reversed(vocab.NARRATIVE_PHRASES):
            reason = f"narrative contains '{phrase.strip()}' language"
            out = F.when(F.contains(text, F.lit(phrase)),
                         _result(F.lit(rtype), F.lit(min(1.0, 0.4 + boost)), "narrative_mention", F.lit(reason))
                         ).otherwise(out)
        return out

    return let(F.lower(narrative), first_phrase)


def rel_narrative() -> Column:
    return F.col("n_mention")


DETECTORS = {
    "rel_file_overlap": rel_file_overlap, "rel_concept_overlap": rel_concept_overlap,
    "rel_type_progression": rel_type_progression, "rel_temporal": rel_temporal, "rel_narrative": rel_narrative,
}


def run_detector(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(n("id").alias("source_id"), o("id").alias("target_id"), DETECTORS[name]().alias("r")).filter(
        F.col("r").isNotNull()).select("source_id", "target_id", "r.*")


def same_scope() -> Column:
    return (n("project") == o("project")) | (n("scope") == "global") | (o("scope") == "global")


def with_narrative_mention(new: DataFrame) -> DataFrame:
    """Evaluate the narrative detector once per new row, before rows fan out into pairs."""
    return new.withColumn("mention", narrative_relation(F.col("narrative")))


NEWER_FIELDS = ["id", "sdk_session_id", "project", "scope", "type", "concepts", "files_read", "files_modified",
                "created_at_epoch", "mention"]
OLDER_FIELDS = ["id", "sdk_session_id", "project", "scope", "type", "concepts", "files_modified",
                "created_at_epoch", "is_superseded", "importance_score"]


def relation_pairs(new: DataFrame, existing: DataFrame, max_candidates: int = vocab.MAX_CANDIDATES) -> DataFrame:
    return candidate_pairs(with_narrative_mention(new), existing, NEWER_FIELDS, OLDER_FIELDS, max_candidates)


def detect_relations(pairs: DataFrame, min_confidence: float = vocab.MIN_RELATION_CONFIDENCE) -> DataFrame:
    """One edge per pair: the most confident detector, earlier ones winning ties.

    Temporal proximity counts only when the three before it found nothing; a narrative mention may still beat it.
    Pairs carry ``n_mention`` from ``with_narrative_mention``.
    """
    def enough(result):
        return F.when(result["confidence"] >= min_confidence, result)

    names = {"_file": rel_file_overlap(), "_concept": rel_concept_overlap(), "_type": rel_type_progression(),
             "_time": rel_temporal(), "_text": F.col("n_mention")}
    d = pairs.filter(~F.coalesce(o("is_superseded"), F.lit(False)) & same_scope()).withColumns(
        {k: enough(v) for k, v in names.items()})

    def better(a, b):
        return F.when(F.coalesce(b["confidence"] > a["confidence"], b.isNotNull()), b).otherwise(a)

    d = d.withColumn("_best", better(F.col("_file"), F.col("_concept")))
    d = d.withColumn("_best", better(F.col("_best"), F.col("_type")))
    d = d.withColumn("_best", F.coalesce("_best", "_time"))
    d = d.withColumn("_best", better(F.col("_best"), F.col("_text")))
    return d.filter(F.col("_best").isNotNull()).select(
        n("id").alias("source_id"), o("id").alias("target_id"), "_best.*")


def temporal_pairs(obs: DataFrame, window_ms: int = FIVE_MINUTES_MS) -> DataFrame:
    """All pairs of one session at most ``window_ms`` apart, as an equality join on time buckets.

    A row meets only its own bucket and the next, so the work follows the true number of close pairs, whatever the
    size of a session.
    """
    cols = ["id", "sdk_session_id", "created_at_epoch"]
    bucket = F.floor(F.col("created_at_epoch") / window_ms)
    older = obs.select(*[F.col(c).alias(f"o_{c}") for c in cols], F.explode(F.array(bucket, bucket + 1)).alias("b"))
    newer = obs.select(*[F.col(c).alias(f"n_{c}") for c in cols], bucket.alias("b"))
    j = newer.join(older, (newer["n_sdk_session_id"] == older["o_sdk_session_id"]) & (newer["b"] == older["b"]))
    later = F.struct("o_created_at_epoch", "o_id") < F.struct("n_created_at_epoch", "n_id")
    return j.filter(later & (n("created_at_epoch") - o("created_at_epoch") <= window_ms)).drop("b")


def relations_detailed(relations: DataFrame, obs: DataFrame) -> DataFrame:
    side = obs.select("id", F.coalesce("title", F.lit("")).alias("title"), "type")
    src = side.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"),
                      F.col("type").alias("source_type"))
    tgt = side.select(F.col("id").alias("target_id"), F.col("title").alias("target_title"),
                      F.col("type").alias("target_type"))
    return relations.join(src, "source_id").join(tgt, "target_id")


def related_ids(relations: DataFrame, nodes: DataFrame, min_confidence: float = 0.4) -> DataFrame:
    """Distinct neighbours (node_id, related_id) over edges of enough confidence, both directions."""
    strong = relations.filter(F.col("confidence") >= min_confidence)
    ends = strong.select(F.explode(F.array(
        F.struct(F.col("source_id").alias("node_id"), F.col("target_id").alias("related_id")),
        F.struct(F.col("target_id").alias("node_id"), F.col("source_id").alias("related_id")))).alias("e")).select("e.*")
    keys = nodes.select(F.col(nodes.columns[0]).alias("node_id"))
    return ends.join(keys, "node_id", "left_semi").distinct()


def related_observations(obs: DataFrame, relations: DataFrame, nodes: DataFrame, min_confidence: float = 0.4,
                         limit: int = 50) -> DataFrame:
    """The most important neighbours of each node."""
    near = related_ids(relations, nodes, min_confidence)
    keyed = near.join(obs.select(F.col("id").alias("related_id"), "id", "importance_score", "created_at_epoch"), "related_id")
    return top_per_group(keyed, "node_id", order_columns(), limit, "rank").select("node_id", "id", "rank")


def edge_update(relations: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply new confidences (id, confidence)."""
    c = changes.select("id", F.col("confidence").alias("_c"))
    return relations.join(c, "id", "left").withColumn("confidence", F.coalesce("_c", "confidence")).drop("_c")


def edges_without(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations that touch none of the nodes."""
    k = nodes.select(F.col(nodes.columns[0]).alias("k"))
    return relations.join(k, relations["source_id"] == k["k"], "left_anti").join(
        k, F.col("target_id") == k["k"], "left_anti")
