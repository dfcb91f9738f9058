"""Conflict detection and what follows from it: supersession, resolution, retention and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab
from memspark.functions.text import let
from memspark.operators.pairs import candidate_pairs
from memspark.operators.relations import n, o, same_scope


def correction_text(text: Column) -> Column:
    """The first correction phrase found, in pattern order; NULL when there is none."""
    def search(low: Column) -> Column:
        # a plain substring test spares most texts the pattern search
        found = []
        for pattern, words in zip(vocab.CORRECTION_PATTERNS, vocab.CORRECTION_WORDS):
            possible = F.lit(False)
            for w in words:
                possible = possible | F.contains(low, F.lit(w))
            found.append(F.when(possible, F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))))
        return F.coalesce(*found)

    return let(F.lower(text), search)


def _verbs(which: int) -> Column:
    """Numbers of the verb pairs whose first (or second) word occurs in title or narrative."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("narrative", F.lit(""))))
    return let(text, lambda t: F.array_compact(F.array(*[
        F.when(F.contains(t, F.lit(pair[which])), F.lit(i)) for i, pair in enumerate(vocab.OPPOSING_VERBS)])))


def with_text_facts(obs: DataFrame) -> DataFrame:
    """What the detectors need from the texts, found once per row before rows fan out into pairs."""
    return obs.withColumns({
        "correction": F.coalesce(correction_text(F.col("narrative")), correction_text(F.col("title"))),
        "acts": _verbs(0), "undoes": _verbs(1),
    })


NEWER_FIELDS = ["id", "project", "scope", "concepts", "files_modified", "created_at_epoch", "correction", "acts", "undoes"]
OLDER_FIELDS = ["id", "project", "scope", "concepts", "files_modified", "created_at_epoch", "acts", "undoes",
                "importance_score"]


def conflict_pairs(new: DataFrame, existing: DataFrame, max_candidates: int = vocab.MAX_CANDIDATES) -> DataFrame:
    return candidate_pairs(with_text_facts(new), existing, NEWER_FIELDS, OLDER_FIELDS, max_candidates, derive=with_text_facts)


def _result(ctype: str, reason: Column) -> Column:
    return F.struct(F.lit(ctype).alias("conflict_type"), F.lit("prefer_newer").alias("resolution"), reason.alias("reason"))


def _shared(field: str) -> Column:
    return F.filter(o(field), lambda x: F.array_contains(n(field), x))


def conf_correction(require_overlap: bool = False) -> Column:
    hit = n("correction").isNotNull()
    if require_overlap:
        hit = hit & (F.arrays_overlap(n("files_modified"), o("files_modified"))
                     | F.arrays_overlap(n("concepts"), o("concepts")))
    return F.when(hit, _result("contradicts", F.concat(F.lit("Explicit correction detected: "), n("correction"))))


def conf_opposing() -> Column:
    files = _shared("files_modified")
    opposed = F.arrays_overlap(n("acts"), o("undoes")) | F.arrays_overlap(n("undoes"), o("acts"))
    return F.when((F.size(files) > 0) & opposed, _result(
        "superseded", F.concat(F.lit("Opposing changes on files: "), F.array_join(files, ", "))))


def conf_concept_file() -> Column:
    concepts = _shared("concepts")
    hit = (F.size(concepts) > 0) & F.arrays_overlap(n("files_modified"), o("files_modified"))
    return F.when(hit, _result("superseded", F.concat(
        F.lit("Same concepts ("), F.array_join(concepts, ", "), F.lit(") with overlapping file changes"))))


def _rows(pairs: DataFrame, result: Column) -> DataFrame:
    return pairs.filter(same_scope()).select(
        n("id").alias("newer_obs_id"), o("id").alias("older_obs_id"), result.alias("r")
    ).filter(F.col("r").isNotNull()).select("newer_obs_id", "older_obs_id", "r.*")


def detect(pairs: DataFrame, which: str) -> DataFrame:
    one = {"conf_correction": conf_correction, "conf_opposing": conf_opposing, "conf_concept_file": conf_concept_file}
    return _rows(pairs, one[which]())


def detect_conflicts(pairs: DataFrame, require_overlap: bool = False) -> DataFrame:
    """The first of the three detectors that fires, per pair."""
    return _rows(pairs, F.coalesce(conf_correction(require_overlap), conf_opposing(), conf_concept_file()))


def new_conflicts(detected: DataFrame, now_ms: int) -> DataFrame:
    return detected.withColumns({"detected_at_epoch": F.lit(now_ms).cast("long"), "resolved": F.lit(False),
                                 "resolved_at_epoch": F.lit(None).cast("long")})


def conflicts_detailed(conflicts: DataFrame, obs: DataFrame, project: str | None = None) -> DataFrame:
    side = obs.select("id", F.coalesce("title", F.lit("")).alias("title"), "project")
    newer = side.select(F.col("id").alias("newer_obs_id"), F.col("title").alias("newer_title"),
                        F.col("project").alias("newer_project"))
    older = side.select(F.col("id").alias("older_obs_id"), F.col("title").alias("older_title"),
                        F.col("project").alias("older_project"))
    j = conflicts.join(newer, "newer_obs_id").join(older, "older_obs_id")
    if project:
        j = j.filter((F.col("newer_project") == project) | (F.col("older_project") == project))
    return j


def superseded_ids(conflicts: DataFrame, obs: DataFrame, project: str | None = None) -> DataFrame:
    """Distinct ids of observations that a newer one was preferred over."""
    losers = conflicts.filter(F.col("resolution") == "prefer_newer").select(F.col("older_obs_id").alias("id"))
    rows = obs if not project else obs.filter((F.col("project") == project) | (F.col("scope") == "global"))
    return rows.select("id").join(losers, "id", "left_semi")


def mark_superseded(obs: DataFrame, conflicts: DataFrame) -> DataFrame:
    losers = conflicts.filter(F.col("resolution") == "prefer_newer").select(
        F.col("older_obs_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return obs.join(losers, "id", "left").withColumn(
        "is_superseded", F.coalesce("is_superseded", F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_hit")


def resolve_conflict(conflicts: DataFrame, decisions: DataFrame, now_ms: int) -> DataFrame:
    """Apply (id, resolution) decisions; the conflict becomes resolved at ``now_ms``."""
    d = decisions.select("id", F.col("resolution").alias("_res"))
    hit = F.col("_res").isNotNull()
    return conflicts.join(d, "id", "left").withColumns({
        "resolved": F.when(hit, F.lit(True)).otherwise(F.col("resolved")),
        "resolved_at_epoch": F.when(hit, F.lit(now_ms)).otherwise(F.col("resolved_at_epoch")),
        "resolution": F.coalesce("_res", "resolution")}).drop("_res")


def purge_set(obs: DataFrame, conflicts: DataFrame, now_ms: int,
              retention_ms: int = vocab.SUPERSEDED_RETENTION_MS) -> DataFrame:
    """Ids of superseded observations whose conflict is older than the retention time."""
    old = conflicts.filter(F.col("detected_at_epoch") < now_ms - retention_ms).select(F.col("older_obs_id").alias("id"))
    return obs.filter(F.coalesce("is_superseded", F.lit(False))).select("id").join(old, "id", "left_semi")


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(F.col("id").alias("_dead")), F.col(column) == F.col("_dead"), "left_anti")


def cascade_delete(ids: DataFrame, observations: DataFrame, vectors: DataFrame, relations: DataFrame,
                   conflicts: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the given observations and everything that refers to them."""
    is_obs = F.col("doc_type") == vocab.DOC_OBSERVATION
    return {
        "observations": without(observations, ids, "id"),
        "vectors": vectors.filter(~is_obs).unionByName(without(vectors.filter(is_obs), ids, "row_id")),
        "relations": without(without(relations, ids, "source_id"), ids, "target_id"),
        "conflicts": without(without(conflicts, ids, "newer_obs_id"), ids, "older_obs_id"),
    }


def purge_superseded(observations: DataFrame, vectors: DataFrame, relations: DataFrame, conflicts: DataFrame,
                     now_ms: int) -> dict[str, DataFrame]:
    return cascade_delete(purge_set(observations, conflicts, now_ms), observations, vectors, relations, conflicts)


def mtime_staleness(obs: DataFrame, current: DataFrame) -> DataFrame:
    """(id, is_stale): stale when a tracked file is newer now than recorded. ``current``: (path, mtime)."""
    tracked = obs.filter(F.size("file_mtimes") > 0).select("id", F.explode("file_mtimes").alias("path", "recorded"))
    stale = (tracked.join(current, "path").filter(F.col("mtime") > F.col("recorded"))
             .select("id").distinct().withColumn("is_stale", F.lit(True)))
    return obs.select("id").join(stale, "id", "left").withColumn("is_stale", F.coalesce("is_stale", F.lit(False)))


def drop_stale(obs: DataFrame, current: DataFrame) -> DataFrame:
    tracked = obs.filter(F.size("file_mtimes") > 0).select("id", F.explode("file_mtimes").alias("path", "recorded"))
    stale = tracked.join(current, "path").filter(F.col("mtime") > F.col("recorded")).select("id")
    return obs.join(stale, "id", "left_anti")
