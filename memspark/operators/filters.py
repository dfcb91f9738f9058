"""Projections, filters and simple lookups over the memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab
from memspark.functions.text import contains_any, count_present, let, str_array, strip
from memspark.operators.ordering import importance, limit_offset, order_columns


def obs_normalize(obs: DataFrame) -> DataFrame:
    return obs.withColumns({
        "scope": F.coalesce("scope", F.lit("project")),
        "importance_score": importance(),
        "user_feedback": F.coalesce("user_feedback", F.lit(0)),
        "retrieval_count": F.coalesce("retrieval_count", F.lit(0)),
        "is_superseded": F.coalesce("is_superseded", F.lit(False)),
    })


def is_visible(project: str) -> Column:
    own = (F.col("project") == project) & (F.coalesce("scope", F.lit("project")) == "project")
    return own | (F.col("scope") == "global")


def project_or_global(project: str | None) -> Column:
    return F.lit(True) if not project else (F.col("project") == project) | (F.col("scope") == "global")


def not_superseded() -> Column:
    return ~F.coalesce("is_superseded", F.lit(False))


def _top(df: DataFrame, order, limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def obs_visible(obs: DataFrame, project: str, limit: int | None = None) -> DataFrame:
    return _top(obs.filter(is_visible(project)), order_columns(), limit)


def obs_active(obs: DataFrame, project: str, limit: int | None = None) -> DataFrame:
    return _top(obs.filter(is_visible(project) & not_superseded()), order_columns(), limit)


def obs_superseded(obs: DataFrame, project: str, limit: int | None = None) -> DataFrame:
    return _top(obs.filter((F.col("project") == project) & ~not_superseded()), order_columns("date_desc"), limit)


def obs_project_strict(obs: DataFrame, project: str | None = None, limit: int | None = None) -> DataFrame:
    rows = obs if not project else obs.filter(F.col("project") == project)
    return _top(rows, order_columns(), limit)


def lookup_by_ids(df: DataFrame, ids: DataFrame, order: str = "importance", limit: int | None = None,
                  key: str = "id") -> DataFrame:
    """Rows whose key is in ``ids``; works for observations, summaries, prompts and sessions."""
    found = df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    mode = order if "importance_score" in df.columns or order.startswith("date") else "date_desc"
    return _top(found, order_columns(mode), limit)


def session_lookup(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    return sessions.join(keys.select(F.col(keys.columns[0]).alias("session_id")), "session_id", "left_semi")


def summaries_recent(summaries: DataFrame, project: str | None = None, limit: int | None = 50) -> DataFrame:
    rows = summaries if not project else summaries.filter(F.col("project") == project)
    return _top(rows, order_columns("date_desc"), limit)


def prompts_with_session(prompts: DataFrame, sessions: DataFrame) -> DataFrame:
    s = sessions.select("session_id", "project", "sdk_session_id")
    return prompts.join(s, "session_id", "left").withColumns({
        "project": F.coalesce("project", F.lit("")), "sdk_session_id": F.coalesce("sdk_session_id", F.lit(""))})


def prompts_recent(prompts: DataFrame, sessions: DataFrame, project: str | None = None,
                   limit: int | None = 100) -> DataFrame:
    """Newest prompts with their session. Without a project the cut comes before the join."""
    if project:
        return _top(prompts_with_session(prompts, sessions).filter(F.col("project") == project),
                    order_columns("date_desc"), limit)
    return prompts_with_session(_top(prompts, order_columns("date_desc"), limit), sessions)


def touches_files(files) -> Column:
    every = F.array_union(F.coalesce("files_read", str_array([])), F.coalesce("files_modified", str_array([])))
    return F.arrays_overlap(every, str_array(files))


def search_predicate(obs_types=None, concepts=None, files=None, date_start=None, date_end=None, scope=None) -> Column:
    p = F.lit(True)
    if obs_types:
        p = p & F.col("type").isin(list(obs_types))
    if concepts:
        p = p & F.arrays_overlap("concepts", str_array(concepts))
    if files:
        p = p & touches_files(files)
    if date_start:
        p = p & (F.col("created_at_epoch") >= date_start)
    if date_end:
        p = p & (F.col("created_at_epoch") <= date_end)
    if scope:
        p = p & (F.coalesce("scope", F.lit("project")) == scope)
    return p


def search_filters(obs: DataFrame, project: str | None = None, order_by: str = "date_desc", limit: int = 20,
                   offset: int = 0, exclude_superseded: bool = False, **filters) -> DataFrame:
    rows = obs.filter(search_predicate(**filters))
    if project:
        rows = rows.filter(is_visible(project))
    if exclude_superseded:
        rows = rows.filter(not_superseded())
    return limit_offset(rows, order_columns(order_by), limit, offset)


def find_by_concept(obs: DataFrame, concepts) -> DataFrame:
    return obs.filter(F.arrays_overlap("concepts", str_array(concepts)))


def find_by_file(obs: DataFrame, files) -> DataFrame:
    return obs.filter(touches_files(files))


def find_by_type(obs: DataFrame, types) -> DataFrame:
    return obs.filter(F.col("type").isin(list(types)))


def obs_needs_rescore(obs: DataFrame, now_ms: int, threshold_ms: int = vocab.RESCORE_AFTER_MS,
                      limit: int | None = vocab.RESCORE_BATCH) -> DataFrame:
    t = F.col("score_updated_at_epoch")
    return _top(obs.filter(t.isNull() | (t < now_ms - threshold_ms)), order_columns("date_desc"), limit)


def obs_most_retrieved(obs: DataFrame, project: str | None = None, limit: int | None = 50) -> DataFrame:
    rows = obs.filter((F.col("retrieval_count") > 0) & project_or_global(project))
    order = [F.col("retrieval_count").desc(), F.col("created_at_epoch").desc(), F.col("id").desc()]
    return _top(rows, order, limit)


def obs_top_scoring(obs: DataFrame, project: str | None = None, limit: int | None = 50) -> DataFrame:
    return _top(obs.filter(project_or_global(project)), order_columns(), limit)


_PATTERN_ORDER = ["frequency", "confidence"]


def _pattern_order():
    return [F.col(c).desc() for c in _PATTERN_ORDER] + [F.col("id").asc()]


def patterns_active(patterns: DataFrame, limit: int | None = 100) -> DataFrame:
    return _top(patterns.filter(F.col("status") == "active"), _pattern_order(), limit)


def patterns_by_type(patterns: DataFrame, ptype: str, limit: int | None = 100) -> DataFrame:
    return patterns_active(patterns.filter(F.col("type") == ptype), limit)


def patterns_by_project(patterns: DataFrame, project: str, limit: int | None = 100) -> DataFrame:
    return patterns_active(patterns.filter(F.array_contains("projects", project)), limit)


def patterns_by_name(patterns: DataFrame, name: str) -> DataFrame:
    return patterns.filter((F.col("status") == "active") & (F.col("name") == name))


def _edge_order():
    return [F.col("confidence").desc(), F.col("created_at_epoch").desc(), F.col("id").asc()]


def relations_of(relations: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """Edges of the given nodes, one row per (node, edge); two equality joins instead of an OR."""
    n = nodes.select(F.col(nodes.columns[0]).alias("node_id"))
    out = relations.join(n, relations["source_id"] == n["node_id"]) if direction in ("both", "out") else None
    inc = relations.join(n, relations["target_id"] == n["node_id"]) if direction in ("both", "in") else None
    if direction == "both":
        return out.unionByName(inc.filter(F.col("source_id") != F.col("target_id")))
    return out if direction == "out" else inc


def relations_by_type(relations: DataFrame, rtype: str, limit: int | None = 100) -> DataFrame:
    return _top(relations.filter(F.col("relation_type") == rtype), _edge_order(), limit)


def relations_high_conf(relations: DataFrame, min_confidence: float, limit: int | None = 100) -> DataFrame:
    return _top(relations.filter(F.col("confidence") >= min_confidence), _edge_order(), limit)


def conflicts_of(conflicts: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select(F.col(nodes.columns[0]).alias("node_id"))
    newer = conflicts.join(n, conflicts["newer_obs_id"] == n["node_id"])
    older = conflicts.filter(F.col("newer_obs_id") != F.col("older_obs_id")).join(
        n, F.col("older_obs_id") == n["node_id"])
    return newer.unionByName(older)


def conflicts_unresolved(conflicts: DataFrame, limit: int | None = None) -> DataFrame:
    order = [F.col("detected_at_epoch").desc(), F.col("id").desc()]
    return _top(conflicts.filter(~F.col("resolved")), order, limit)


def vectors_stale(vectors: DataFrame, current_model: str) -> DataFrame:
    return vectors.filter(~F.col("model_version").eqNullSafe(F.lit(current_model)))


def tool_event_filter(events: DataFrame, at_capture: bool = False) -> DataFrame:
    """Keep tool events worth remembering. ``at_capture`` also applies the stricter list used where they arise."""
    tool, out, inp = F.col("tool_name"), F.coalesce("tool_response", F.lit("")), F.coalesce("tool_input", F.lit(""))
    low_in = F.lower(inp)
    boring = (
        F.when(tool == "Read", contains_any(inp, vocab.BORING_FILES))
        .when(tool == "Grep", F.regexp_count(out, F.lit("\n")) > 50)
        .when(tool == "Bash", contains_any(low_in, vocab.BORING_COMMANDS))
        .otherwise(F.lit(False))
    )
    keep = (~tool.isin(vocab.SKIP_TOOLS) & (F.octet_length(out) >= 50)
            & ~contains_any(out, vocab.TRIVIAL_OUTPUTS, ignore_case=True) & ~boring)
    if at_capture:
        keep = keep & ~tool.isin(vocab.CAPTURE_SKIP_TOOLS)
    return events.filter(keep)


def is_summary_worthy(message: Column) -> Column:
    telling = let(F.lower(message), lambda low: (count_present(low, vocab.SUMMARY_SKIP_PHRASES) < 2)
                  & (count_present(low, vocab.WORK_INDICATORS) >= 2))
    return (F.octet_length(strip(message)) >= 200) & telling


def summary_worthy(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.filter(is_summary_worthy(F.col(text)))


def is_self_referential() -> Column:
    fields = ["request", "completed", "learned", "next_steps", "investigated", "notes"]
    content = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    return count_present(content, vocab.SELF_REFERENCE_PHRASES) >= 2


def summary_self_ref(summaries: DataFrame) -> DataFrame:
    """Drop summaries that describe the memory tooling instead of the work."""
    return summaries.filter(~is_self_referential())
