"""The same derived tables as ``memspark.sources.views``, as ANSI-SQL common table expressions for the oracle."""

from memspark import vocab
from memspark.sources import views as V


def sql_list(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index) -> str:
    return f"({sql_list(values)})[CAST(({index}) AS INTEGER) + 1]"


TS_MS = "CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT)"
NDOC = "(SELECT count(*) FROM documents)"
CON = vocab.CONCEPT_TYPES

_CTES = {
    "obs": ("obs_v", f"""
    SELECT event_id AS id, 'u' || user_id AS sdk_session_id, 'p' || (user_id % 8) AS project,
      CASE WHEN event_id % 10 = 0 THEN 'global' ELSE 'project' END AS scope,
      CASE WHEN event_id % 6 = 5 THEN 'refactor' WHEN event_type = 'error' THEN 'bugfix'
           WHEN event_type = 'purchase' THEN 'feature' WHEN event_type = 'click' THEN 'change'
           WHEN event_type = 'view' THEN 'discovery' ELSE 'decision' END AS type,
      array_to_string(list_slice(regexp_extract_all(d.text, '[A-Za-z0-9]+'), 1, 6), ' ') AS title,
      d.source || ' ' || d.lang AS subtitle,
      ['source ' || d.source, 'lang ' || d.lang] AS facts,
      d.text || {pick(V.PHRASES, 'event_id % 12')} || 'end' AS narrative,
      [{pick(CON, 'event_id % 25')}, {pick(CON, '(event_id*7+3) % 25')}] AS concepts,
      ['src/f' || ((event_id*5) % 40) || '.go'] AS files_read,
      ['src/f' || (event_id % 40) || '.go', 'lib/f' || ((event_id*3) % 40) || '.go'] AS files_modified,
      'src/f' || (event_id % 40) || '.go' AS mtime_path,
      event_id % 5 + 1 AS prompt_number,
      {TS_MS} AS created_at_epoch,
      CASE WHEN event_id % 23 <> 0 THEN CAST((event_id*37) % 1000 AS DOUBLE) / 1000e0 + 0.5e0 END AS importance_score,
      CAST(event_id % 3 - 1 AS INTEGER) AS user_feedback,
      CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) % 8 AS retrieval_count,
      CASE WHEN event_id % 3 <> 0 THEN {TS_MS} + (event_id % 40) * 3600000 END AS score_updated_at_epoch,
      event_id % 17 = 0 AS is_superseded
    FROM events e JOIN documents d ON d.doc_id = e.event_id % {NDOC}"""),
    "prompts": ("prompts_v", f"""
    SELECT conv_id*1000+turn AS id, CASE WHEN conv_id % 7 = 3 THEN 'x' ELSE 'c' END || conv_id AS session_id, turn + 1 AS prompt_number, text AS prompt_text,
      turn AS matched_observations, {V.BASE_MS} + conv_id*3600000 + turn*60000 AS created_at_epoch
    FROM conversations WHERE role = 'user'"""),
    "sessions": ("sessions_v", f"""
    SELECT conv_id AS id, 'c' || conv_id AS session_id, 'c' || conv_id AS sdk_session_id,
      'p' || (conv_id % 8) AS project, '' AS user_prompt, {V.BASE_MS} + conv_id*3600000 AS started_at_epoch,
      {pick(vocab.SESSION_STATUSES, 'conv_id % 3')} AS status, CAST(0 AS BIGINT) AS prompt_counter
    FROM (SELECT DISTINCT conv_id FROM conversations)"""),
    "summaries": ("summaries_v", f"""
    SELECT conv_id AS id, CASE WHEN conv_id % 7 = 3 THEN 'x' ELSE 'c' END || conv_id AS sdk_session_id, 'p' || (conv_id % 8) AS project,
      arg_min(text, turn) FILTER (WHERE role = 'user') AS request,
      arg_max(text, turn) FILTER (WHERE role = 'assistant') AS learned,
      {V.BASE_MS} + conv_id*3600000 + max(turn)*60000 + 30000 AS created_at_epoch
    FROM conversations GROUP BY conv_id"""),
    "vectors": ("vectors_v", f"""
    SELECT 'vec_' || vec_id AS doc_id, embedding, vec_id AS row_id,
      {pick(['observation', 'session_summary', 'user_prompt'], 'vec_id % 3')} AS doc_type,
      {pick(['narrative', 'learned', 'prompt'], 'vec_id % 3')} AS field_type,
      'p' || (label % 8) AS project, CASE WHEN vec_id % 10 = 0 THEN 'global' ELSE 'project' END AS scope,
      CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN 'm0' ELSE 'm1' END AS model_version
    FROM embeddings"""),
    "query_texts": ("query_texts_v", f"""
    SELECT item_id AS query_id, 'p' || (item_id % 8) AS project,
      {pick(['how does ', 'fix the error in ', 'implement ', 'design of ', ''], 'item_id % 5')} || text AS query
    FROM benchmark"""),
    "relations": ("relations_v", f"""
    SELECT event_id AS id, event_id AS source_id, (event_id*13+1) % (SELECT count(*) FROM events) AS target_id,
      {pick(vocab.RELATION_TYPES, 'event_id % 6')} AS relation_type,
      0.3e0 + CAST(event_id % 7 AS DOUBLE) * 0.1e0 AS confidence,
      {pick(vocab.DETECTION_SOURCES, '(event_id+1) % 6')} AS detection_source,
      'edge ' || event_id AS reason, {TS_MS} AS created_at_epoch FROM events"""),
    "conflicts": ("conflicts_v", f"""
    SELECT event_id AS id, event_id AS newer_obs_id, (event_id*5+2) % (SELECT count(*) FROM events) AS older_obs_id,
      {pick(vocab.CONFLICT_TYPES, 'event_id % 3')} AS conflict_type,
      {pick(vocab.RESOLUTIONS, 'event_id % 3')} AS resolution,
      'conflict ' || event_id AS reason, {TS_MS} AS detected_at_epoch, event_id % 2 = 0 AS resolved FROM events"""),
    "patterns": ("patterns_v", f"""
    SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, {pick(vocab.PATTERN_TYPES, 'p_partkey % 5')} AS type,
      p_brand || ' ' || p_type AS description,
      [{pick(CON, 'p_partkey % 25')}, {pick(CON, '(p_partkey*7+3) % 25')}] AS signature,
      CASE WHEN p_partkey % 2 = 0 THEN 'prefer ' || p_name END AS recommendation,
      CAST(p_size AS BIGINT) AS frequency,
      CASE WHEN p_partkey % 8 = (p_partkey*3) % 8 THEN ['p' || (p_partkey % 8)]
           ELSE ['p' || (p_partkey % 8), 'p' || ((p_partkey*3) % 8)] END AS projects,
      CASE WHEN p_partkey % 5 = 3 THEN 'deprecated' WHEN p_partkey % 5 = 4 THEN 'merged' ELSE 'active' END AS status,
      0.3e0 + CAST(p_partkey % 7 AS DOUBLE) * 0.1e0 AS confidence,
      {V.BASE_MS} + p_partkey*60000 AS last_seen_at_epoch FROM part"""),
    "retrieval_log": ("retrieval_log_v", """
    SELECT event_id AS request_id, 'p' || (user_id % 8) AS project,
      CASE WHEN event_id % 4 = 0 THEN 'inject' ELSE 'search' END AS kind, event_id % 11 AS served,
      event_id % 3 AS verified, CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS deleted,
      CASE WHEN event_id % 5 = 0 THEN event_id // 5 ELSE event_id*7 % (SELECT count(*) FROM events) END AS obs_id, ts FROM events"""),
    "tool_events": ("tool_events_v", f"""
    SELECT event_id, 'u' || user_id AS session_id, 'p' || (user_id % 8) AS project,
      {pick(V.TOOLS, 'event_id % 12')} AS tool_name, {pick(V.TOOL_INPUTS, 'event_id % 5')} AS tool_input,
      CASE WHEN event_id % 7 = 0 THEN 'No matches found in the whole of this working tree, try again later'
           WHEN event_id % 7 = 1 THEN 'ok' ELSE d.text END AS tool_response, ts
    FROM events e JOIN documents d ON d.doc_id = e.event_id % {NDOC}"""),
}


def with_views(*names: str, extra: str = "") -> str:
    """A WITH clause that defines the named views (``obs`` becomes ``obs_v`` and so on), then ``extra`` CTEs."""
    parts = [f"{_CTES[n][0]} AS MATERIALIZED ({_CTES[n][1]})" for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def visible(alias="o", project="p.project") -> str:
    return f"(({alias}.project = {project} AND coalesce({alias}.scope,'project') = 'project') OR {alias}.scope = 'global')"
