"""Registered queries: sources and sinks, projections, filters and lookups."""

from pyspark.sql import functions as F

from memspark import vocab
from memspark.catalog.sqlviews import pick, sql_list, visible, with_views
from memspark.functions import text as tx
from memspark.operators import feed, filters as fl, ordering as od, scoring as sc
from memspark.session import broadcast_if_small, checkpoint_root, stored, tidy
from memspark.sources import tables as tb, views as v

Q, SQL = {}, {}
NOW = v.NOW_MS
OBS_ORDER = "coalesce(importance_score, 1e0) DESC, created_at_epoch DESC, id DESC"


def query(name, sql=None):
    def register(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def scratch(spark) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    import uuid
    return f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}"


def obs_hash(o):
    """A slim, comparable projection of observations."""
    return o.select("id", "project", "scope", "type", "title", "created_at_epoch",
                    F.round(od.importance(), 6).alias("importance"))


OBS_HASH = "id, project, scope, type, title, created_at_epoch, round(coalesce(importance_score, 1e0), 6) AS importance"


# sources and sinks ------------------------------------------------------------------------------------

@query("io_tables", with_views("obs") + f"""SELECT id, project, coalesce(scope,'project') AS scope, type,
  length(narrative) AS n_narrative, array_to_string(concepts, ',') AS concepts, created_at_epoch FROM obs_v""")
def io_tables(spark, d):
    root = scratch(spark)
    tb.write_table(v.obs(spark, d), root, "observations", "overwrite")
    return tb.read_table(spark, root, "observations").select(
        "id", "project", "scope", "type", F.length("narrative").alias("n_narrative"),
        F.array_join("concepts", ",").alias("concepts"), "created_at_epoch")


@query("io_json_cols", with_views("obs") + """SELECT id, array_to_string(concepts, '|') AS concepts,
  CASE WHEN id % 5 = 0 THEN NULL ELSE array_to_string(files_modified, '|') END AS files_modified,
  created_at_epoch AS mtime FROM obs_v""")
def io_json_cols(spark, d):
    o = v.obs(spark, d)
    raw = o.select("id", *[tb.encode_json(c).alias(c) for c in ("facts", "concepts", "files_read")],
                   F.when(F.col("id") % 5 == 0, "").otherwise(tb.encode_json("files_modified")).alias("files_modified"),
                   tb.encode_json("file_mtimes").alias("file_mtimes"))
    n = tb.decode_observation_json(raw)
    return n.select("id", F.array_join("concepts", "|").alias("concepts"), F.array_join("files_modified", "|").alias("files_modified"),
                    F.element_at(F.map_values("file_mtimes"), 1).alias("mtime"))


@query("io_export_json", with_views("summaries") + """SELECT id, investigated_present, coalesce(request,'') AS request,
  learned_present FROM (SELECT id, request, false AS investigated_present, learned IS NOT NULL AS learned_present FROM summaries_v)""")
def io_export_json(spark, d):
    j = tb.export_json(v.summaries(spark, d))
    return j.select(
        F.get_json_object("json", "$.id").cast("long").alias("id"),
        F.contains("json", F.lit('"investigated":')).alias("investigated_present"),
        F.coalesce(F.get_json_object("json", "$.request"), F.lit("")).alias("request"),
        F.get_json_object("json", "$.learned").isNotNull().alias("learned_present"))


_TRANSCRIPT = """SELECT 'c' || conv_id AS path,
  arg_max(CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || 'tail' END, turn) FILTER (WHERE role = 'user' AND (text <> '' OR turn % 2 = 1)) AS last_user,
  arg_max(CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || 'tail' END, turn) FILTER (WHERE role = 'assistant' AND (text <> '' OR turn % 2 = 1)) AS last_assistant
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role IN ('user','assistant')) > 0"""


@query("io_transcripts", _TRANSCRIPT)
def io_transcripts(spark, d):
    return tb.last_messages(v.transcript_lines(spark, d))


Q["last_message"], SQL["last_message"] = io_transcripts, _TRANSCRIPT


@query("io_tool_events", with_views("tool_events") + """SELECT tool_name, count(*) AS n, sum(length(tool_response)) AS chars
  FROM tool_events_v GROUP BY tool_name""")
def io_tool_events(spark, d):
    root = scratch(spark)
    v.tool_events(spark, d).write.parquet(root)
    return tb.read_tool_events(spark, root).groupBy("tool_name").agg(
        F.count("*").alias("n"), F.sum(F.length("tool_response")).alias("chars"))


@query("io_insert_ignore", with_views("relations") + """, k AS (SELECT DISTINCT source_id, target_id, relation_type FROM relations_v),
  old AS (SELECT DISTINCT source_id, target_id, relation_type FROM relations_v WHERE confidence > 0.65e0)
  SELECT count(*) AS inserted, sum(source_id) AS source_sum FROM (SELECT * FROM k EXCEPT SELECT * FROM old)""")
def io_insert_ignore(spark, d):
    r = v.relations(spark, d)
    new = tb.insert_ignore(r.filter(F.col("confidence") > 0.65), r.unionByName(r), tb.UNIQUE_KEYS["relations"])
    return new.agg(F.count("*").alias("inserted"), F.sum("source_id").alias("source_sum"))


@query("io_append", with_views("obs") + f""", base AS (SELECT max(id) AS m FROM obs_v)
  SELECT m + row_number() OVER (ORDER BY created_at_epoch, id) AS id, id AS old_id,
    CASE WHEN len(list_intersect(concepts, {sql_list(vocab.GLOBALIZABLE_CONCEPTS)})) > 0 THEN 'global' ELSE 'project' END AS scope,
    nullif(CASE WHEN id % 3 = 0 THEN '' ELSE title END, '') AS title FROM obs_v, base""")
def io_append(spark, d):
    o = v.obs(spark, d)
    parsed = o.withColumns({"old_id": F.col("id"), "at": F.col("created_at_epoch"), "scope": F.lit(""),
                            "title": F.when(F.col("id") % 3 == 0, "").otherwise(F.col("title"))})
    rows = tb.prepare_observations(parsed, NOW).select("old_id", "at", "scope", "title")
    return tb.with_new_ids(rows, o, ["at", "old_id"]).select("id", "old_id", "scope", "title")


@query("io_upsert", """WITH w AS (SELECT p_brand AS concept, p_size AS weight, p_partkey AS seq FROM part),
  latest AS (SELECT concept, arg_max(weight, seq) AS weight FROM w WHERE seq % 2 = 1 GROUP BY concept),
  old AS (SELECT concept, arg_min(weight, seq) AS weight FROM w GROUP BY concept)
  SELECT old.concept, CAST(coalesce(latest.weight, old.weight) AS DOUBLE) AS weight FROM old LEFT JOIN latest USING (concept)""")
def io_upsert(spark, d):
    w = v.table(spark, d, "part").select(F.col("p_brand").alias("concept"), F.col("p_size").cast("double").alias("weight"),
                                         F.col("p_partkey").alias("updated_at_epoch"))
    old = tb.first_of_key(w, ["concept"], "updated_at_epoch")
    return tb.upsert(old, w.filter(F.col("updated_at_epoch") % 2 == 1), ["concept"], "updated_at_epoch").select("concept", "weight")


@query("io_session_upsert", with_views("sessions", "prompts") + """, req AS (
    SELECT session_id, CASE WHEN prompt_number % 3 = 0 THEN '' ELSE 'q' || (prompt_number % 3) END AS project, prompt_text AS p,
      created_at_epoch AS at_ms, prompt_number AS seq FROM prompts_v),
  r AS (SELECT session_id, arg_max(project, seq) FILTER (WHERE project <> '') AS np, arg_max(p, seq) FILTER (WHERE project <> '') AS npr,
      arg_min(project, seq) AS fp, arg_min(p, seq) AS fpr, min(at_ms) AS at_ms FROM req GROUP BY session_id)
  SELECT coalesce(s.id, row_number() OVER (PARTITION BY s.id IS NULL ORDER BY r.session_id) + (SELECT max(id) FROM sessions_v)) AS id,
    coalesce(s.session_id, r.session_id) AS session_id, coalesce(np, s.project, fp) AS project,
    length(CASE WHEN np IS NOT NULL THEN npr ELSE coalesce(s.user_prompt, fpr) END) AS n_prompt,
    coalesce(s.started_at_epoch, r.at_ms) AS started_at_epoch, coalesce(s.status, 'active') AS status
  FROM sessions_v s FULL JOIN r ON s.session_id = r.session_id""")
def io_session_upsert(spark, d):
    n = F.col("prompt_number") % 3
    req = v.prompts(spark, d).select(
        "session_id", F.when(n == 0, "").otherwise(F.concat(F.lit("q"), n)).alias("project"),
        F.col("prompt_text").alias("user_prompt"), F.col("created_at_epoch").alias("at_epoch"), F.col("prompt_number").alias("seq"))
    return tb.session_upsert(v.sessions(spark, d), req).select(
        "id", "session_id", "project", F.length("user_prompt").cast("long").alias("n_prompt"), "started_at_epoch", "status")


@query("io_ensure_parent", with_views("sessions", "summaries") + """SELECT row_number() OVER (ORDER BY sdk_session_id) + (SELECT max(id) FROM sessions_v) AS id, sdk_session_id AS session_id, min(project) AS project,
  min(created_at_epoch) AS started_at_epoch FROM summaries_v WHERE sdk_session_id NOT IN (SELECT sdk_session_id FROM sessions_v)
  GROUP BY sdk_session_id""")
def io_ensure_parent(spark, d):
    return tb.ensure_parent(v.sessions(spark, d), v.summaries(spark, d)).select("id", "session_id", "project", "started_at_epoch")


_CTX = ("'## ' || rank || '. [' || upper(type) || '] ' || title || chr(10) || narrative || chr(10) || 'Key facts:' || chr(10) || "
        "'- ' || facts[1] || chr(10) || '- ' || facts[2] || chr(10) || chr(10)")


@query("io_context_doc", with_views("obs") + f""", r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {OBS_ORDER}) AS rank FROM obs_v),
  e AS (SELECT project, rank, CASE WHEN rank <= 25 THEN {_CTX} ELSE '- [' || upper(type) || '] ' || title || ': ' || subtitle || chr(10) END AS x
    FROM r WHERE rank <= 100)
  SELECT project, count(*) AS observations, md5('<memory-context>' || chr(10) || '# Project Memory (' || count(*) || ' observations)' || chr(10) ||
    'Use this knowledge to answer questions without re-exploring the codebase.' || chr(10) || chr(10) ||
    string_agg(x, '' ORDER BY rank) || '</memory-context>' || chr(10)) AS digest FROM e GROUP BY project""")
def io_context_doc(spark, d):
    o = v.obs(spark, d)
    ranks = od.top_per_group(o.select("id", "project", "importance_score", "created_at_epoch"), "project", od.order_columns(), 100, "rank")
    # the listed ids go to the texts, which are not shuffled
    rows = o.join(broadcast_if_small(stored(ranks.select("id", "rank")), od.SMALL_IDS), "id")
    tidy(spark)
    return feed.context_doc(rows, "project", 25).select("project", "observations", F.md5("document").alias("digest"))


_RANK = with_views("obs") + f"""SELECT project, id, rank, CASE WHEN rank <= 25 THEN 'full' ELSE 'line' END AS form FROM
  (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY {OBS_ORDER}) AS rank FROM obs_v) WHERE rank <= 100"""


@query("context_rank", _RANK)
def context_rank(spark, d):
    r = od.top_per_group(v.obs(spark, d).select("id", "project", "importance_score", "created_at_epoch"), "project", od.order_columns(), 100, "rank")
    return r.select("project", "id", "rank", F.when(F.col("rank") <= 25, "full").otherwise("line").alias("form"))


# projections, filters, lookups ----------------------------------------------------------------------------

@query("obs_normalize", with_views("obs") + """SELECT id, coalesce(scope,'project') AS scope, round(coalesce(importance_score,1e0),6) AS importance_score,
  coalesce(user_feedback,0) AS user_feedback, coalesce(retrieval_count,0) AS retrieval_count, coalesce(is_superseded,false) AS is_superseded FROM obs_v""")
def obs_normalize(spark, d):
    return fl.obs_normalize(v.obs(spark, d)).select("id", "scope", F.round("importance_score", 6).alias("importance_score"),
                                                    "user_feedback", "retrieval_count", "is_superseded")


@query("obs_visible", with_views("obs") + f"SELECT {OBS_HASH} FROM obs_v o WHERE {visible('o', chr(39) + 'p3' + chr(39))}")
def obs_visible(spark, d):
    return obs_hash(fl.obs_visible(v.obs(spark, d), "p3"))


@query("obs_active", with_views("obs") + f"SELECT {OBS_HASH} FROM obs_v o WHERE {visible('o', chr(39) + 'p3' + chr(39))} AND NOT is_superseded")
def obs_active(spark, d):
    return obs_hash(fl.obs_active(v.obs(spark, d), "p3"))


@query("obs_superseded", with_views("obs") + f"SELECT {OBS_HASH} FROM obs_v WHERE project = 'p3' AND is_superseded")
def obs_superseded(spark, d):
    return obs_hash(fl.obs_superseded(v.obs(spark, d), "p3"))


@query("obs_project_strict", with_views("obs") + f"SELECT {OBS_HASH} FROM obs_v WHERE project = 'p3' ORDER BY {OBS_ORDER} LIMIT 100")
def obs_project_strict(spark, d):
    return obs_hash(fl.obs_project_strict(v.obs(spark, d), "p3", 100))


_TOPK = with_views("obs") + f""", p AS (SELECT DISTINCT project FROM obs_v), r AS (
  SELECT p.project AS viewer, o.id, row_number() OVER (PARTITION BY p.project ORDER BY coalesce(o.importance_score,1e0) DESC, o.created_at_epoch DESC, o.id DESC) AS rank
  FROM p JOIN obs_v o ON {visible()}) SELECT viewer, id, rank FROM r WHERE rank <= 50"""


@query("topk_importance", _TOPK)
def topk_importance(spark, d):
    return od.visible_top(v.obs(spark, d), 50).select("viewer", "id", "rank")


@query("lookup_by_ids", with_views("obs", "relations") + f"""SELECT {OBS_HASH} FROM obs_v WHERE id IN
  (SELECT target_id FROM relations_v WHERE relation_type = 'fixes')""")
def lookup_by_ids(spark, d):
    ids = v.relations(spark, d).filter(F.col("relation_type") == "fixes").select("target_id")
    return obs_hash(fl.lookup_by_ids(v.obs(spark, d), ids))


@query("session_lookup", with_views("sessions", "prompts") + """SELECT session_id, project, status FROM sessions_v
  WHERE session_id IN (SELECT session_id FROM prompts_v WHERE prompt_number >= 3)""")
def session_lookup(spark, d):
    keys = v.prompts(spark, d).filter(F.col("prompt_number") >= 3).select("session_id")
    return fl.session_lookup(v.sessions(spark, d), keys).select("session_id", "project", "status")


@query("summaries_recent", with_views("summaries") + """SELECT project, id, created_at_epoch, rank FROM (SELECT project, id, created_at_epoch,
  row_number() OVER (PARTITION BY project ORDER BY created_at_epoch DESC, id DESC) AS rank FROM summaries_v) WHERE rank <= 50""")
def summaries_recent(spark, d):
    s = v.summaries(spark, d).select("project", "id", "created_at_epoch")
    return od.top_per_group(s, "project", od.order_columns("date_desc"), 50, "rank")


_PWS = "SELECT p.id, p.session_id, p.prompt_number, coalesce(s.project,'') AS project, coalesce(s.sdk_session_id,'') AS sdk_session_id, p.created_at_epoch FROM prompts_v p LEFT JOIN sessions_v s ON p.session_id = s.session_id"
_PCOLS = ["id", "session_id", "prompt_number", "project", "sdk_session_id", "created_at_epoch"]


@query("prompts_with_session", with_views("prompts", "sessions") + _PWS)
def prompts_with_session(spark, d):
    return fl.prompts_with_session(v.prompts(spark, d), v.sessions(spark, d)).select(*_PCOLS)


@query("prompts_recent", with_views("prompts", "sessions") + _PWS + " ORDER BY p.created_at_epoch DESC, p.id DESC LIMIT 100")
def prompts_recent(spark, d):
    return fl.prompts_recent(v.prompts(spark, d), v.sessions(spark, d)).select(*_PCOLS)


_SF = dict(obs_types=["bugfix", "feature"], concepts=["security", "testing", "caching"], files=["src/f3.go", "lib/f9.go", "src/f20.go", "src/f8.go", "lib/f21.go"],
           date_start=v.BASE_MS + 86400000, date_end=v.BASE_MS + 25 * 86400000)


@query("search_filters", with_views("obs") + f"""SELECT {OBS_HASH} FROM obs_v WHERE type IN ('bugfix','feature')
  AND len(list_intersect(concepts, {sql_list(_SF['concepts'])})) > 0
  AND len(list_intersect(list_concat(files_read, files_modified), {sql_list(_SF['files'])})) > 0
  AND created_at_epoch BETWEEN {_SF['date_start']} AND {_SF['date_end']} ORDER BY created_at_epoch DESC, id DESC LIMIT 100 OFFSET 5""")
def search_filters(spark, d):
    return obs_hash(fl.search_filters(v.obs(spark, d), limit=250, offset=5, **_SF))


Q["limit_offset"], SQL["limit_offset"] = (
    lambda spark, d: od.limit_offset(v.summaries(spark, d), od.order_columns("date_asc"), 0, 7).select("id", "created_at_epoch"),
    with_views("summaries") + "SELECT id, created_at_epoch FROM summaries_v ORDER BY created_at_epoch, id LIMIT 20 OFFSET 7")


@query("order_modes", with_views("obs") + f"""SELECT 'date_asc' AS mode, id FROM (SELECT id FROM obs_v ORDER BY created_at_epoch, id LIMIT 30) UNION ALL
  SELECT 'date_desc', id FROM (SELECT id FROM obs_v ORDER BY created_at_epoch DESC, id DESC LIMIT 30) UNION ALL
  SELECT 'importance', id FROM (SELECT id FROM obs_v ORDER BY {OBS_ORDER} LIMIT 30)""")
def order_modes(spark, d):
    o = v.obs(spark, d)
    parts = [o.orderBy(*od.order_columns(m)).limit(30).select(F.lit(m).alias("mode"), "id") for m in ("date_asc", "date_desc", "importance")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("find_by_concept", with_views("obs") + f"SELECT {OBS_HASH} FROM obs_v WHERE len(list_intersect(concepts, ['security','auth'])) > 0")
def find_by_concept(spark, d):
    return obs_hash(fl.find_by_concept(v.obs(spark, d), ["security", "auth"]))


@query("find_by_file", with_views("obs") + f"SELECT {OBS_HASH} FROM obs_v WHERE len(list_intersect(list_concat(files_read, files_modified), ['src/f7.go','lib/f12.go'])) > 0")
def find_by_file(spark, d):
    return obs_hash(fl.find_by_file(v.obs(spark, d), ["src/f7.go", "lib/f12.go"]))


@query("find_by_type", with_views("obs") + f"SELECT {OBS_HASH} FROM obs_v WHERE type IN ('decision','refactor')")
def find_by_type(spark, d):
    return obs_hash(fl.find_by_type(v.obs(spark, d), ["decision", "refactor"]))


@query("feed_filter", with_views("obs") + f"SELECT id, type FROM obs_v WHERE type = 'bugfix' AND list_contains(concepts, 'security')")
def feed_filter(spark, d):
    f = feed.feed_union(v.obs(spark, d), v.prompts(spark, d), v.summaries(spark, d))
    return feed.feed_filter(f, "observation", "bugfix", "security").select("id", "type")


_FEED = with_views("obs", "prompts", "summaries") + """, f AS (SELECT 'observation' AS item_type, id, created_at_epoch FROM obs_v
  UNION ALL SELECT 'prompt', id, created_at_epoch FROM prompts_v UNION ALL SELECT 'summary', id, created_at_epoch FROM summaries_v) """


@query("feed_union", _FEED + "SELECT item_type, id, created_at_epoch FROM f")
def feed_union(spark, d):
    return feed.feed_union(v.obs(spark, d), v.prompts(spark, d), v.summaries(spark, d)).select("item_type", "id", "created_at_epoch")


@query("feed_newest", _FEED + "SELECT item_type, id, created_at_epoch FROM f ORDER BY created_at_epoch DESC, item_type, id LIMIT 100")
def feed_newest(spark, d):
    return feed.newest_items(feed_union(spark, d), 100)


@query("obs_needs_rescore", with_views("obs") + f"""SELECT {OBS_HASH} FROM obs_v WHERE score_updated_at_epoch IS NULL OR score_updated_at_epoch < {NOW - vocab.RESCORE_AFTER_MS}
  ORDER BY created_at_epoch DESC, id DESC LIMIT 500""")
def obs_needs_rescore(spark, d):
    return obs_hash(fl.obs_needs_rescore(v.obs(spark, d), NOW))


@query("obs_most_retrieved", with_views("obs") + f"""SELECT {OBS_HASH}, retrieval_count FROM obs_v WHERE retrieval_count > 0 AND (project = 'p3' OR scope = 'global')
  ORDER BY retrieval_count DESC, created_at_epoch DESC, id DESC LIMIT 50""")
def obs_most_retrieved(spark, d):
    o = fl.obs_most_retrieved(v.obs(spark, d), "p3")
    return o.select("id", "project", "scope", "type", "title", "created_at_epoch", F.round(od.importance(), 6).alias("importance"), "retrieval_count")


@query("obs_top_scoring", with_views("obs") + f"SELECT {OBS_HASH} FROM obs_v WHERE project = 'p3' OR scope = 'global' ORDER BY {OBS_ORDER} LIMIT 50")
def obs_top_scoring(spark, d):
    return obs_hash(fl.obs_top_scoring(v.obs(spark, d), "p3"))


@query("concept_weights", "SELECT p_brand AS concept, max(p_size) / 100e0 AS weight FROM part GROUP BY p_brand UNION ALL "
       + "SELECT * FROM (VALUES " + ",".join(f"('default:{k}', {w}e0)" for k, w in vocab.DEFAULT_CONCEPT_WEIGHTS.items()) + ") AS t(concept, weight)")
def concept_weights(spark, d):
    stored = v.table(spark, d, "part").groupBy(F.col("p_brand").alias("concept")).agg((F.max("p_size") / 100.0).alias("weight"))
    empty = stored.filter(F.col("weight") < 0)
    return sc.concept_weights(stored).unionByName(
        sc.concept_weights(empty).withColumn("concept", F.concat(F.lit("default:"), "concept")))


_PAT = "id, name, type, frequency, round(confidence, 6) AS confidence"
_PAT_ORDER = "ORDER BY frequency DESC, confidence DESC, id LIMIT 100"


def _pat(p):
    return p.select("id", "name", "type", "frequency", F.round("confidence", 6).alias("confidence"))


@query("patterns_active", with_views("patterns") + f"SELECT {_PAT} FROM patterns_v WHERE status = 'active' {_PAT_ORDER}")
def patterns_active(spark, d):
    return _pat(fl.patterns_active(v.patterns(spark, d)))


@query("patterns_by_type", with_views("patterns") + f"SELECT {_PAT} FROM patterns_v WHERE status = 'active' AND type = 'bug' {_PAT_ORDER}")
def patterns_by_type(spark, d):
    return _pat(fl.patterns_by_type(v.patterns(spark, d), "bug"))


@query("patterns_by_project", with_views("patterns") + f"SELECT {_PAT} FROM patterns_v WHERE status = 'active' AND list_contains(projects, 'p5') {_PAT_ORDER}")
def patterns_by_project(spark, d):
    return _pat(fl.patterns_by_project(v.patterns(spark, d), "p5"))


@query("patterns_by_name", with_views("patterns") + f"SELECT {_PAT} FROM patterns_v WHERE status = 'active' AND name = (SELECT max(name) FROM patterns_v WHERE status = 'active')")
def patterns_by_name(spark, d):
    p = v.patterns(spark, d)
    name = p.filter(F.col("status") == "active").agg(F.max("name").alias("n")).scalar()
    return _pat(p.filter((F.col("status") == "active") & (F.col("name") == name)))


@query("conflicts_unresolved", with_views("conflicts") + "SELECT id, newer_obs_id, older_obs_id, conflict_type FROM conflicts_v WHERE NOT resolved")
def conflicts_unresolved(spark, d):
    return fl.conflicts_unresolved(v.conflicts(spark, d)).select("id", "newer_obs_id", "older_obs_id", "conflict_type")


@query("conflicts_of", with_views("conflicts", "obs") + """SELECT o.id AS node_id, c.id FROM obs_v o JOIN conflicts_v c ON c.newer_obs_id = o.id OR c.older_obs_id = o.id
  WHERE o.type = 'bugfix'""")
def conflicts_of(spark, d):
    nodes = v.obs(spark, d).filter(F.col("type") == "bugfix").select("id")
    return fl.conflicts_of(v.conflicts(spark, d), nodes).select("node_id", "id")


@query("vectors_stale", with_views("vectors") + "SELECT doc_id, row_id, doc_type FROM vectors_v WHERE model_version IS NULL OR model_version <> 'm1'")
def vectors_stale(spark, d):
    return fl.vectors_stale(v.vectors(spark, d), v.CURRENT_MODEL).select("doc_id", "row_id", "doc_type")


def _like_any(col, values):
    return "(" + " OR ".join(f"contains({col}, '" + x.replace("'", "''") + "')" for x in values) + ")"


def _count(col, values):
    return "(" + " + ".join(f"CAST(contains({col}, '" + x.replace("'", "''") + "') AS INTEGER)" for x in values) + ")"


_KEEP = f"""tool_name NOT IN ({','.join("'" + t + "'" for t in vocab.SKIP_TOOLS)}) AND strlen(tool_response) >= 50
  AND NOT {_like_any('lower(tool_response)', vocab.TRIVIAL_OUTPUTS)}
  AND NOT (tool_name = 'Read' AND {_like_any('tool_input', vocab.BORING_FILES)})
  AND NOT (tool_name = 'Grep' AND length(tool_response) - length(replace(tool_response, chr(10), '')) > 50)
  AND NOT (tool_name = 'Bash' AND {_like_any('lower(tool_input)', vocab.BORING_COMMANDS)})"""


@query("tool_event_filter", with_views("tool_events") + f"SELECT event_id, tool_name FROM tool_events_v WHERE {_KEEP}")
def tool_event_filter(spark, d):
    return fl.tool_event_filter(v.tool_events(spark, d)).select("event_id", "tool_name")


_WORTHY = f"""strlen(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 200 AND {_count('lower(text)', vocab.SUMMARY_SKIP_PHRASES)} < 2
  AND {_count('lower(text)', vocab.WORK_INDICATORS)} >= 2"""


@query("summary_worthy", with_views("obs") + f"""SELECT id FROM (SELECT id, narrative || CASE WHEN id % 7 = 0 THEN ' waiting for no work done' ELSE ' in ' END
  || files_modified[1] AS text FROM obs_v) WHERE {_WORTHY}""")
def summary_worthy(spark, d):
    o = v.obs(spark, d)
    tail = F.when(F.col("id") % 7 == 0, " waiting for no work done").otherwise(" in ")
    return fl.summary_worthy(o.select("id", F.concat("narrative", tail, F.get("files_modified", 0)).alias("text"))).select("id")


_SELF = [" memory agent", " no work done", " role definition", ""]


@query("summary_self_ref", with_views("summaries") + f""", t AS (SELECT id, coalesce(request,'') || {pick(_SELF, 'id % 4')} AS request,
  coalesce(learned,'') || {pick(_SELF, '(id * 3 + 1) % 4')} AS learned FROM summaries_v)
  SELECT id FROM t WHERE {_count("lower(request || '  ' || learned || '   ')", vocab.SELF_REFERENCE_PHRASES)} < 2""")
def summary_self_ref(spark, d):
    i = F.col("id")
    s = v.summaries(spark, d)

    def tail(c, k):
        return F.concat(F.coalesce(c, F.lit("")), F.element_at(tx.str_array(_SELF), (k + 1).cast("int")))

    s = s.withColumns({"request": tail("request", i % 4), "learned": tail("learned", (i * 3 + 1) % 4)})
    return fl.summary_self_ref(s).select("id")


_EDGE = "ORDER BY confidence DESC, created_at_epoch DESC, id LIMIT 100"


@query("relations_by_type", with_views("relations") + f"SELECT id, round(confidence,6) AS confidence FROM relations_v WHERE relation_type = 'causes' {_EDGE}")
def relations_by_type(spark, d):
    return fl.relations_by_type(v.relations(spark, d), "causes").select("id", F.round("confidence", 6).alias("confidence"))


@query("relations_high_conf", with_views("relations") + f"SELECT id, round(confidence,6) AS confidence FROM relations_v WHERE confidence >= 0.7e0 {_EDGE}")
def relations_high_conf(spark, d):
    return fl.relations_high_conf(v.relations(spark, d), 0.7).select("id", F.round("confidence", 6).alias("confidence"))


@query("relations_of", with_views("relations", "obs") + """SELECT o.id AS node_id, r.id FROM obs_v o JOIN relations_v r ON r.source_id = o.id OR r.target_id = o.id
  WHERE o.type = 'decision'""")
def relations_of(spark, d):
    nodes = v.obs(spark, d).filter(F.col("type") == "decision").select("id")
    return fl.relations_of(v.relations(spark, d), nodes).select("node_id", "id")
