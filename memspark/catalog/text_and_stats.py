"""Registered queries: scalar text and vector functions, aggregates, positions, scoring."""

from pyspark.sql import Window, functions as F

from memspark import vocab
from memspark.catalog.sqlviews import pick, sql_list, with_views
from memspark.functions import markup, privacy, text as tx, vectors as vx
from memspark.operators import ordering as od, scoring as sc, stats as st
from memspark.sources import views as v

Q, SQL = {}, {}
NOW = v.NOW_MS


def query(name, sql=None):
    def register(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# text ---------------------------------------------------------------------------------------------------

def sql_tokens(text, min_len, stop):
    words = sql_list([w for w in stop if len(w) >= min_len])
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9_]{{{min_len},}}'), lambda w: NOT list_contains({words}, w))"


SIM_TOKENS = sql_tokens("concat_ws(' ', title, narrative, array_to_string(facts, ' '))", 3, vocab.SIMILARITY_STOPWORDS)
TERMS_SQL = (f"list_distinct(list_concat({SIM_TOKENS}, list_transform(list_concat(files_read, files_modified), "
             "lambda f: lower(regexp_extract(f, '[^/]*$')))))")


@query("determine_scope", with_views("obs") + f"""SELECT id, CASE WHEN id % 5 = 0 THEN 'project' WHEN len(list_intersect(concepts, {sql_list(vocab.GLOBALIZABLE_CONCEPTS)})) > 0
  THEN 'global' ELSE 'project' END AS scope FROM obs_v""")
def determine_scope(spark, d):
    explicit = F.when(F.col("id") % 5 == 0, "project").otherwise("")
    return v.obs(spark, d).select("id", tx.determine_scope(F.col("concepts"), explicit).alias("scope"))


@query("terms", with_views("obs") + f"SELECT id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT id, {TERMS_SQL} AS t FROM obs_v)")
def terms(spark, d):
    t = v.obs(spark, d).select("id", tx.observation_terms().alias("t"))
    return t.select("id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query("jaccard", with_views("obs") + f""", t AS MATERIALIZED (SELECT id, {TERMS_SQL} AS t FROM obs_v),
  n AS (SELECT id, t, lead(id) OVER (ORDER BY id) AS next, lead(t) OVER (ORDER BY id) AS u FROM t),
  m AS (SELECT id, len(t) + len(u) AS total, len(list_intersect(t, u)) AS shared FROM n WHERE next = id + 1)
  SELECT id, round(shared / CAST(total - shared AS DOUBLE), 6) AS jaccard FROM m""")
def jaccard(spark, d):
    """Neighbours meet in blocks of ids, to which every set goes once and the first set of the next block too; sets travel as one string."""
    terms, at = tx.observation_terms(), F.floor(F.col("id") / 256)
    packed = v.obs(spark, d).select("id", terms.alias("t")).select("id", F.when(F.size("t") > 0, F.array_join("t", "\x00")).alias("t"))
    blocks = F.when(F.col("id") % 256 == 0, F.array(at, at - 1)).otherwise(F.array(at))
    order = Window.partitionBy("block").orderBy("id")
    pairs = packed.withColumn("block", F.explode(blocks)).withColumns({
        "next": F.lead("id").over(order), "u": F.lead("t").over(order)}).filter(F.col("next") == F.col("id") + 1)
    t, u = (F.coalesce(F.split(x, "\x00"), F.array().cast("array<string>")) for x in ("t", "u"))
    return pairs.select("id", F.round(tx.jaccard(t, u), 6).alias("jaccard"))


def _ordered_distinct(expr):
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


_KW = sql_tokens("query", 4, vocab.FTS_STOPWORDS)


@query("keywords", with_views("query_texts") + f"SELECT query_id, array_to_string({_ordered_distinct('k')}, ' ') AS keywords FROM (SELECT query_id, {_KW} AS k FROM query_texts_v)")
def keywords(spark, d):
    return v.query_texts(spark, d).select("query_id", F.array_join(tx.keywords(F.col("query")), " ").alias("keywords"))


_PUNCT = ".,?!;:''\"()[]{}"
KEY_TERMS_SQL = (f"list_filter(list_transform(regexp_split_to_array(lower(trim(query)), '\\s+'), lambda w: trim(w, '{_PUNCT}')), "
                 f"lambda w: length(w) >= 2 AND NOT list_contains({sql_list(vocab.QUERY_STOPWORDS)}, w))")


@query("key_terms", with_views("query_texts") + f"SELECT query_id, array_to_string({KEY_TERMS_SQL}, ' ') AS terms FROM query_texts_v")
def key_terms(spark, d):
    return v.query_texts(spark, d).select("query_id", F.array_join(tx.key_terms(F.col("query")), " ").alias("terms"))


_SIGW = (f"list_transform(list_filter(regexp_split_to_array(title, '[ \\-_.,]'), lambda w: strlen(w) > 3 AND NOT list_contains({sql_list(vocab.SIGNATURE_STOPWORDS)}, lower(w))), lambda w: lower(w))")
SIG_SQL = f"(SELECT *, {_ordered_distinct('s0')} AS sig FROM (SELECT *, list_concat(concepts, {_SIGW}) AS s0 FROM obs_v))"


@query("signature", with_views("obs") + f"SELECT id, array_to_string(sig, '|') AS signature FROM {SIG_SQL}")
def signature(spark, d):
    return v.obs(spark, d).select("id", F.array_join(tx.signature(F.col("concepts"), F.col("title")), "|").alias("signature"))


@query("candidate_key", with_views("obs") + f"SELECT id, array_to_string(sig, '|') || '|' AS candidate_key FROM {SIG_SQL}")
def candidate_key(spark, d):
    return v.obs(spark, d).select("id", tx.candidate_key(tx.signature(F.col("concepts"), F.col("title"))).alias("candidate_key"))


@query("match_score", with_views("obs") + f""", s AS MATERIALIZED (SELECT id, sig FROM {SIG_SQL}),
  n AS (SELECT id, sig AS x, lead(id) OVER (ORDER BY id) AS next, lead(sig) OVER (ORDER BY id) AS y FROM s),
  m AS (SELECT id, x, y, len(list_filter(y, lambda w: list_contains(x, w))) AS m FROM n WHERE next = id + 1)
  SELECT id, round(m / CAST(len(x) + len(y) - m AS DOUBLE), 6) AS score FROM m""")
def match_score(spark, d):
    s = v.obs(spark, d).select("id", tx.signature(F.col("concepts"), F.col("title")).alias("x"))
    nxt = s.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return s.join(nxt, "id").select("id", F.round(tx.match_score(F.col("x"), F.col("y")), 6).alias("score"))


def any_of(col, values):
    return "(" + " OR ".join(f"contains({col}, '{x}')" for x in values) + ")"


PTYPE_SQL = (f"CASE WHEN len(list_filter(concepts, lambda c: c IN ('anti-pattern','best-practice','architecture','refactor'))) > 0 "
             f"THEN list_filter(concepts, lambda c: c IN ('anti-pattern','best-practice','architecture','refactor'))[1] "
             f"WHEN {any_of('lower(title || chr(32) || narrative)', vocab.BUG_KEYWORDS)} THEN 'bug' ELSE 'refactor' END")


@query("pattern_type", with_views("obs") + f"SELECT id, {PTYPE_SQL} AS type FROM obs_v")
def pattern_type(spark, d):
    return v.obs(spark, d).select("id", tx.pattern_type(F.col("concepts"), F.col("title"), F.col("narrative")).alias("type"))


PREFIX_SQL = "CASE ptype " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in vocab.PATTERN_NAME_PREFIX.items()) + " ELSE '' END"
PNAME_SQL = f"CASE WHEN title <> '' AND strlen(title) < 60 THEN title ELSE {PREFIX_SQL} || array_to_string(list_slice(sig, 1, 3), ', ') END"


@query("pattern_name", with_views("obs") + f"SELECT id, {PNAME_SQL} AS name FROM (SELECT id, CASE WHEN id % 2 = 0 THEN title || title ELSE title END AS title, sig, {PTYPE_SQL} AS ptype FROM {SIG_SQL})")
def pattern_name(spark, d):
    o = v.obs(spark, d)
    title = F.when(F.col("id") % 2 == 0, F.concat("title", "title")).otherwise(F.col("title"))
    o = o.select("id", title.alias("title"), tx.signature(F.col("concepts"), F.col("title")).alias("sig"),
                 tx.pattern_type(F.col("concepts"), F.col("title"), F.col("narrative")).alias("ptype"))
    return o.select("id", tx.pattern_name(F.col("ptype"), F.col("sig"), F.col("title")).alias("name"))


_TAIL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in vocab.PATTERN_INSIGHT_TAIL.items()) + f" ELSE '{vocab.PATTERN_INSIGHT_DEFAULT}' END"


@query("pattern_insight", with_views("patterns") + f"""SELECT id, 'I''ve encountered this pattern ' || frequency || ' times' ||
  CASE WHEN len(projects) > 1 THEN ' across ' || len(projects) || ' projects' ELSE '' END || '. ' ||
  CASE WHEN coalesce(recommendation,'') <> '' THEN 'What works: ' || recommendation ELSE {_TAIL} END AS insight FROM patterns_v""")
def pattern_insight(spark, d):
    return v.patterns(spark, d).select("id", tx.pattern_insight(F.col("type"), F.col("frequency"), F.col("projects"), F.col("recommendation")).alias("insight"))


def re2(p):
    return p.replace("'", "''")


INTENT_SQL = "CASE WHEN trim(query) = '' THEN 'general' " + " ".join(
    f"WHEN {' OR '.join(f'''regexp_matches(trim(query), '{re2(p)}')''' for p in ps)} THEN '{i}'" for i, ps in vocab.INTENT_PATTERNS) + " ELSE 'general' END"


@query("query_intent", with_views("query_texts") + f"SELECT query_id, {INTENT_SQL} AS intent FROM query_texts_v")
def query_intent(spark, d):
    return v.query_texts(spark, d).select("query_id", tx.query_intent(F.col("query")).alias("intent"))


_Q0 = "regexp_replace(trim(query), '\\?$', '')"
DECL_SQL = "CASE " + " ".join(f"WHEN starts_with(lower({_Q0}), '{p}') THEN trim(substr({_Q0}, {len(p) + 1}))" for p in vocab.QUESTION_PREFIXES) + f" ELSE {_Q0} END"


@query("make_declarative", with_views("query_texts") + f"SELECT query_id, {DECL_SQL} AS declarative FROM query_texts_v")
def make_declarative(spark, d):
    return v.query_texts(spark, d).select("query_id", tx.make_declarative(F.col("query")).alias("declarative"))


_PRIV = f"""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<private>' || text || '</private>'
  WHEN 1 THEN 'keep <private>a' || chr(10) || 'b</private>' || text || '<private>c</private> '
  WHEN 2 THEN ' <memory-context>old' || chr(10) || text || '</memory-context> new ' ELSE text END AS text FROM documents) """
_NOPRIV = "regexp_replace(text, '(?s)<private>.*?</private>', '', 'g')"


@query("privacy_clean", _PRIV + f"""SELECT doc_id, md5(regexp_replace(regexp_replace({_NOPRIV}, '(?s)<memory-context>.*?</memory-context>', '', 'g'),
  '^\\s+|\\s+$', '', 'g')) AS digest FROM p""")
def privacy_clean(spark, d):
    return v.private_text(spark, d).select("doc_id", F.md5(privacy.privacy_clean(F.col("text"))).alias("digest"))


@query("is_private", _PRIV + f"SELECT doc_id, regexp_replace({_NOPRIV}, '^\\s+|\\s+$', '', 'g') = '' AS private FROM p")
def is_private(spark, d):
    return v.private_text(spark, d).select("doc_id", privacy.is_private(F.col("text")).alias("private"))


_RESP = f"""WITH rsp AS (SELECT doc_id AS response_id, 'intro <observation><type>' || {pick(['bugfix', 'decision', 'other', 'feature', ''], 'doc_id % 5')} ||
  '</type><title> ' || source || ' </title><narrative>' || replace(text, '<', ' ') || '</narrative><facts><fact>one</fact><fact> two </fact></facts><concepts><concept> ' ||
  {pick(vocab.CONCEPT_TYPES, 'doc_id % 25')} || ' </concept><concept>nonsense</concept><concept>Security</concept></concepts><files_read><file>a.go</file></files_read></observation> and <observation><title>'
  || lang || '</title></observation>' AS text FROM documents),
 b AS (SELECT response_id, unnest(regexp_extract_all(text, '(?s)<observation>(.*?)</observation>', 1)) AS block, generate_subscripts(regexp_extract_all(text, '(?s)<observation>(.*?)</observation>', 1), 1) - 1 AS block_no FROM rsp),
 t AS (SELECT *, trim(regexp_extract(block, '<type>([^<]*)</type>', 1)) AS t0 FROM b),
 u AS (SELECT *, CASE WHEN t0 IN ({','.join("'" + x + "'" for x in vocab.OBSERVATION_TYPES)}) THEN t0 ELSE 'change' END AS type FROM t) """


def _sql_list_of(outer, inner):
    return f"list_transform(regexp_extract_all(regexp_extract(block, '(?s)<{outer}>(.*?)</{outer}>', 1), '<{inner}>([^<]+)</{inner}>', 1), lambda x: trim(x))"


@query("extract_observations", _RESP + f"""SELECT response_id, block_no, type, trim(regexp_extract(block, '<title>([^<]*)</title>', 1)) AS title,
  length(regexp_replace(regexp_extract(block, '<narrative>([^<]*)</narrative>', 1), '^\\s+|\\s+$', '', 'g')) AS n_narrative,
  array_to_string({_sql_list_of('facts', 'fact')}, '|') AS facts,
  array_to_string(list_filter(list_transform({_sql_list_of('concepts', 'concept')}, lambda c: lower(c)), lambda c: c <> type AND list_contains({sql_list(vocab.CONCEPT_TYPES)}, c)), '|') AS concepts,
  array_to_string({_sql_list_of('files_read', 'file')}, '|') AS files_read FROM u""")
def extract_observations(spark, d):
    o = markup.extract_observations(v.responses(spark, d))
    return o.select("response_id", "block_no", "type", "title", F.length("narrative").alias("n_narrative"),
                    *[F.array_join(c, "|").alias(c) for c in ("facts", "concepts", "files_read")])


_SUMM = """WITH s AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '<skip_summary reason="x" />' ELSE '' END || '<summary><request> ' || role ||
  ' </request><learned>' || replace(text, '<', ' ') || '</learned></summary>' AS text FROM conversations) """


@query("extract_summary", _SUMM + """SELECT conv_id, turn, trim(regexp_extract(text, '<request>([^<]*)</request>', 1)) AS request,
  length(regexp_replace(regexp_extract(text, '<learned>([^<]*)</learned>', 1), '^\\s+|\\s+$', '', 'g')) AS n_learned, '' AS notes
  FROM s WHERE NOT regexp_matches(text, '<skip_summary\\s+reason="([^"]+)"\\s*/>')""")
def extract_summary(spark, d):
    c = v.table(spark, d, "conversations")
    skip = F.when(F.col("conv_id") % 3 == 0, '<skip_summary reason="x" />').otherwise("")
    s = c.select("conv_id", "turn", F.concat(skip, F.lit("<summary><request> "), "role", F.lit(" </request><learned>"),
                                             F.regexp_replace("text", "<", " "), F.lit("</learned></summary>")).alias("text"))
    return markup.extract_summary(s).select("conv_id", "turn", "request", F.length("learned").alias("n_learned"), "notes")


@query("project_id", "SELECT page_id, regexp_extract(url, '[^/]*$') || '_' || substr(sha256(url), 1, 6) AS project FROM pages")
def project_id(spark, d):
    return v.table(spark, d, "pages").select("page_id", tx.project_id(F.col("url")).alias("project"))


@query("truncate_text", """SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS title FROM
  (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)""")
def truncate_text(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.truncate_text(F.col("text"), 100).alias("title"))


# vectors --------------------------------------------------------------------------------------------------

_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _neighbours(spark, d):
    e = v.table(spark, d, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


@query("cosine", f"SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine {_NEXT}")
def cosine(spark, d):
    return _neighbours(spark, d).select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("dist_to_sim", "SELECT event_id, round(1 - (value / 50e0) / 2e0, 6) AS similarity FROM events")
def dist_to_sim(spark, d):
    return v.table(spark, d, "events").select("event_id", F.round(vx.dist_to_sim(F.col("value") / 50.0), 6).alias("similarity"))


@query("sigmoid", "SELECT event_id, round(CASE WHEN x > 20 THEN 1e0 WHEN x < -20 THEN 0e0 ELSE 1e0 / (1e0 + exp(-x)) END, 6) AS s FROM (SELECT event_id, value - 40e0 AS x FROM events)")
def sigmoid(spark, d):
    return v.table(spark, d, "events").select("event_id", F.round(vx.sigmoid(F.col("value") - 40.0), 6).alias("s"))


@query("mask_mean_pool", f"""SELECT a.vec_id, round(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda x, i: CASE WHEN a.vec_id % 3 = 0 THEN x ELSE (x + CAST(b.embedding[i] AS DOUBLE)) / 2 END)), 6) AS total {_NEXT}""")
def mask_mean_pool(spark, d):
    second = F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1)
    pooled = vx.mask_mean_pool(F.array("embedding", "other"), F.array(F.lit(1), second))
    return _neighbours(spark, d).select("vec_id", F.round(F.aggregate(pooled, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("cls_pool", f"SELECT a.vec_id, round(list_sum(CAST(a.embedding AS DOUBLE[])), 6) AS total {_NEXT}")
def cls_pool(spark, d):
    first = vx.cls_pool(F.array("embedding", "other"))
    return _neighbours(spark, d).select("vec_id", F.round(F.aggregate(first, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


# aggregates -----------------------------------------------------------------------------------------------

_FB = """count(*) AS total, count(*) FILTER (WHERE user_feedback = 1) AS positive, count(*) FILTER (WHERE user_feedback = -1) AS negative,
  count(*) FILTER (WHERE user_feedback = 0) AS neutral, CAST(sum(CAST(coalesce(importance_score, 1e0) AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_score,
  CAST(sum(coalesce(retrieval_count, 0)) AS DOUBLE) / count(*) AS avg_retrieval"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("feedback_stats", with_views("obs") + f"SELECT {_FB} FROM obs_v")
def feedback_stats(spark, d):
    return st.feedback_stats(v.obs(spark, d))


@query("feedback_stats_by_project", with_views("obs") + f", p AS (SELECT DISTINCT project FROM obs_v) SELECT p.project, {_FB} FROM p JOIN obs_v o ON o.project = p.project OR o.scope = 'global' GROUP BY p.project")
def feedback_stats_by_project(spark, d):
    return st.feedback_stats_by_project(v.obs(spark, d))


@query("pattern_stats", with_views("patterns") + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in vocab.PATTERN_STATUSES)
       + ", CAST(sum(frequency) AS BIGINT) AS total_occurrences, CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(confidence) AS avg_confidence, "
       + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS {t.replace('-', '_')}s" for t in vocab.PATTERN_TYPES) + " FROM patterns_v")
def pattern_stats(spark, d):
    return st.pattern_stats(v.patterns(spark, d))


@query("relation_stats", with_views("relations") + """SELECT coalesce(relation_type, 'all') AS relation_type, count(*) AS total, count(*) FILTER (WHERE confidence >= 0.7e0) AS high_confidence
  FROM relations_v GROUP BY ROLLUP (relation_type)""")
def relation_stats(spark, d):
    return st.relation_stats(v.relations(spark, d))


@query("relation_degree", with_views("relations") + """SELECT obs_id, count(*) AS relations FROM (SELECT source_id AS obs_id FROM relations_v UNION ALL
  SELECT target_id FROM relations_v WHERE target_id <> source_id) GROUP BY obs_id""")
def relation_degree(spark, d):
    return st.relation_degree(v.relations(spark, d))


_COUNT = "SELECT p.project, count(*) AS observations FROM (SELECT DISTINCT project FROM obs_v) p JOIN obs_v o ON o.project = p.project OR o.scope = 'global' GROUP BY p.project"


@query("obs_count", with_views("obs") + _COUNT)
def obs_count(spark, d):
    return st.obs_count(v.obs(spark, d))


@query("projects_distinct", with_views("sessions") + "SELECT DISTINCT project FROM sessions_v WHERE project <> ''")
def projects_distinct(spark, d):
    return st.projects_distinct(v.sessions(spark, d))


_TODAY = v.BASE_MS + 2 * 86400000 + 13 * 3600000


@query("sessions_today", with_views("sessions") + f"SELECT count(*) AS sessions_today FROM sessions_v WHERE started_at_epoch >= {v.BASE_MS + 2 * 86400000}")
def sessions_today(spark, d):
    return st.sessions_today(v.sessions(spark, d), _TODAY)


_RC = """count(*) AS requests, CAST(sum(served) AS BIGINT) AS served, CAST(sum(verified) AS BIGINT) AS verified, CAST(sum(deleted) AS BIGINT) AS deleted,
  count(*) FILTER (WHERE kind = 'search') AS searches, count(*) FILTER (WHERE kind = 'inject') AS injections"""


@query("retrieval_stats", with_views("retrieval_log") + f"SELECT coalesce(project, 'all') AS project, {_RC} FROM retrieval_log_v GROUP BY ROLLUP (project)")
def retrieval_stats(spark, d):
    return st.retrieval_stats(v.retrieval_log(spark, d))


@query("retrieval_increment", with_views("obs", "retrieval_log") + f""", h AS (SELECT obs_id, count(*) AS n, CAST(floor(max(epoch_us(ts)) / 1000.0) AS BIGINT) AS last FROM retrieval_log_v GROUP BY obs_id)
  SELECT o.id, o.retrieval_count + coalesce(h.n, 0) AS retrieval_count, h.last AS last_retrieved_at_epoch FROM obs_v o LEFT JOIN h ON h.obs_id = o.id""")
def retrieval_increment(spark, d):
    return st.retrieval_increment(v.obs(spark, d), v.retrieval_log(spark, d)).select("id", "retrieval_count", "last_retrieved_at_epoch")


_STALE = "model_version IS NULL OR model_version <> 'm1'"


@query("vector_counts", with_views("vectors") + f"""SELECT count(*) AS vectors, count(*) FILTER (WHERE {_STALE}) AS stale,
  CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (WHERE {_STALE}) > 0 THEN 'model_mismatch:' || count(*) FILTER (WHERE {_STALE}) END AS verdict FROM vectors_v""")
def vector_counts(spark, d):
    return st.vector_counts(v.vectors(spark, d), v.CURRENT_MODEL)


Q["vectors_need_rebuild"] = lambda spark, d: vector_counts(spark, d).select("verdict")
SQL["vectors_need_rebuild"] = SQL["vector_counts"].replace("SELECT count(*) AS vectors", "SELECT verdict FROM (SELECT count(*) AS vectors") + ")"


@query("project_overview", with_views("obs", "sessions", "vectors", "retrieval_log") + f""", o AS ({_COUNT}),
  s AS (SELECT project, count(*) FILTER (WHERE started_at_epoch >= {v.BASE_MS + 2 * 86400000}) AS sessions_today FROM sessions_v GROUP BY project),
  vc AS (SELECT project, count(*) AS vectors FROM vectors_v GROUP BY project), r AS (SELECT project, {_RC} FROM retrieval_log_v GROUP BY project),
  p AS (SELECT project FROM o UNION SELECT project FROM s UNION SELECT project FROM vc UNION SELECT project FROM r)
  SELECT p.project, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['observations', 'sessions_today', 'vectors', *st.RETRIEVAL_COUNTERS])}
  FROM p LEFT JOIN o USING (project) LEFT JOIN s USING (project) LEFT JOIN vc USING (project) LEFT JOIN r USING (project)""")
def project_overview(spark, d):
    return st.project_overview(v.obs(spark, d), v.sessions(spark, d), v.vectors(spark, d), v.retrieval_log(spark, d), _TODAY)


# positions --------------------------------------------------------------------------------------------------

@query("keep_latest_n", with_views("obs") + """SELECT project, id FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY created_at_epoch DESC, id DESC) AS r FROM obs_v) WHERE r > 100""")
def keep_latest_n(spark, d):
    return od.keep_latest(v.obs(spark, d), vocab.KEEP_OBSERVATIONS_PER_PROJECT, "project")


@query("keep_latest_prompts", with_views("prompts") + f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at_epoch DESC, id DESC) AS r FROM prompts_v) WHERE r > {vocab.KEEP_PROMPTS}")
def keep_latest_prompts(spark, d):
    return od.keep_latest(v.prompts(spark, d), vocab.KEEP_PROMPTS)


@query("prompt_number", with_views("prompts", "sessions") + """SELECT p.id, row_number() OVER (PARTITION BY p.session_id ORDER BY p.created_at_epoch, p.id) + coalesce(s.prompt_counter, 0) AS number
  FROM prompts_v p LEFT JOIN sessions_v s ON s.session_id = p.session_id""")
def prompt_number(spark, d):
    p = v.prompts(spark, d).select("id", "session_id", "created_at_epoch")
    p = p.join(v.sessions(spark, d).select("session_id", "prompt_counter"), "session_id", "left")
    return od.number_in_group(p, "session_id", ["created_at_epoch", "id"], "number", "prompt_counter").select("id", "number")


@query("timeline_around", with_views("obs", "relations") + """, l AS (SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY created_at_epoch, id) AS pos FROM obs_v),
  a AS (SELECT l.* FROM l WHERE id IN (SELECT target_id FROM relations_v WHERE confidence > 0.85e0))
  SELECT a.id AS anchor_id, l.id, l.pos - a.pos AS "offset" FROM a JOIN l ON l.project = a.project AND l.pos BETWEEN a.pos - 10 AND a.pos + 10""")
def timeline_around(spark, d):
    anchors = v.relations(spark, d).filter(F.col("confidence") > 0.85).select(F.col("target_id").alias("anchor_id")).distinct()
    return od.around(v.obs(spark, d).select("id", "project", "created_at_epoch"), anchors).select("anchor_id", "id", "offset")


# scoring ------------------------------------------------------------------------------------------------------

_W = "CASE c " + " ".join(f"WHEN '{k}' THEN {w}e0" for k, w in vocab.DEFAULT_CONCEPT_WEIGHTS.items()) + " ELSE 0e0 END"
_TW = "CASE type " + " ".join(f"WHEN '{k}' THEN {w}e0" for k, w in vocab.TYPE_WEIGHTS.items()) + " ELSE 1e0 END"


def parts_sql(now):
    return f"""(SELECT *, type_weight * recency_decay AS core_score FROM (SELECT *, {_TW} AS type_weight, pow(0.5e0, age_days / 7e0) AS recency_decay,
    user_feedback * 0.3e0 AS feedback_part, list_sum(list_transform(concepts, lambda c: {_W})) * 0.2e0 AS concept_part,
    CASE WHEN retrieval_count > 0 THEN log2(retrieval_count + 1e0) * 0.1e0 * 0.15e0 ELSE 0e0 END AS retrieval_part
    FROM (SELECT *, greatest(({now} - created_at_epoch) / 86400000e0, 0e0) AS age_days FROM obs_v)))"""


FINAL = "greatest(core_score + feedback_part + concept_part + retrieval_part, 0.01e0)"


@query("importance_score", with_views("obs") + f"SELECT id, round({FINAL}, 6) AS score FROM {parts_sql(NOW)}")
def importance_score(spark, d):
    return sc.importance_score(v.obs(spark, d), NOW).select("id", F.round("score", 6).alias("score"))


# the age is compared in whole milliseconds: as days its sixth decimal is often an exact tie, which engines round differently
_COMP = ["type_weight", "recency_decay", "core_score", "feedback_part", "concept_part", "retrieval_part"]


@query("score_components", with_views("obs") + f"SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in _COMP)}, CAST(round(age_days * 86400000e0) AS BIGINT) AS age_ms, round({FINAL}, 6) AS final_score FROM {parts_sql(NOW)}")
def score_components(spark, d):
    return sc.score_components(v.obs(spark, d), NOW).select(
        "id", F.round(F.col("age_days") * 86400000.0).cast("long").alias("age_ms"), *[F.round(c, 6).alias(c) for c in [*_COMP, "final_score"]])


@query("rescore_batch", with_views("obs") + f"""SELECT id, round({FINAL}, 6) AS importance_score, {NOW} AS score_updated_at_epoch FROM {parts_sql(NOW)}
  WHERE score_updated_at_epoch IS NULL OR score_updated_at_epoch < {NOW - vocab.RESCORE_AFTER_MS}""")
def rescore_batch(spark, d):
    return sc.rescore_batch(v.obs(spark, d), NOW).withColumn("importance_score", F.round("importance_score", 6))


@query("apply_feedback", with_views("obs") + f""", fb AS (SELECT CASE WHEN event_id % 5 = 0 THEN event_id // 5 ELSE event_id * 3 % (SELECT count(*) FROM events) END AS id, CAST(event_id % 4 - 1 AS INTEGER) AS f, event_id AS at_no FROM events),
  l AS (SELECT id, arg_max(f, at_no) AS f FROM fb WHERE f <= 1 GROUP BY id),
  o AS (SELECT o.* REPLACE (coalesce(l.f, o.user_feedback) AS user_feedback), l.f IS NOT NULL AS hit FROM obs_v o LEFT JOIN l ON l.id = o.id)
  SELECT id, user_feedback, round(CASE WHEN hit THEN {FINAL} ELSE importance_score END, 6) AS importance_score FROM {parts_sql(NOW).replace('FROM obs_v)', 'FROM o)')}""")
def apply_feedback(spark, d):
    e, events = F.col("event_id"), v.table(spark, d, "events")
    n = events.agg(F.count("*").alias("n")).scalar()
    fb = events.select(F.when(e % 5 == 0, F.floor(e / 5)).otherwise(e * 3 % n).alias("id"), (e % 4 - 1).cast("int").alias("feedback"), e.alias("at"))
    return sc.apply_feedback(v.obs(spark, d), fb, NOW).select("id", "user_feedback", F.round("importance_score", 6).alias("importance_score"))


@query("importance_score_with_table", with_views("obs") + f"""SELECT id, round({FINAL}, 6) AS score FROM {parts_sql(NOW)}""".replace(
    _W, "CASE c " + " ".join(f"WHEN '{k}' THEN {w}e0" for k, w in vocab.SEEDED_CONCEPT_WEIGHTS.items()) + " ELSE 0e0 END"))
def importance_score_with_table(spark, d):
    w = spark.createDataFrame(list(vocab.SEEDED_CONCEPT_WEIGHTS.items()), "concept string, weight double")
    return sc.importance_score_with_table(v.obs(spark, d), w, NOW).select("id", F.round("score", 6).alias("score"))
