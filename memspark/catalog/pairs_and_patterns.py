"""Registered queries: relations, conflicts, retention, patterns, graph."""

from pyspark.sql import functions as F

from memspark import vocab
from memspark.catalog.sqlviews import sql_list, with_views
from memspark.catalog.tables_and_filters import _TOPK
from memspark.catalog.text_and_stats import PNAME_SQL, PTYPE_SQL, SIG_SQL
from memspark.operators import conflicts as cf, filters as fl, graph as gr, pairs as pr, patterns as pt, relations as rl
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


# candidate pairs and relations ---------------------------------------------------------------------------

_EARLIER = "(o.created_at_epoch < n.created_at_epoch OR (o.created_at_epoch = n.created_at_epoch AND o.id < n.id))"
PAIRS = with_views("obs") + f""", slim AS MATERIALIZED (SELECT id, project, coalesce(scope, 'project') AS scope, coalesce(importance_score, 1e0) AS imp, created_at_epoch FROM obs_v),
  b AS MATERIALIZED (SELECT n_id, o_id FROM (SELECT n.id AS n_id, o.id AS o_id,
      row_number() OVER (PARTITION BY n.id ORDER BY o.imp DESC, o.created_at_epoch DESC, o.id DESC) AS rank
    FROM slim n JOIN (SELECT s.*, p.project AS viewer FROM slim s JOIN (SELECT DISTINCT project FROM slim) p
        ON s.scope = 'global' OR s.project = p.project) o ON o.viewer = n.project AND {_EARLIER}) WHERE rank <= 50),
  wide AS MATERIALIZED (SELECT * FROM obs_v),
  pairs AS (SELECT n AS n, o AS o FROM b JOIN wide n ON n.id = b.n_id JOIN wide o ON o.id = b.o_id)"""


def _relation_pairs(spark, d):
    o = v.obs(spark, d)
    return rl.relation_pairs(o, o)


def _conflict_pairs(spark, d):
    o = v.obs(spark, d)
    return cf.conflict_pairs(o, o)


@query("candidate_pairs", PAIRS + " SELECT n.id AS n_id, o.id AS o_id FROM pairs")
def candidate_pairs(spark, d):
    o = v.obs(spark, d)
    return pr.candidate_pairs(o, o, ["id"], ["id"]).select("n_id", "o_id")


_SHARED = "list_intersect(n.files_modified, o.files_modified)"
_READS = "list_filter(n.files_read, lambda f: list_contains(o.files_modified, f))"
_SHC = "list_filter(o.concepts, lambda c: list_contains(n.concepts, c))"


@query("file_overlap_pairs", PAIRS + f" SELECT n.id AS n_id, o.id AS o_id, len({_SHARED}) AS shared_modified, len({_READS}) AS reads_modified FROM pairs WHERE len({_SHARED}) + len({_READS}) > 0")
def file_overlap_pairs(spark, d):
    return pr.file_overlap_pairs(_relation_pairs(spark, d)).select("n_id", "o_id", "shared_modified", "reads_modified")


@query("concept_overlap_pairs", PAIRS + f" SELECT n.id AS n_id, o.id AS o_id, len({_SHC}) AS shared_concepts FROM pairs WHERE len({_SHC}) > 0")
def concept_overlap_pairs(spark, d):
    return pr.concept_overlap_pairs(_relation_pairs(spark, d)).select("n_id", "o_id", "shared_concepts")


_FIX = "n.type = 'bugfix' AND o.type IN ('decision','feature')"
_EVO = "n.type = 'refactor' AND o.type = 'discovery'"
_SUP = f"n.type = o.type AND len({_SHARED}) > 0"
_DEP = "n.type = 'feature' AND o.type = 'decision'"
_OVER = f"(len({_SHARED}) + len({_READS}))"
F_TYPE = f"CASE WHEN {_FIX} THEN 'fixes' WHEN {_EVO} THEN 'evolves_from' WHEN {_SUP} THEN 'supersedes' WHEN {_DEP} THEN 'depends_on' ELSE 'relates_to' END"
F_BONUS = f"CASE WHEN {_FIX} THEN 0.2e0 WHEN {_EVO} THEN 0.15e0 WHEN {_SUP} THEN 0.1e0 WHEN {_DEP} THEN 0.15e0 ELSE 0e0 END"
F_CONF = f"CASE WHEN {_OVER} > 0 THEN least(0.5e0 + {_OVER} * 0.1e0 + {F_BONUS}, 1e0) END"
F_REASON = (f"array_to_string(list_filter([CASE WHEN len({_SHARED}) > 0 THEN 'both modified: ' || array_to_string(list_sort({_SHARED}), ', ') END, "
            f"CASE WHEN len({_READS}) > 0 THEN 'reads files modified by older: ' || array_to_string({_READS}, ', ') END], lambda x: x IS NOT NULL), '; ')")
_HI = f"len(list_filter({_SHC}, lambda c: list_contains({sql_list(vocab.HIGH_VALUE_CONCEPTS)}, c)))"
_TOT = "(len(list_distinct(n.concepts)) + len(list_filter(o.concepts, lambda c: NOT list_contains(n.concepts, c))))"
_BASE = f"(0.3e0 + len({_SHC}) / CAST({_TOT} AS DOUBLE) * 0.5e0)"
C_CONF = f"CASE WHEN len({_SHC}) > 0 THEN least(CASE {_HI} WHEN 0 THEN {_BASE} WHEN 1 THEN {_BASE} + 0.1e0 ELSE {_BASE} + 0.1e0 + 0.1e0 END, 1e0) END"
C_REASON = f"'shared concepts: ' || array_to_string({_SHC}, ', ')"
_STEP = "CASE n.type || '<' || o.type " + " ".join(f"WHEN '{a}<{b}' THEN {{}}" for a, b, _, _ in vocab.TYPE_PROGRESSIONS) + " END"
P_TYPE = _STEP.format(*[f"'{r}'" for _, _, r, _ in vocab.TYPE_PROGRESSIONS])
P_CONF = _STEP.format(*[f"{c}e0" for _, _, _, c in vocab.TYPE_PROGRESSIONS])
P_REASON = "o.type || ' -> ' || n.type || ' progression'"
_GAP = "abs(n.created_at_epoch - o.created_at_epoch)"
T_CONF = f"CASE WHEN n.sdk_session_id = o.sdk_session_id AND {_GAP} <= 300000 THEN 0.3e0 + (1e0 - {_GAP} / 300000e0) * 0.4e0 END"
_PH = "CASE " + " ".join(f"WHEN contains(lower(n.narrative), '{p}') THEN {{}}" for p, _, _ in vocab.NARRATIVE_PHRASES) + " END"
N_TYPE = _PH.format(*[f"'{r}'" for _, r, _ in vocab.NARRATIVE_PHRASES])
N_CONF = _PH.format(*[f"{min(1.0, 0.4 + b)!r}e0" for _, _, b in vocab.NARRATIVE_PHRASES])
N_REASON = _PH.format(*[f"'narrative contains ''{p.strip()}'' language'" for p, _, _ in vocab.NARRATIVE_PHRASES])


def _detector_sql(rtype, conf, source, reason):
    return (PAIRS + f" SELECT * FROM (SELECT n.id AS source_id, o.id AS target_id, {rtype} AS relation_type, round({conf}, 6) AS confidence, "
            f"'{source}' AS detection_source, {reason} AS reason FROM pairs) WHERE confidence IS NOT NULL")


def _detector(name, sql):
    @query(name, sql)
    def run(spark, d):
        return rl.run_detector(_relation_pairs(spark, d), name).withColumn("confidence", F.round("confidence", 6))


_detector("rel_file_overlap", _detector_sql(F_TYPE, F_CONF, "file_overlap", F_REASON))
_detector("rel_concept_overlap", _detector_sql("'relates_to'", C_CONF, "concept_overlap", C_REASON))
_detector("rel_type_progression", _detector_sql(P_TYPE, P_CONF, "type_progression", P_REASON))
_detector("rel_narrative", PAIRS.replace("SELECT n AS n, o AS o", "SELECT n AS n, o AS o") + f""", m AS (SELECT id, {N_TYPE} AS t, {N_CONF} AS c, {N_REASON} AS r FROM obs_v n)
  SELECT p.n.id AS source_id, p.o.id AS target_id, m.t AS relation_type, round(m.c, 6) AS confidence, 'narrative_mention' AS detection_source, m.r AS reason
  FROM pairs p JOIN m ON m.id = p.n.id WHERE m.c IS NOT NULL""")


@query("rel_temporal", with_views("obs") + f""", slim AS MATERIALIZED (SELECT id, sdk_session_id, created_at_epoch FROM obs_v)
  SELECT n.id AS source_id, o.id AS target_id, round({T_CONF}, 6) AS confidence FROM slim n JOIN slim o
  ON n.sdk_session_id = o.sdk_session_id AND {_GAP} <= 300000 AND (o.created_at_epoch < n.created_at_epoch OR (o.created_at_epoch = n.created_at_epoch AND o.id < n.id))""")
def rel_temporal(spark, d):
    return rl.run_detector(rl.temporal_pairs(v.obs(spark, d)), "rel_temporal").select(
        "source_id", "target_id", F.round("confidence", 6).alias("confidence"))


DETECT = PAIRS + f""", m AS (SELECT id, {N_TYPE} AS t, {N_CONF} AS c, {N_REASON} AS r FROM obs_v n),
 e AS (SELECT n.id AS source_id, o.id AS target_id,
   {F_CONF} AS fc, {F_TYPE} AS ft, {F_REASON} AS fr, {C_CONF} AS cc, {C_REASON} AS cr, {P_CONF} AS pc, {P_TYPE} AS pt, {P_REASON} AS prr, {T_CONF} AS tc, m.c AS nc, m.t AS nt, m.r AS nr
   FROM pairs JOIN m ON m.id = n.id WHERE NOT o.is_superseded AND (n.project = o.project OR n.scope = 'global' OR o.scope = 'global')),
 g AS (SELECT * REPLACE (CASE WHEN fc >= 0.4e0 THEN fc END AS fc, CASE WHEN cc >= 0.4e0 THEN cc END AS cc, CASE WHEN pc >= 0.4e0 THEN pc END AS pc,
   CASE WHEN tc >= 0.4e0 THEN tc END AS tc, CASE WHEN nc >= 0.4e0 THEN nc END AS nc) FROM e),
 h AS (SELECT *, greatest(coalesce(fc, -1), coalesce(cc, -1), coalesce(pc, -1)) AS m3 FROM g),
 w AS (SELECT *, CASE WHEN m3 < 0 THEN CASE WHEN tc IS NULL THEN CASE WHEN nc IS NULL THEN '' ELSE 'narrative_mention' END WHEN nc > tc THEN 'narrative_mention' ELSE 'temporal_proximity' END
   WHEN nc > m3 THEN 'narrative_mention' WHEN fc = m3 THEN 'file_overlap' WHEN cc = m3 THEN 'concept_overlap' ELSE 'type_progression' END AS detection_source FROM h)
 SELECT source_id, target_id, detection_source,
   CASE detection_source WHEN 'file_overlap' THEN ft WHEN 'type_progression' THEN pt WHEN 'narrative_mention' THEN nt ELSE 'relates_to' END AS relation_type,
   round(CASE detection_source WHEN 'file_overlap' THEN fc WHEN 'concept_overlap' THEN cc WHEN 'type_progression' THEN pc WHEN 'narrative_mention' THEN nc ELSE tc END, 6) AS confidence,
   CASE detection_source WHEN 'file_overlap' THEN fr WHEN 'concept_overlap' THEN cr WHEN 'type_progression' THEN prr WHEN 'narrative_mention' THEN nr ELSE 'same session, close timestamps' END AS reason
 FROM w WHERE detection_source <> ''"""


@query("detect_relations", DETECT)
def detect_relations(spark, d):
    return rl.detect_relations(_relation_pairs(spark, d)).withColumn("confidence", F.round("confidence", 6))


_DET = """, slim AS MATERIALIZED (SELECT id, coalesce(title, '') AS title, type FROM obs_v)
  SELECT r.id, r.source_id, r.target_id, s.title AS source_title, s.type AS source_type, t.title AS target_title, t.type AS target_type
  FROM relations_v r JOIN slim s ON s.id = r.source_id JOIN slim t ON t.id = r.target_id"""
_DCOLS = ["id", "source_id", "target_id", "source_title", "source_type", "target_title", "target_type"]


@query("relations_detailed", with_views("relations", "obs") + _DET)
def relations_detailed(spark, d):
    return rl.relations_detailed(v.relations(spark, d), v.obs(spark, d)).select(*_DCOLS)


_ENDS = """, ends AS (SELECT source_id AS node_id, target_id AS related_id FROM relations_v WHERE confidence >= 0.4e0 UNION SELECT target_id, source_id FROM relations_v WHERE confidence >= 0.4e0)"""


@query("related_ids", with_views("relations", "obs") + _ENDS + "SELECT node_id, related_id FROM ends WHERE node_id IN (SELECT id FROM obs_v WHERE type = 'bugfix')")
def related_ids(spark, d):
    nodes = v.obs(spark, d).filter(F.col("type") == "bugfix").select("id")
    return rl.related_ids(v.relations(spark, d), nodes)


@query("related_observations", with_views("relations", "obs") + _ENDS + """SELECT node_id, id, rank FROM (SELECT node_id, o.id, row_number() OVER (PARTITION BY node_id
  ORDER BY coalesce(importance_score,1e0) DESC, created_at_epoch DESC, o.id DESC) AS rank FROM ends JOIN obs_v o ON o.id = ends.related_id) WHERE rank <= 50""")
def related_observations(spark, d):
    o = v.obs(spark, d)
    return rl.related_observations(o, v.relations(spark, d), o.select("id"))


@query("edge_update", with_views("relations") + """SELECT id, round(CASE WHEN relation_type = 'fixes' THEN confidence / 2 ELSE confidence END, 6) AS confidence FROM relations_v
  WHERE source_id NOT IN (SELECT id FROM relations_v WHERE confidence > 0.85e0) AND target_id NOT IN (SELECT id FROM relations_v WHERE confidence > 0.85e0)""")
def edge_update(spark, d):
    r = v.relations(spark, d)
    changes = r.filter(F.col("relation_type") == "fixes").select("id", (F.col("confidence") / 2).alias("confidence"))
    kept = rl.edges_without(rl.edge_update(r, changes), r.filter(F.col("confidence") > 0.85).select("id"))
    return kept.select("id", F.round("confidence", 6).alias("confidence"))


# conflicts -----------------------------------------------------------------------------------------------------

_CORR = lambda c: "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{p.replace(chr(39), chr(39) * 2)}', 0), '')" for p in vocab.CORRECTION_PATTERNS) + ")"
_TXT = "lower(title || ' ' || narrative)"
_FACTS = f""", f AS MATERIALIZED (SELECT id, coalesce({_CORR('narrative')}, {_CORR('title')}) AS correction,
  [{', '.join(f"contains({_TXT}, '{a}')" for a, _ in vocab.OPPOSING_VERBS)}] AS acts, [{', '.join(f"contains({_TXT}, '{b}')" for _, b in vocab.OPPOSING_VERBS)}] AS undoes FROM obs_v),
 cp AS (SELECT p.n AS n, p.o AS o, fn.correction, fn.acts AS na, fn.undoes AS nu, fo.acts AS oa, fo.undoes AS ou
   FROM pairs p JOIN f fn ON fn.id = p.n.id JOIN f fo ON fo.id = p.o.id)"""
_SHF = "list_filter(o.files_modified, lambda f: list_contains(n.files_modified, f))"
_OPP = "len(list_filter(range(1, 10), lambda i: (na[i] AND ou[i]) OR (nu[i] AND oa[i]))) > 0"
K1 = "correction IS NOT NULL"
K2 = f"(len({_SHF}) > 0 AND {_OPP})"
K3 = f"(len({_SHC}) > 0 AND len({_SHF}) > 0)"
R1 = "'Explicit correction detected: ' || correction"
R2 = f"'Opposing changes on files: ' || array_to_string({_SHF}, ', ')"
R3 = f"'Same concepts (' || array_to_string({_SHC}, ', ') || ') with overlapping file changes'"


def _conf_sql(cond, ctype, reason):
    return PAIRS + _FACTS + f" SELECT n.id AS newer_obs_id, o.id AS older_obs_id, {ctype} AS conflict_type, 'prefer_newer' AS resolution, {reason} AS reason FROM cp WHERE {cond}"


for _n, _s in (("conf_correction", _conf_sql(K1, "'contradicts'", R1)), ("conf_opposing", _conf_sql(K2, "'superseded'", R2)),
               ("conf_concept_file", _conf_sql(K3, "'superseded'", R3))):
    Q[_n] = (lambda which: lambda spark, d: cf.detect(_conflict_pairs(spark, d), which))(_n)
    SQL[_n] = _s

SQL_DETECT_CONFLICTS = _conf_sql(f"{K1} OR {K2} OR {K3}", f"CASE WHEN {K1} THEN 'contradicts' ELSE 'superseded' END",
                                 f"CASE WHEN {K1} THEN {R1} WHEN {K2} THEN {R2} ELSE {R3} END")


@query("detect_conflicts", SQL_DETECT_CONFLICTS)
def detect_conflicts(spark, d):
    return cf.detect_conflicts(_conflict_pairs(spark, d))


@query("conflicts_detailed", with_views("conflicts", "obs") + """, slim AS MATERIALIZED (SELECT id, title, project FROM obs_v)
  SELECT c.id, n.title AS newer_title, o.title AS older_title FROM conflicts_v c
  JOIN slim n ON n.id = c.newer_obs_id JOIN slim o ON o.id = c.older_obs_id WHERE n.project = 'p3' OR o.project = 'p3'""")
def conflicts_detailed(spark, d):
    return cf.conflicts_detailed(v.conflicts(spark, d), v.obs(spark, d), "p3").select("id", "newer_title", "older_title")


@query("superseded_ids", with_views("conflicts", "obs") + """SELECT DISTINCT o.id FROM conflicts_v c JOIN obs_v o ON o.id = c.older_obs_id
  WHERE c.resolution = 'prefer_newer' AND (o.project = 'p3' OR o.scope = 'global')""")
def superseded_ids(spark, d):
    return cf.superseded_ids(v.conflicts(spark, d), v.obs(spark, d), "p3")


@query("mark_superseded", with_views("conflicts", "obs") + """SELECT id, is_superseded OR id IN (SELECT older_obs_id FROM conflicts_v WHERE resolution = 'prefer_newer') AS is_superseded FROM obs_v""")
def mark_superseded(spark, d):
    return cf.mark_superseded(v.obs(spark, d), v.conflicts(spark, d)).select("id", "is_superseded")


@query("resolve_conflict", with_views("conflicts") + f"""SELECT id, CASE WHEN conflict_type = 'contradicts' THEN 'manual' ELSE resolution END AS resolution,
  resolved OR conflict_type = 'contradicts' AS resolved, CASE WHEN conflict_type = 'contradicts' THEN {NOW} END AS resolved_at_epoch FROM conflicts_v""")
def resolve_conflict(spark, d):
    c = v.conflicts(spark, d)
    dec = c.filter(F.col("conflict_type") == "contradicts").select("id", F.lit("manual").alias("resolution"))
    return cf.resolve_conflict(c, dec, NOW).select("id", "resolution", "resolved", "resolved_at_epoch")


_CUT = v.BASE_MS + 20 * 86400000
_DEAD = f", dead AS (SELECT DISTINCT o.id FROM obs_v o JOIN conflicts_v c ON c.older_obs_id = o.id WHERE o.is_superseded AND c.detected_at_epoch < {_CUT - vocab.SUPERSEDED_RETENTION_MS})"
_LEFT = """SELECT 'observations' AS tbl, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM obs_v WHERE id NOT IN (SELECT id FROM dead)
  UNION ALL SELECT 'vectors', count(*), CAST(sum(row_id) AS BIGINT) FROM vectors_v WHERE NOT (doc_type = 'observation' AND row_id IN (SELECT id FROM dead))
  UNION ALL SELECT 'relations', count(*), CAST(sum(id) AS BIGINT) FROM relations_v WHERE source_id NOT IN (SELECT id FROM dead) AND target_id NOT IN (SELECT id FROM dead)
  UNION ALL SELECT 'conflicts', count(*), CAST(sum(id) AS BIGINT) FROM conflicts_v WHERE newer_obs_id NOT IN (SELECT id FROM dead) AND older_obs_id NOT IN (SELECT id FROM dead)"""


def _summary(tables):
    parts = [df.agg(F.count("*").alias("n"), F.sum("row_id" if k == "vectors" else "id").alias("ids")).select(F.lit(k).alias("tbl"), "n", "ids")
             for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("purge_superseded", with_views("obs", "conflicts", "vectors", "relations") + _DEAD + _LEFT)
def purge_superseded(spark, d):
    return _summary(cf.purge_superseded(v.obs(spark, d), v.vectors(spark, d), v.relations(spark, d), v.conflicts(spark, d), _CUT))


@query("cascade_delete", with_views("obs", "conflicts", "vectors", "relations") + ", dead AS (SELECT id FROM obs_v WHERE type = 'change') " + _LEFT)
def cascade_delete(spark, d):
    o = v.obs(spark, d)
    return _summary(cf.cascade_delete(o.filter(F.col("type") == "change").select("id"), o, v.vectors(spark, d), v.relations(spark, d), v.conflicts(spark, d)))


MTIMES_SQL = f", mt AS (SELECT mtime_path AS path, CAST(floor(max(created_at_epoch) / 2.0 + {v.BASE_MS} / 2.0) AS BIGINT) AS mtime FROM obs_v WHERE mtime_path LIKE '%3.go' GROUP BY mtime_path)"


def mtimes(spark, d):
    """Current file times: half-way between the first day and the last change, for some of the files."""
    o = v.obs(spark, d).select(F.get("files_modified", 0).alias("path"), "created_at_epoch").filter(F.endswith("path", F.lit("3.go")))
    return o.groupBy("path").agg(F.floor(F.max("created_at_epoch") / 2.0 + v.BASE_MS / 2.0).cast("long").alias("mtime"))


@query("mtime_staleness", with_views("obs") + MTIMES_SQL + " SELECT o.id, coalesce(mt.mtime > o.created_at_epoch, false) AS is_stale FROM obs_v o LEFT JOIN mt ON mt.path = o.mtime_path")
def mtime_staleness(spark, d):
    return cf.mtime_staleness(v.obs(spark, d), mtimes(spark, d))


@query("semi_anti_forms", with_views("obs", "conflicts") + """SELECT id, 'in' AS form FROM obs_v WHERE id IN (SELECT older_obs_id FROM conflicts_v WHERE NOT resolved)
  UNION ALL SELECT id, 'not in' FROM obs_v WHERE id NOT IN (SELECT older_obs_id FROM conflicts_v WHERE NOT resolved)""")
def semi_anti_forms(spark, d):
    o = v.obs(spark, d).select("id")
    ids = v.conflicts(spark, d).filter(~F.col("resolved")).select(F.col("older_obs_id").alias("id"))
    return fl.lookup_by_ids(v.obs(spark, d).select("id", "created_at_epoch"), ids, "date_desc").select("id", F.lit("in").alias("form")).unionByName(
        cf.without(o, ids, "id").select("id", F.lit("not in").alias("form")))


# patterns -------------------------------------------------------------------------------------------------------

_SIGS = f""", s AS MATERIALIZED (SELECT id, project, created_at_epoch, title, narrative, concepts, sig FROM {SIG_SQL}),
 top AS (SELECT * FROM patterns_v WHERE status = 'active'),
 m0 AS (SELECT s.id, t.id AS pattern_id, t.frequency, t.confidence, len(list_filter(t.signature, lambda w: list_contains(s.sig, w))) AS m, len(s.sig) AS n1, len(t.signature) AS n2 FROM s CROSS JOIN top t),
 m1 AS (SELECT id, pattern_id, frequency, confidence, m / CAST(n1 + n2 - m AS DOUBLE) AS score FROM m0 WHERE m / CAST(n1 + n2 - m AS DOUBLE) >= 0.3e0),
 best AS (SELECT id, pattern_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, frequency DESC, confidence DESC, pattern_id) AS rn FROM m1) WHERE rn = 1)"""


@query("signature_join", with_views("obs", "patterns") + _SIGS + " SELECT id, pattern_id, round(score, 6) AS score FROM m1")
def signature_join(spark, d):
    return pt.signature_join(v.obs(spark, d), v.patterns(spark, d)).withColumn("score", F.round("score", 6))


@query("pattern_match", with_views("obs", "patterns") + _SIGS + " SELECT id, pattern_id, round(score, 6) AS score FROM best")
def pattern_match(spark, d):
    return pt.pattern_match(v.obs(spark, d), v.patterns(spark, d)).withColumn("score", F.round("score", 6))


@query("pattern_mine", with_views("obs", "patterns") + _SIGS + f""", rest AS (SELECT *, array_to_string(sig, '|') || '|' AS k, {PTYPE_SQL} AS ptype FROM s WHERE id NOT IN (SELECT id FROM best)),
 g AS (SELECT k, count(*) AS frequency, first(sig ORDER BY created_at_epoch, id) AS sig, first(title ORDER BY created_at_epoch, id) AS title, first(ptype ORDER BY created_at_epoch, id) AS ptype,
   first(id ORDER BY created_at_epoch, id) AS first_observation_id, array_to_string(list_sort(list(DISTINCT project)), ',') AS projects, max(created_at_epoch) AS last_seen_at_epoch FROM rest GROUP BY k HAVING count(*) >= 2)
 SELECT k AS candidate_key, {PNAME_SQL} AS name, ptype AS type, frequency, projects, first_observation_id, last_seen_at_epoch FROM g""")
def pattern_mine(spark, d):
    o = v.obs(spark, d)
    mined = pt.pattern_mine(o, pt.pattern_match(o, v.patterns(spark, d)))
    return mined.select("candidate_key", "name", "type", "frequency", F.array_join("projects", ",").alias("projects"), "first_observation_id", "last_seen_at_epoch")


@query("pattern_members", with_views("obs", "patterns") + _SIGS + """, rest AS (SELECT id, array_to_string(sig, '|') || '|' AS k FROM s WHERE id NOT IN (SELECT id FROM best))
 SELECT k AS candidate_key, id AS observation_id FROM rest WHERE k IN (SELECT k FROM rest GROUP BY k HAVING count(*) >= 2)""")
def pattern_members(spark, d):
    o = v.obs(spark, d)
    matched = pt.pattern_match(o, v.patterns(spark, d))
    rest = o.join(matched.select("id"), "id", "left_anti")
    return pt.mined_members(rest, pt.pattern_mine(o, matched))


@query("pattern_occurrence", with_views("patterns", "obs") + f""", mt AS (SELECT (id - id % 2) * 7 % (SELECT count(*) FROM patterns_v) AS pattern_id, id - id % 2 AS observation_id, project, created_at_epoch AS seen FROM obs_v),
 fr AS (SELECT pattern_id, observation_id, min(project) AS project, max(seen) AS seen FROM mt GROUP BY 1, 2),
 nw AS (SELECT fr.* FROM fr LEFT JOIN (SELECT id, unnest([id, id + 1]) AS oid FROM patterns_v) k ON k.id = fr.pattern_id AND k.oid = fr.observation_id WHERE k.id IS NULL),
 g AS (SELECT pattern_id, count(*) AS n, list(DISTINCT project) AS pj, max(seen) AS seen FROM nw GROUP BY pattern_id),
 j AS (SELECT p.id, p.frequency + coalesce(g.n, 0) AS frequency, CASE WHEN g.n IS NULL THEN len(p.projects) ELSE len(list_distinct(list_concat(p.projects, g.pj))) END AS n_projects,
   g.n IS NOT NULL AS hit, p.confidence AS c0, greatest(p.last_seen_at_epoch, coalesce(g.seen, 0)) AS last_seen_at_epoch FROM patterns_v p LEFT JOIN g ON g.pattern_id = p.id)
 SELECT id, frequency, n_projects, round(CASE WHEN hit THEN least(1e0, 0.3e0 + 0.4e0 * (least(frequency, 10) / 10e0) + CASE WHEN n_projects >= 5 THEN 0.2e0 WHEN n_projects >= 2 THEN 0.1e0 ELSE 0e0 END) ELSE c0 END, 6) AS confidence,
   last_seen_at_epoch FROM j""")
def pattern_occurrence(spark, d):
    p = v.patterns(spark, d)
    n, seen = p.agg(F.count("*").alias("n")).scalar(), F.col("id") - F.col("id") % 2
    m = v.obs(spark, d).select((seen * 7 % n).alias("pattern_id"), seen.alias("observation_id"), "project",
                               F.col("created_at_epoch").alias("seen_at"))
    return pt.pattern_occurrence(p, m).select(
        "id", "frequency", F.size("projects").alias("n_projects"), F.round("confidence", 6).alias("confidence"), "last_seen_at_epoch")


@query("pattern_merge", with_views("patterns") + """, mg AS (SELECT id AS source_id, id - id % 10 AS target_id FROM patterns_v WHERE id % 10 <> 0),
 ex AS (SELECT target_id AS id, sum(frequency) AS f FROM mg JOIN patterns_v p ON p.id = mg.source_id GROUP BY target_id),
 pj AS (SELECT target_id AS id, unnest(p.projects) AS x FROM mg JOIN patterns_v p ON p.id = mg.source_id UNION SELECT id, unnest(projects) FROM patterns_v),
 oi AS (SELECT target_id AS id, unnest([p.id, p.id + 1]) AS x FROM mg JOIN patterns_v p ON p.id = mg.source_id UNION SELECT id, unnest([id, id + 1]) FROM patterns_v)
 SELECT p.id, CAST(p.frequency + coalesce(ex.f, 0) AS BIGINT) AS frequency, (SELECT count(*) FROM pj WHERE pj.id = p.id) AS n_projects, (SELECT count(*) FROM oi WHERE oi.id = p.id) AS n_ids,
   CASE WHEN p.id % 10 <> 0 THEN 'merged' ELSE p.status END AS status, CASE WHEN p.id % 10 <> 0 THEN p.id - p.id % 10 END AS merged_into_id FROM patterns_v p LEFT JOIN ex ON ex.id = p.id""")
def pattern_merge(spark, d):
    """Every pattern into the one before it, down to the next multiple of ten: chains of up to nine merges."""
    p = v.patterns(spark, d)
    merges = p.filter(F.col("id") % 10 != 0).select(F.col("id").alias("source_id"), (F.col("id") - 1).alias("target_id"))
    n_ids = pt.merge_members(pt.members(p), merges).groupBy(F.col("pattern_id").alias("id")).agg(F.count("*").alias("n_ids"))
    return pt.pattern_merge(p, merges).join(n_ids, "id", "left").select(
        "id", "frequency", F.size("projects").alias("n_projects"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"), "status", "merged_into_id")


@query("pattern_deprecate", with_views("patterns") + "SELECT id, CASE WHEN frequency < 10 THEN 'deprecated' ELSE status END AS status FROM patterns_v")
def pattern_deprecate(spark, d):
    p = v.patterns(spark, d)
    return pt.pattern_deprecate(p, p.filter(F.col("frequency") < 10).select("id")).select("id", "status")


@query("pattern_delete", with_views("patterns") + """SELECT (SELECT count(*) FROM patterns_v WHERE status <> 'merged') AS patterns,
  (SELECT count(*) * 2 + count(recommendation) FROM patterns_v WHERE status <> 'merged') AS vectors""")
def pattern_delete(spark, d):
    from memspark.operators.vector_search import pattern_docs
    p = v.patterns(spark, d)
    out = pt.pattern_delete(p, pattern_docs(p), p.filter(F.col("status") == "merged").select("id"))
    n = out["vectors"].agg(F.count("*").alias("n")).scalar()
    return out["patterns"].agg(F.count("*").alias("patterns")).withColumn("vectors", n)


# graph -----------------------------------------------------------------------------------------------------------

_CENTERS = "(SELECT id FROM obs_v WHERE type = 'bugfix' AND is_superseded)"
_GRAPH = f""", ends AS (SELECT id AS edge_id, source_id, target_id, source_id AS node FROM relations_v UNION SELECT id, source_id, target_id, target_id FROM relations_v),
 n0 AS (SELECT id AS center_id, id AS node FROM {_CENTERS}),
 e1 AS (SELECT DISTINCT center_id, edge_id, source_id, target_id FROM n0 JOIN ends USING (node)),
 n1 AS (SELECT center_id, unnest([source_id, target_id]) AS node FROM e1 UNION SELECT center_id, node FROM n0),
 e2 AS (SELECT DISTINCT center_id, edge_id, source_id, target_id FROM n1 JOIN ends USING (node)),
 n2 AS (SELECT center_id, unnest([source_id, target_id]) AS node FROM e2 UNION SELECT center_id, node FROM n1),
 e3 AS (SELECT DISTINCT center_id, edge_id, source_id, target_id FROM n2 JOIN ends USING (node)),
 g AS (SELECT e3.*, CASE WHEN e1.edge_id IS NOT NULL THEN 1 WHEN e2.edge_id IS NOT NULL THEN 2 ELSE 3 END AS hop FROM e3
   LEFT JOIN e1 USING (center_id, edge_id) LEFT JOIN e2 USING (center_id, edge_id))"""


def _graph(spark, d):
    centers = v.obs(spark, d).filter((F.col("type") == "bugfix") & F.col("is_superseded")).select("id")
    return gr.relation_graph(v.relations(spark, d), centers, 3)


@query("relation_graph", with_views("relations", "obs") + _GRAPH + " SELECT center_id, edge_id, source_id, target_id, hop FROM g")
def relation_graph(spark, d):
    return _graph(spark, d)


@query("graph_nodes", with_views("relations", "obs") + _GRAPH + """, nd AS (SELECT center_id, unnest([source_id, target_id]) AS node_id FROM g UNION SELECT center_id, center_id FROM g)
 SELECT center_id, node_id, CASE WHEN length(title) <= 30 THEN title ELSE substr(title, 1, 27) || '...' END AS label, CASE WHEN node_id = center_id THEN 'center' ELSE type END AS type
 FROM nd JOIN obs_v o ON o.id = nd.node_id""")
def graph_nodes(spark, d):
    return gr.graph_nodes(_graph(spark, d), v.obs(spark, d))
