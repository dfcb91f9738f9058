"""Registered queries: similarity, vectors, keyword search, retrieval plans, models."""

from pyspark.sql import functions as F

from memspark import vocab
from memspark.catalog.pairs_and_patterns import MTIMES_SQL, mtimes
from memspark.catalog.sqlviews import pick, sql_list, with_views
from memspark.catalog.tables_and_filters import _CTX, _TOPK, scratch
from memspark.catalog.text_and_stats import DECL_SQL, INTENT_SQL, KEY_TERMS_SQL, TERMS_SQL, _RESP, sql_tokens
from memspark.functions import markup, text as tx
from memspark.operators import feed, filters as fl, fulltext as ft, models, ordering as od, similarity as sm, stats as st, vector_search as vs
from memspark.plans import retrieval as rt
from memspark.sources import tables as tb, views as v

Q, SQL = {}, {}
NOW = v.NOW_MS


def query(name, sql=None):
    def register(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# similarity ---------------------------------------------------------------------------------------------------

_DOC_TERMS = sql_tokens("text", 3, vocab.SIMILARITY_STOPWORDS)
_SETS = f"""d AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct({_DOC_TERMS})) AS t FROM documents),
 sets AS MATERIALIZED (SELECT min(doc_id) AS sid, t, count(*) AS copies FROM d GROUP BY t),
 post AS MATERIALIZED (SELECT sid, len(t) AS n, unnest(t) AS term FROM sets),
 prs AS MATERIALIZED (SELECT a, b, m / CAST(na + nb - m AS DOUBLE) AS j FROM (SELECT x.sid AS a, y.sid AS b, x.n AS na, y.n AS nb, count(*) AS m FROM post x JOIN post y ON x.term = y.term AND x.sid < y.sid GROUP BY 1, 2, 3, 4)
   WHERE m / CAST(na + nb - m AS DOUBLE) >= 0.4e0)"""


def _doc_terms(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.text_terms(F.col("text")).alias("terms"))


@query("jaccard_join", f"WITH {_SETS} SELECT a, b, round(j, 6) AS jaccard, x.copies AS copies_a, y.copies AS copies_b FROM prs JOIN sets x ON x.sid = a JOIN sets y ON y.sid = b")
def jaccard_join(spark, d):
    return sm.jaccard_join(_doc_terms(spark, d), 0.4, "doc_id").select("a", "b", F.round("jaccard", 6).alias("jaccard"), "copies_a", "copies_b")


_EMPTY = "CAST([] AS STRUCT(id BIGINT, t VARCHAR[])[])"
_SIM = "(CASE WHEN len(a.t) = 0 AND len(x.t) = 0 THEN 1e0 WHEN len(a.t) = 0 OR len(x.t) = 0 THEN 0e0 ELSE len(list_intersect(a.t, x.t)) / CAST(len(a.t) + len(x.t) - len(list_intersect(a.t, x.t)) AS DOUBLE) END)"


def fold(items):
    return f"list_reduce({items}, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: {_SIM} >= 0.4e0)) > 0 THEN acc ELSE list_append(acc, x) END, {_EMPTY})"


# the walk in order, over the pairs found above: a row leads when no earlier leader resembles it
_WALK = f"""WITH {_SETS}, k AS (SELECT b AS sid, list(a) AS before FROM prs GROUP BY b),
 walk AS (SELECT list_reduce((SELECT list({{'id': sid, 'before': coalesce(before, [])}} ORDER BY sid) FROM (SELECT s.sid, k.before FROM sets s LEFT JOIN k ON k.sid = s.sid)),
   lambda acc, x: CASE WHEN len(list_intersect(acc, x.before)) > 0 THEN acc ELSE list_append(acc, x.id) END, CAST([] AS BIGINT[])) AS leaders),
 lead AS (SELECT unnest(leaders) AS doc_id FROM walk) """


@query("cluster_leaders")
def cluster_leaders(spark, d):
    return sm.cluster_leaders(_doc_terms(spark, d), 0.4, "doc_id")


@query("cluster_assign")
def cluster_assign(spark, d):
    return sm.cluster_assign(_doc_terms(spark, d), 0.4, "doc_id")


_LIST = f"list_transform(list({{'id': id, 't': t}} ORDER BY rank), lambda s: s)"
_TOP_TERMS = ", tt AS MATERIALIZED (SELECT id, " + TERMS_SQL + " AS t FROM obs_v)"


@query("cluster_leaders_in_lists", with_views("obs") + _TOP_TERMS + f""", r AS (SELECT project, o.id, tt.t, row_number() OVER (PARTITION BY project
  ORDER BY coalesce(importance_score,1e0) DESC, created_at_epoch DESC, o.id DESC) AS rank FROM obs_v o JOIN tt ON tt.id = o.id),
 l AS (SELECT project, unnest({fold(_LIST)}) AS x FROM r WHERE rank <= 100 GROUP BY project) SELECT project, x.id AS id FROM l""")
def cluster_leaders_in_lists(spark, d):
    return sm.top_leaders(v.obs(spark, d), 100).select("project", "id")


def _labelled(spark, d):
    docs = _doc_terms(spark, d).withColumnRenamed("doc_id", "id")
    lab = v.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return docs.join(lab, "id", "left_anti"), docs.join(lab, "id", "left_semi")


@query("is_similar_to_any", f"""WITH d AS MATERIALIZED (SELECT doc_id, list_distinct({_DOC_TERMS}) AS t FROM documents),
 post AS MATERIALIZED (SELECT doc_id, len(t) AS n, unnest(t) AS term, doc_id IN (SELECT doc_id FROM labels) AS old FROM d),
 m AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS m FROM post x JOIN post y ON x.term = y.term AND NOT x.old AND y.old GROUP BY 1, 2, 3, 4)
 SELECT DISTINCT a AS id FROM m WHERE m / CAST(na + nb - m AS DOUBLE) >= 0.4e0""")
def is_similar_to_any(spark, d):
    new, old = _labelled(spark, d)
    return sm.is_similar_to_any(new, old)


def _extracted(spark, d):
    x = markup.extract_observations(v.responses(spark, d))
    return x.withColumns({"id": F.col("response_id") * 2 + F.col("block_no"),
                          "project": F.concat(F.lit("p"), F.col("response_id") % 8)})


_X_TERMS = f"""(SELECT response_id * 2 + block_no AS id, 'p' || (response_id % 8) AS project, regexp_replace(regexp_extract(block, '<title>([^<]*)</title>', 1), '^\\s+|\\s+$', '', 'g') AS title,
  regexp_replace(regexp_extract(block, '<narrative>([^<]*)</narrative>', 1), '^\\s+|\\s+$', '', 'g') AS narrative,
  list_transform(regexp_extract_all(regexp_extract(block, '(?s)<facts>(.*?)</facts>', 1), '<fact>([^<]+)</fact>', 1), lambda x: trim(x)) AS facts,
  regexp_extract_all(regexp_extract(block, '(?s)<files_read>(.*?)</files_read>', 1), '<file>([^<]+)</file>', 1) AS files_read, CAST([] AS VARCHAR[]) AS files_modified FROM u)"""
_TOP50 = _TOPK[_TOPK.index(", p AS"):].replace("SELECT viewer, id, rank FROM r WHERE rank <= 50", "")


@query("ingest_dedup", with_views("obs") + _TOP50 + ", " + _RESP[len("WITH "):] + f""",
 xt AS MATERIALIZED (SELECT id, project, {TERMS_SQL} AS t FROM {_X_TERMS}),
 best AS (SELECT r.viewer, {TERMS_SQL} AS t FROM r JOIN obs_v o ON o.id = r.id WHERE r.rank <= 50),
 seen AS (SELECT viewer, list(t) AS ts FROM best GROUP BY viewer),
 fresh AS (SELECT xt.* FROM xt LEFT JOIN seen ON seen.viewer = xt.project WHERE len(xt.t) > 0 AND
   len(list_filter(coalesce(seen.ts, []), lambda s: len(list_intersect(s, xt.t)) / CAST(len(s) + len(xt.t) - len(list_intersect(s, xt.t)) AS DOUBLE) >= 0.4e0)) = 0),
 kept AS (SELECT unnest({fold("list({'id': id, 't': t} ORDER BY id)")}) AS x FROM fresh GROUP BY project)
 SELECT x.id AS id FROM kept UNION ALL SELECT id FROM xt WHERE len(t) = 0""")
def ingest_dedup(spark, d):
    return sm.ingest_dedup(_extracted(spark, d), v.obs(spark, d), "project").select("id")


@query("array_sets", with_views("obs") + """SELECT id, array_to_string(list_sort(list_intersect(files_modified, ['src/f' || ((id * 5) % 40) || '.go', 'lib/f3.go'])), ',') AS both_,
  len(list_distinct(list_concat(files_read, files_modified))) AS n_union, len(list_distinct(concepts)) AS n_distinct FROM obs_v""")
def array_sets(spark, d):
    o = v.obs(spark, d)
    other = F.array(F.format_string("src/f%d.go", F.col("id") * 5 % 40), F.lit("lib/f3.go"))
    return o.select("id", F.array_join(F.array_sort(F.array_intersect("files_modified", other)), ",").alias("both_"),
                    F.size(F.array_union("files_read", "files_modified")).alias("n_union"), F.size(F.array_distinct("concepts")).alias("n_distinct"))


# vectors --------------------------------------------------------------------------------------------------------

_KNN = with_views("vectors") + """, q AS (SELECT vec_id AS query_id, 'p' || (label % 8) AS project, embedding FROM embeddings),
 s AS (SELECT q.query_id, q.project AS q_project, v.doc_id, v.row_id, v.doc_type, v.project, v.scope, 0.5e0 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / 2e0 AS similarity
   FROM q CROSS JOIN vectors_v v {where}),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM s),
 hits AS (SELECT * FROM r WHERE rank <= 20) """
_SEEN = "WHERE v.project = q.project OR v.scope = 'global'"


def _knn(spark, d, doc_type=None):
    return vs.knn_join(v.query_vectors(spark, d), v.vectors(spark, d), 20, doc_type)


@query("knn_join", _KNN.replace("{where}", "") + "SELECT query_id, doc_id, row_id, round(similarity, 6) AS similarity, rank FROM hits")
def knn_join(spark, d):
    h = vs.knn_join(v.query_vectors(spark, d), v.vectors(spark, d), 20, by_project=False)
    return h.withColumn("similarity", F.round("similarity", 6))


_VS = _KNN.replace("{where}", "WHERE v.doc_type = 'observation' AND (v.project = q.project OR v.scope = 'global')")


@query("vector_search", _VS + "SELECT query_id, doc_id, row_id, round(similarity, 6) AS similarity, rank FROM hits")
def vector_search(spark, d):
    return _knn(spark, d, "observation").withColumn("similarity", F.round("similarity", 6))


Q["topk_per_query"], SQL["topk_per_query"] = vector_search, SQL["vector_search"]


@query("threshold_filter", _KNN.replace("{where}", _SEEN) + "SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM hits WHERE round(similarity, 9) >= 0.6e0) WHERE k <= 5")
def threshold_filter(spark, d):
    return vs.threshold_filter(_knn(spark, d), 0.6, 5).select("query_id", "doc_id", "rank")


@query("ids_dedup", _KNN.replace("{where}", _SEEN) + """SELECT query_id, doc_type, row_id % 50 AS row_id, min(rank) AS first_rank FROM hits
  WHERE project = q_project OR (doc_type = 'observation' AND scope = 'global') GROUP BY 1, 2, 3""")
def ids_dedup(spark, d):
    hits = _knn(spark, d).withColumn("row_id", F.col("row_id") % 50)
    return vs.ids_dedup(hits, v.vectors(spark, d), v.query_vectors(spark, d).select("query_id", "project"))


_LOGIT = "CAST((query_id * 31 + row_id * 17) % 100 AS DOUBLE) / 10e0 - 5e0"
_ZS = f"1e0 / (1e0 + exp(-({_LOGIT})))"


def _candidates(spark, d):
    logit = ((F.col("query_id") * 31 + F.col("row_id") * 17) % 100).cast("double") / 10.0 - 5.0
    return _knn(spark, d).withColumns({"score": F.col("similarity"), "logit": logit, "original_rank": F.col("rank")})


def _rerank_sql(blend):
    return _KNN.replace("{where}", _SEEN) + f"""SELECT query_id, doc_id, round(z, 6) AS rerank_score, round(c, 6) AS combined_score, rank AS original_rank, k AS rerank_rank, rank - k AS rank_improvement
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, rank) AS k FROM (SELECT *, {_ZS} AS z, {blend} AS c FROM hits)) WHERE k <= 10"""


_RR = ["query_id", "doc_id", "rerank_score", "combined_score", "original_rank", "rerank_rank", "rank_improvement"]


@query("rerank", _rerank_sql(f"0.7e0 * ({_ZS}) + (1e0 - 0.7e0) * similarity"))
def rerank(spark, d):
    return vs.rerank(_candidates(spark, d)).select(*_RR).withColumns({c: F.round(c, 6) for c in _RR[2:4]})


@query("rerank_pure", _rerank_sql(_ZS))
def rerank_pure(spark, d):
    return vs.rerank_pure(_candidates(spark, d)).select(*_RR).withColumns({c: F.round(c, 6) for c in _RR[2:4]})


Q["rerank_rank"] = lambda spark, d: rerank(spark, d).select("query_id", "doc_id", "original_rank", "rerank_rank", "rank_improvement")
SQL["rerank_rank"] = SQL["rerank"].replace("round(z, 6) AS rerank_score, round(c, 6) AS combined_score, ", "")


def _variants_hits(spark, d):
    """Two variants of each query vector: itself at weight 1 and the next row's vector at weight 0.8."""
    e = v.query_vectors(spark, d)
    nxt = e.select((F.col("query_id") - 1).alias("query_id"), "embedding")
    two = e.select(F.concat(F.col("query_id"), F.lit("#0")).alias("variant_id"), "query_id", "project", "embedding", F.lit(1.0).alias("weight")).unionByName(
        e.select("query_id", "project").join(nxt, "query_id").select(F.concat(F.col("query_id"), F.lit("#1")).alias("variant_id"), "query_id", "project", "embedding", F.lit(0.8).alias("weight")))
    hits = vs.knn_join(two.select(F.col("variant_id").alias("query_id"), "project", "embedding"), v.vectors(spark, d), 20)
    return vs.variant_hits(hits, two)


_VAR = with_views("vectors") + """, e AS (SELECT vec_id AS query_id, 'p' || (label % 8) AS project, embedding FROM embeddings),
 q AS (SELECT query_id, project, embedding, 1e0 AS weight, 0 AS no FROM e UNION ALL SELECT a.query_id, a.project, b.embedding, 0.8e0, 1 FROM e a JOIN e b ON b.query_id = a.query_id + 1),
 s AS (SELECT q.query_id, q.no, q.weight, v.doc_id, v.row_id, 0.5e0 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / 2e0 AS similarity
   FROM q JOIN vectors_v v ON v.project = q.project OR v.scope = 'global'),
 hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, no ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 20) """


@query("variants_union", _VAR + "SELECT query_id, doc_id, round(similarity * weight, 6) AS similarity, rank FROM hits")
def variants_union(spark, d):
    return _variants_hits(spark, d).select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("max_similarity", _VAR + "SELECT query_id, row_id, round(max(similarity * weight), 6) AS similarity FROM hits GROUP BY query_id, row_id")
def max_similarity(spark, d):
    return st.max_similarity(_variants_hits(spark, d)).withColumn("similarity", F.round("similarity", 6))


_DOCS = with_views("obs", "summaries", "prompts", "sessions", "patterns") + """, docs AS (
  SELECT 'obs_' || id || '_narrative' AS doc_id, id AS row_id, 'observation' AS doc_type, 'narrative' AS field_type, project, scope, narrative AS content FROM obs_v
  UNION ALL SELECT 'obs_' || id || '_fact_0', id, 'observation', 'fact', project, scope, facts[1] FROM obs_v UNION ALL SELECT 'obs_' || id || '_fact_1', id, 'observation', 'fact', project, scope, facts[2] FROM obs_v
  UNION ALL SELECT 'summary_' || id || '_request', id, 'session_summary', 'request', project, '', request FROM summaries_v WHERE coalesce(request,'') <> ''
  UNION ALL SELECT 'summary_' || id || '_learned', id, 'session_summary', 'learned', project, '', learned FROM summaries_v WHERE coalesce(learned,'') <> ''
  UNION ALL SELECT 'prompt_' || p.id, p.id, 'user_prompt', 'prompt', coalesce(s.project,''), '', prompt_text FROM prompts_v p LEFT JOIN sessions_v s ON s.session_id = p.session_id
  UNION ALL SELECT 'pattern_' || id || '_name', id, 'pattern', 'name', '', 'global', name FROM patterns_v UNION ALL SELECT 'pattern_' || id || '_description', id, 'pattern', 'description', '', 'global', description FROM patterns_v
  UNION ALL SELECT 'pattern_' || id || '_recommendation', id, 'pattern', 'recommendation', '', 'global', recommendation FROM patterns_v WHERE recommendation IS NOT NULL) """


def _all_docs(spark, d):
    p = fl.prompts_with_session(v.prompts(spark, d), v.sessions(spark, d))
    return vs.vector_docs(v.obs(spark, d), v.summaries(spark, d), p, v.patterns(spark, d))


@query("vector_docs", _DOCS + "SELECT doc_id, row_id, doc_type, field_type, project, scope, md5(content) AS digest FROM docs")
def vector_docs(spark, d):
    return _all_docs(spark, d).select("doc_id", "row_id", "doc_type", "field_type", "project", "scope", F.md5("content").alias("digest"))


_HEX = "0123456789abcdef"
# four digest bytes modulo 64 depend on the fourth byte only
_SLOT = f"(((instr('{_HEX}', substr(md5(w), 7, 1)) - 1) * 16 + instr('{_HEX}', substr(md5(w), 8, 1)) - 1) % 64)"


def emb_sql(src, key, text):
    """Sparse hashed-word vectors: (key, slot, x), each of unit length."""
    return f"""(SELECT {key}, slot, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS x FROM (SELECT {key}, {_SLOT} AS slot, CAST(count(*) AS DOUBLE) AS c
      FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS w FROM {src}) GROUP BY 1, 2))"""


@query("embed_docs", _DOCS + f"SELECT doc_id, count(*) AS filled, round(CAST(CAST(max(x) AS FLOAT) AS DOUBLE), 4) AS largest FROM {emb_sql('(SELECT * FROM docs)', 'doc_id', 'content')} GROUP BY doc_id")
def embed_docs(spark, d):
    e = models.embed_docs(_all_docs(spark, d).select("doc_id", "content"))
    filled = F.size(F.filter("embedding", lambda x: x > 0))
    return e.select("doc_id", filled.alias("filled"), F.round(F.array_max("embedding").cast("double"), 4).alias("largest")).filter("filled > 0")


Q["udf_embedder"], SQL["udf_embedder"] = embed_docs, SQL["embed_docs"]


@query("rebuild_vectors", with_views("summaries") + """, docs AS (SELECT 'summary_' || id || '_request' AS doc_id, id AS n FROM summaries_v WHERE coalesce(request,'') <> ''
  UNION ALL SELECT 'summary_' || id || '_learned', id FROM summaries_v WHERE coalesce(learned,'') <> '')
  SELECT doc_id, 'hashed-64' AS model_version, n % 3 = 0 AS kept FROM docs""")
def rebuild_vectors(spark, d):
    docs = vs.summary_docs(v.summaries(spark, d))
    marked = F.array(F.lit(9.0).cast("float"))
    stored = vs.rebuild_vectors(docs, None, full=True).withColumns({
        "model_version": F.when(F.col("row_id") % 3 == 1, "old").otherwise(F.col("model_version")),
        "embedding": F.when(F.col("row_id") % 3 == 0, marked).otherwise(F.col("embedding"))}).filter(F.col("row_id") % 3 != 2)
    new = vs.rebuild_vectors(docs, stored)
    return new.select("doc_id", "model_version", (F.size("embedding") == 1).alias("kept"))


# keyword search and query expansion ----------------------------------------------------------------------------

_KWQ = sql_tokens("query", 4, vocab.FTS_STOPWORDS)


def bm25_sql(body, docs, visible):
    return f""", kw AS MATERIALIZED (SELECT DISTINCT query_id, project, unnest({_KWQ}) AS term FROM query_texts_v),
 tk AS MATERIALIZED (SELECT id, regexp_extract_all(lower({body}), '[a-z0-9_]+') AS toks FROM {docs}),
 cp AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS avg_len FROM tk),
 tf AS MATERIALIZED (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(toks) AS len, unnest(toks) AS term FROM tk) WHERE term IN (SELECT term FROM kw) GROUP BY 1, 2, 3),
 df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
 wt AS (SELECT term, CASE WHEN ln((n - df + 0.5e0) / (df + 0.5e0)) > 0 THEN ln((n - df + 0.5e0) / (df + 0.5e0)) ELSE 1e-6 END AS idf, avg_len FROM df, cp),
 bm AS (SELECT kw.query_id, tf.id, sum(idf * tf * 2.2e0 / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * len / avg_len))) AS score
   FROM kw JOIN wt ON wt.term = kw.term JOIN tf ON tf.term = kw.term JOIN {docs} o ON o.id = tf.id WHERE {visible} GROUP BY 1, 2)"""


_OBS_BODY = "title || chr(10) || subtitle || chr(10) || narrative"
_FTS = with_views("obs", "query_texts") + bm25_sql(_OBS_BODY, "obs_v", "o.project = kw.project OR o.scope = 'global'") + """,
 fts AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, coalesce(importance_score,1e0) DESC, id) AS rank FROM bm JOIN obs_v USING (id) QUALIFY rank <= 10) """


@query("search_fts", _FTS + "SELECT query_id, id, round(score, 5) AS score, rank FROM fts")
def search_fts(spark, d):
    return ft.search_fts(v.obs(spark, d), v.query_texts(spark, d)).withColumn("score", F.round("score", 5))


@query("fts_join", with_views("obs", "query_texts") + bm25_sql(_OBS_BODY, "obs_v", "o.project = kw.project OR o.scope = 'global'") + " SELECT query_id, id, round(score, 4) AS score FROM bm")
def fts_join(spark, d):
    q = ft.query_keywords(v.query_texts(spark, d))
    return ft.bm25_scores(v.obs(spark, d), ft.OBSERVATION_FIELDS, q).withColumn("score", F.round("score", 4))


@query("search_patterns_fts", with_views("patterns", "query_texts") + ", qq AS (SELECT item_id AS query_id, '' AS project, '' AS q FROM benchmark) "
       + bm25_sql("name || chr(10) || description || coalesce(chr(10) || recommendation, '')", "patterns_v", "true").replace(
           _KWQ, sql_tokens("query", 4, vocab.FTS_STOPWORDS)).replace("query_texts_v", "(SELECT p_partkey AS query_id, '' AS project, p_name || ' ' || p_brand AS query FROM part)")
       + " SELECT query_id, id, round(score, 5) AS score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm JOIN patterns_v USING (id) WHERE status = 'active') WHERE rank <= 10")
def search_patterns_fts(spark, d):
    q = v.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.lit("").alias("project"), F.concat_ws(" ", "p_name", "p_brand").alias("query"))
    return ft.search_patterns_fts(v.patterns(spark, d), q).withColumn("score", F.round("score", 5))


@query("search_like", with_views("obs", "query_texts") + f""", kw AS MATERIALIZED (SELECT DISTINCT query_id, project, unnest({_KWQ}) AS term FROM query_texts_v),
 bd AS MATERIALIZED (SELECT id, project, scope, lower({_OBS_BODY}) AS body FROM obs_v), tm AS MATERIALIZED (SELECT DISTINCT term FROM kw),
 hit AS MATERIALIZED (SELECT bd.id, bd.project, bd.scope, tm.term FROM bd CROSS JOIN tm WHERE contains(bd.body, tm.term)),
 fd AS (SELECT DISTINCT kw.query_id, hit.id FROM hit JOIN kw ON kw.term = hit.term WHERE hit.project = kw.project OR hit.scope = 'global')
 SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(importance_score,1e0) DESC, created_at_epoch DESC, id DESC) AS rank FROM fd JOIN obs_v USING (id)) WHERE rank <= 10""")
def search_like(spark, d):
    return ft.search_like(v.obs(spark, d), v.query_texts(spark, d))


_EXP = f"""SELECT query_id, 0 AS variant_no, trim(query) AS query, 1e0 AS weight, 'original' AS source, intent FROM (SELECT *, {INTENT_SQL} AS intent FROM query_texts_v)
 UNION ALL SELECT query_id, 1, e, w, s, intent FROM (SELECT query_id, intent, query, CASE intent WHEN 'question' THEN {DECL_SQL} WHEN 'error' THEN k || ' solution fix' WHEN 'implementation' THEN 'how ' || k WHEN 'architecture' THEN k || ' design structure' END AS e,
   CASE intent WHEN 'question' THEN 0.85e0 WHEN 'error' THEN 0.8e0 ELSE 0.75e0 END AS w, CASE intent WHEN 'question' THEN 'intent:declarative' WHEN 'error' THEN 'intent:solution' WHEN 'implementation' THEN 'intent:how' ELSE 'intent:design' END AS s
   FROM (SELECT *, {INTENT_SQL} AS intent, array_to_string({KEY_TERMS_SQL}, ' ') AS k FROM query_texts_v)) WHERE e IS NOT NULL AND lower(e) <> lower(trim(query))"""


@query("expand_query", with_views("query_texts") + _EXP)
def expand_query(spark, d):
    return vs.expand_query(v.query_texts(spark, d)).select("query_id", "variant_no", "query", "weight", "source", "intent")


@query("expand_vocab", with_views("query_texts") + f""", vocab AS (SELECT source AS term, count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS weight FROM documents GROUP BY source UNION ALL
   SELECT p_name, count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE) FROM part GROUP BY p_name),
 ve AS {emb_sql('vocab', 'term', 'term')}, qe AS {emb_sql('query_texts_v', 'query_id', 'query')},
 c AS (SELECT query_id, term, round(0.5e0 + sum(qe.x * ve.x) / 2, 9) AS s FROM qe JOIN ve USING (slot) GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, term) AS k FROM c)
 SELECT t.query_id, 'vocabulary:' || t.term AS source, round(0.7e0 * (s * 2 - 1) * v.weight, 5) AS weight FROM t JOIN vocab v ON v.term = t.term JOIN query_texts_v q ON q.query_id = t.query_id
 WHERE k <= 2 AND s * 2 - 1 >= 0.3e0 AND NOT contains(lower(q.query), lower(t.term))""")
def expand_vocab(spark, d):
    docs, part = v.table(spark, d, "documents"), v.table(spark, d, "part")
    n_docs, n_part = docs.agg(F.count("*")).scalar(), part.agg(F.count("*")).scalar()
    words = docs.groupBy(F.col("source").alias("term")).agg((F.count("*") / n_docs.cast("double")).alias("weight")).unionByName(
        part.groupBy(F.col("p_name").alias("term")).agg((F.count("*") / n_part.cast("double")).alias("weight")))
    return vs.expand_vocab(v.query_texts(spark, d), words, min_similarity=0.3).select("query_id", "source", F.round("weight", 5).alias("weight"))


# retrieval plans ----------------------------------------------------------------------------------------------

_INJ = with_views("obs") + _TOP50 + _TOP_TERMS + MTIMES_SQL + f""", top AS (SELECT r.viewer, r.id, r.rank, tt.t, coalesce(mt.mtime > o.created_at_epoch, false) AS stale FROM r JOIN obs_v o ON o.id = r.id JOIN tt ON tt.id = r.id
   LEFT JOIN mt ON mt.path = o.mtime_path WHERE r.rank <= 100),
 kept AS (SELECT viewer, unnest({fold(_LIST)}) AS x FROM top WHERE NOT stale GROUP BY viewer),
 k2 AS (SELECT k.viewer, k.x.id AS id, top.rank AS top_rank, row_number() OVER (PARTITION BY k.viewer ORDER BY top.rank) AS rank, count(*) OVER (PARTITION BY k.viewer) AS n FROM kept k JOIN top ON top.viewer = k.viewer AND top.id = k.x.id),
 cnt AS (SELECT viewer, count(*) AS t, count(*) FILTER (WHERE NOT stale) AS f FROM top GROUP BY viewer) """


@query("context_inject", _INJ + "SELECT k2.viewer, id, rank, top_rank, t - f AS stale_excluded, f - n AS duplicates_removed FROM k2 JOIN cnt ON cnt.viewer = k2.viewer")
def context_inject(spark, d):
    return rt.context_inject(v.obs(spark, d), mtimes(spark, d))


@query("context_documents", _INJ + f""", e AS (SELECT k2.viewer, k2.rank, CASE WHEN k2.rank <= 25 THEN {_CTX} ELSE '- [' || upper(type) || '] ' || title || ': ' || subtitle || chr(10) END AS x
   FROM k2 JOIN obs_v o ON o.id = k2.id)
 SELECT viewer, count(*) AS observations, md5('<memory-context>' || chr(10) || '# Project Memory (' || count(*) || ' observations)' || chr(10) ||
   'Use this knowledge to answer questions without re-exploring the codebase.' || chr(10) || chr(10) || string_agg(x, '' ORDER BY rank) || '</memory-context>' || chr(10)) AS digest FROM e GROUP BY viewer""")
def context_documents(spark, d):
    o = v.obs(spark, d)
    docs = rt.context_documents(o, rt.context_inject(o, mtimes(spark, d)))
    return docs.select("viewer", "observations", F.md5("document").alias("digest"))


def _loaded(vectors):
    """The vectors as a stored table, of which a reader that wants few columns reads these only."""
    root = scratch(vectors.sparkSession)
    vectors.write.parquet(root)
    return vectors.sparkSession.read.schema(vectors.schema).parquet(root)


def _obs_vectors(spark, d):
    """The vector table of all observations, built and stored as a load would do it."""
    return _loaded(vs.rebuild_vectors(vs.observation_docs(v.obs(spark, d)), None, full=True))


def _search(spark, d, **kw):
    return rt.two_stage_search(v.obs(spark, d), _obs_vectors(spark, d), v.query_texts(spark, d), mtimes(spark, d), **kw)


@query("two_stage_search")
def two_stage_search(spark, d):
    return _search(spark, d)


@query("two_stage_search_compat")
def two_stage_search_compat(spark, d):
    return _search(spark, d, compat=True, scorer=None)


@query("prompt_context_doc")
def prompt_context_doc(spark, d):
    o = v.obs(spark, d)
    rows = two_stage_search(spark, d).select("query_id", "id", "rank").join(o.select("id", "title", "type", "narrative", "facts"), "id")
    return feed.prompt_context_doc(rows)


def _three_tables(spark, d):
    return v.obs(spark, d), v.summaries(spark, d), fl.prompts_with_session(v.prompts(spark, d), v.sessions(spark, d))


def _mixed_vectors(spark, d):
    o, s, p = _three_tables(spark, d)
    return _loaded(vs.rebuild_vectors(vs.vector_docs(o, s, p), None, full=True)), o, s, p


_UNI = (_DOCS + f", de AS MATERIALIZED {emb_sql('(SELECT * FROM docs WHERE doc_type <> ' + chr(39) + 'pattern' + chr(39) + ')', 'doc_id', 'content')}")


def _uni_sql(boost="", only=""):
    where = f" AND dd.doc_type = '{only}'" if only else ""
    base = _UNI.replace("WITH obs_v", "WITH query_texts_v AS (SELECT item_id AS query_id, 'p' || (item_id % 8) AS project, "
                        + pick(['how does ', 'fix the error in ', 'implement ', 'design of ', ''], 'item_id % 5') + f" || text || '{boost}' AS query FROM benchmark), obs_v", 1)
    return base + f""", qe AS MATERIALIZED {emb_sql('query_texts_v', 'query_id', 'query')},
 c AS (SELECT q.query_id, dd.doc_id, dd.row_id, dd.doc_type, round(0.5e0 + coalesce(dp.s, 0) / 2, 9) AS s FROM query_texts_v q JOIN docs dd ON dd.doc_type <> 'pattern' AND (dd.project = q.project OR dd.scope = 'global'){where}
   LEFT JOIN (SELECT query_id, doc_id, sum(qe.x * de.x) AS s FROM qe JOIN de USING (slot) GROUP BY 1, 2) dp ON dp.query_id = q.query_id AND dp.doc_id = dd.doc_id),
 h AS (SELECT DISTINCT query_id, row_id, doc_type FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS k FROM c) WHERE k <= 40),
 u AS (SELECT query_id, 0 AS kind, 'observation' AS result_type, id, title, created_at_epoch, project FROM h JOIN obs_v ON id = row_id AND doc_type = 'observation'
   UNION ALL SELECT query_id, 1, 'session', id, request, created_at_epoch, project FROM h JOIN summaries_v ON id = row_id AND doc_type = 'session_summary'
   UNION ALL SELECT query_id, 2, 'prompt', p.id, prompt_text, p.created_at_epoch, coalesce(s.project,'') FROM h JOIN prompts_v p ON p.id = row_id AND doc_type = 'user_prompt' LEFT JOIN sessions_v s ON s.session_id = p.session_id)
 SELECT query_id, result_type, id, CASE WHEN kind > 0 AND length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS title, project, rank FROM (SELECT *, CASE WHEN kind = 0 THEN title ELSE regexp_replace(title, '^\\s+|\\s+$', '', 'g') END AS t,
   row_number() OVER (PARTITION BY query_id ORDER BY kind, created_at_epoch DESC, id DESC) AS rank FROM u) WHERE rank <= 20"""


_UCOLS = ["query_id", "result_type", "id", "title", "project", "rank"]


@query("unified_search")
def unified_search(spark, d):
    vec, o, s, p = _mixed_vectors(spark, d)
    return rt.unified_search(v.query_texts(spark, d), vec, o, s, p).select(*_UCOLS)


Q["results_union"] = unified_search


def _shortcut(name):
    @query(name)
    def run(spark, d):
        o, s, p = _three_tables(spark, d)
        return rt.shortcut_search(name, v.query_texts(spark, d), _obs_vectors(spark, d), o, s, p).select(*_UCOLS)
    return run


for _name in vocab.BOOST_WORDS:
    _shortcut(_name)


@query("filter_search", with_views("obs", "summaries") + """SELECT 'observation' AS result_type, id, title FROM (SELECT id, title FROM obs_v WHERE ((project = 'p3' AND scope = 'project') OR scope = 'global') AND NOT is_superseded AND type = 'bugfix'
   ORDER BY coalesce(importance_score,1e0) DESC, created_at_epoch DESC, id DESC LIMIT 30)""")
def filter_search(spark, d):
    return rt.filter_search(v.obs(spark, d), v.summaries(spark, d), "p3", limit=30, exclude_superseded=True, obs_types=["bugfix"]).select("result_type", "id", "title")


@query("filter_search_sessions", with_views("summaries") + """SELECT id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS title FROM
  (SELECT id, regexp_replace(request, '^\\s+|\\s+$', '', 'g') AS t, created_at_epoch FROM summaries_v WHERE project = 'p3') ORDER BY created_at_epoch DESC, id DESC LIMIT 20""")
def filter_search_sessions(spark, d):
    return rt.filter_search(v.obs(spark, d), v.summaries(spark, d), "p3", "sessions").select("id", "title")


@query("hybrid_list")
def hybrid_list(spark, d):
    q = v.query_texts(spark, d)
    q = q.unionByName(q.select((-F.col("query_id") - 1).alias("query_id"), F.when(F.col("query_id") % 2 == 0, "").otherwise(F.col("project")).alias("project"), F.lit("").alias("query")))
    return rt.hybrid_list(v.obs(spark, d), q, _obs_vectors(spark, d), vocab.DOC_OBSERVATION)


# models -------------------------------------------------------------------------------------------------------

@query("udf_cross_encoder", with_views("query_texts") + """SELECT q.query_id, round(4e0 * len(list_intersect(list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9_]+')), list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9_]+'))))
   / len(list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9_]+'))) - 2e0, 6) AS logit FROM query_texts_v q JOIN documents d ON d.doc_id = q.query_id""")
def udf_cross_encoder(spark, d):
    q = v.query_texts(spark, d).join(v.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text"), "query_id")
    return q.select("query_id", F.round(models.cross_encoder_column(models.shared_words_logit, F.col("query"), F.col("text")), 6).alias("logit"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"


@query("cross_encoder_documents", with_views("query_texts") + f""", q AS MATERIALIZED (SELECT query_id, query, row_number() OVER (ORDER BY query_id) - 1 AS no, count(*) OVER () AS n FROM query_texts_v),
 p AS (SELECT d.doc_id, q.query_id, {_WORDS.format('q.query')} AS a, {_WORDS.format('d.text')} AS b FROM documents d JOIN q ON q.no = d.doc_id % q.n)
 SELECT doc_id, query_id, round(CASE WHEN len(a) = 0 THEN -2e0 ELSE 4e0 * len(list_intersect(a, b)) / len(a) - 2e0 END, 6) AS logit FROM p""")
def cross_encoder_documents(spark, d):
    """Every document scored against a query; the queries take turns over the documents."""
    q = od.with_positions(v.query_texts(spark, d).select("query_id", "query"), F.col("query_id"))
    n = q.agg(F.count("*").alias("n")).scalar()
    pairs = v.table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("_pos")).join(q, "_pos")
    return pairs.select("doc_id", "query_id", F.round(models.cross_encoder_column(models.shared_words_logit, F.col("query"), F.col("text")), 6).alias("logit"))


@query("udf_extractor", "SELECT doc_id, 'discovery' AS type, md5(regexp_replace(replace(text, '<', ' '), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def udf_extractor(spark, d):
    def wrap(texts):
        return "<observation><type>discovery</type><narrative>" + texts.str.replace("<", " ", regex=False) + "</narrative></observation>"

    r = models.run_extractor(v.table(spark, d, "documents").select("doc_id", "text"), wrap)
    return markup.extract_observations(r, "response").select("doc_id", "type", F.md5("narrative").alias("digest"))


@query("udf_verifier", with_views("obs") + MTIMES_SQL + """ SELECT id, CASE WHEN id % 3 = 0 THEN 'INVALID' WHEN id % 3 = 1 THEN 'valid' ELSE 'UNCERTAIN' END AS verdict, id % 3 <> 0 AS keep
  FROM obs_v JOIN mt ON mt.path = mtime_path WHERE mt.mtime > created_at_epoch""")
def udf_verifier(spark, d):
    from memspark.operators.conflicts import mtime_staleness
    o = v.obs(spark, d)
    stale = o.join(mtime_staleness(o, mtimes(spark, d)).filter("is_stale").select("id"), "id", "left_semi")

    def verdict(pdf):
        return pdf["id"].mod(3).map({0: "INVALID", 1: "valid", 2: "UNCERTAIN"})

    return models.run_verifier(stale.select("id", "title"), verdict)


_WORK = " edited main.go and fixed the function "


@query("ingest_summaries", with_views("summaries") + f""", w AS (SELECT id, project, learned || '{_WORK}' AS text FROM summaries_v WHERE learned IS NOT NULL)
 SELECT row_number() OVER (ORDER BY w.id) + (SELECT max(id) FROM summaries_v) AS id, w.id AS source_id, w.project, md5(regexp_replace(replace(text, '<', ' '), '^\\s+|\\s+$', '', 'g')) AS learned
 FROM w WHERE strlen(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 200""")
def ingest_summaries(spark, d):
    """Last assistant message per session -> worthy ones -> extractor -> summary -> not self-referential -> append."""
    old = v.summaries(spark, d)
    msgs = old.filter(F.col("learned").isNotNull()).select(F.col("id").alias("source_id"), "project", "sdk_session_id",
                                                           F.concat("learned", F.lit(_WORK)).alias("text"))

    def wrap(texts):
        return "<summary><request>r</request><learned>" + texts.str.replace("<", " ", regex=False) + "</learned></summary>"

    parsed = markup.extract_summary(models.run_extractor(fl.summary_worthy(msgs), wrap), "response")
    rows = tb.prepare_summaries(fl.summary_self_ref(parsed), NOW)
    return tb.with_new_ids(rows, old, ["source_id"]).select("id", "source_id", "project", F.md5("learned").alias("learned"))


def extra_sql():
    """Oracles of the plans whose SQL is long."""
    SQL["unified_search"] = SQL["results_union"] = _uni_sql()
    for name, words in vocab.BOOST_WORDS.items():
        SQL[name] = _uni_sql(words, "observation")
    SQL["cluster_leaders"] = _WALK + "SELECT s2.doc_id FROM lead s2"
    SQL["cluster_assign"] = _WALK + """, cov AS (SELECT b AS sid, min(a) AS leader FROM prs WHERE a IN (SELECT doc_id FROM lead) GROUP BY b),
 st AS (SELECT sets.t, CASE WHEN sid IN (SELECT doc_id FROM lead) THEN sid ELSE cov.leader END AS leader_id FROM sets LEFT JOIN cov USING (sid))
 SELECT d.doc_id, st.leader_id FROM d JOIN st ON st.t = d.t"""


extra_sql()
