"""End-to-end retrieval plans, each one DataFrame plan for many queries or projects at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark import vocab
from memspark.operators import feed, filters, fulltext, models, similarity, vector_search as vs
from memspark.operators.conflicts import drop_stale
from memspark.operators.ordering import SMALL_IDS, order_columns, top_per_group, visible_top
from memspark.session import broadcast_if_small, durable, stored, tidy


def context_inject(obs: DataFrame, mtimes: DataFrame | None = None, limit: int = vocab.CONTEXT_LIMIT,
                   threshold: float = vocab.CLUSTER_THRESHOLD, projects: DataFrame | None = None) -> DataFrame:
    """Ranked observations to inject per project (viewer): best visible rows, minus stale ones, minus near-duplicates.

    Output: (viewer, id, rank, top_rank, stale_excluded, duplicates_removed).
    """
    top = similarity.with_terms(visible_top(obs, limit, projects=projects, rank="top_rank"))
    top = stored(top.select("viewer", "id", "top_rank", "terms", "file_mtimes"), "zstd")
    tidy(obs.sparkSession)
    fresh = top if mtimes is None else drop_stale(top, mtimes)
    lead = similarity.cluster_leaders_in_lists(fresh, ["viewer"], "top_rank", threshold)
    counts = (top.groupBy("viewer").agg(F.count("*").alias("_top"))
              .join(fresh.groupBy("viewer").agg(F.count("*").alias("_fresh")), "viewer", "left"))
    ranked = lead.withColumn("rank", F.row_number().over(W.partitionBy("viewer").orderBy("top_rank"))).withColumn(
        "_kept", F.count("*").over(W.partitionBy("viewer")))
    return ranked.join(counts, "viewer").select(
        "viewer", "id", "rank", "top_rank", (F.col("_top") - F.col("_fresh")).alias("stale_excluded"),
        (F.col("_fresh") - F.col("_kept")).alias("duplicates_removed"))


def context_documents(obs: DataFrame, injected: DataFrame, full_count: int = vocab.CONTEXT_FULL) -> DataFrame:
    # the listed ids go to the texts, which are not shuffled
    listed = broadcast_if_small(stored(injected.select("viewer", "id", "rank")), SMALL_IDS)
    tidy(obs.sparkSession)
    rows = listed.join(obs.select("id", "title", "subtitle", "type", "narrative", "facts"), "id")
    return feed.context_doc(rows, "viewer", full_count)


def two_stage_search(obs: DataFrame, vectors: DataFrame, queries: DataFrame, mtimes: DataFrame | None = None,
                     embedder: models.Embedder | None = None, scorer: Callable | None = models.shared_words_logit,
                     limit: int = 50, threshold: float = vocab.RELEVANCE_THRESHOLD, rerank_limit: int = 10,
                     max_results: int = 10, pure: bool = False, compat: bool = False) -> DataFrame:
    """Prompt search for (query_id, project, query): (query_id, id, rank, similarity, via).

    Query variants -> nearest vectors -> weights -> relevance threshold -> best score per row -> keyword search for
    queries without hits -> stale rows out -> cross-encoder -> near-duplicates out -> cut. The project filter comes
    before the top k and rows are kept by similarity; ``compat`` filters after the top k and keeps the newest rows.
    """
    variants = vs.expand_query(queries)
    as_queries = variants.select(F.col("variant_id").alias("query_id"), "project", "query")
    hits = vs.vector_search(as_queries, vectors, limit * 2, vocab.DOC_OBSERVATION, embedder, by_project=not compat)
    weighted = vs.variant_hits(hits, variants).filter(F.col("similarity") >= threshold * 0.9)
    best = weighted.groupBy("query_id", F.col("row_id").alias("id")).agg(F.max("similarity").alias("similarity"))
    keys = obs.select("id", "project", "scope", "created_at_epoch")
    # at most 2 * limit rows per variant: their ids go to the observations, which are not shuffled
    best = broadcast_if_small(durable(best), SMALL_IDS).join(keys, "id")
    if compat:
        q = queries.select("query_id", F.col("project").alias("_want"))
        best = best.join(q, "query_id").filter((F.col("project") == F.col("_want")) | (F.col("scope") == "global"))
        order = order_columns("date_desc")
    else:
        order = [F.round("similarity", 9).desc(), F.col("created_at_epoch").desc(), F.col("id").desc()]
    by_vector = top_per_group(best, "query_id", order, limit, "first_rank").select("query_id", "id", "first_rank", "similarity")
    by_vector = durable(by_vector)
    missed = queries.join(by_vector.select("query_id").distinct(), "query_id", "left_anti")
    cand = by_vector.withColumn("via", F.lit("vector"))
    if not missed.isEmpty():
        by_text = fulltext.search_text_with_fallback(obs, missed, limit).select(
            "query_id", "id", F.col("rank").alias("first_rank"), F.lit(None).cast("double").alias("similarity"))
        cand = cand.unionByName(by_text.withColumn("via", F.lit("text")))
    fields = ["title", "subtitle", "narrative", "facts", "files_read", "files_modified", "file_mtimes"]
    cand = broadcast_if_small(durable(cand), SMALL_IDS).join(obs.select("id", *fields), "id")
    if mtimes is not None:
        cand = drop_stale(cand, mtimes)
    rank = F.col("first_rank")
    if scorer is not None:
        content = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.nullif("narrative", F.lit("")))
        scored = cand.filter(F.col("via") == "vector").join(queries.select("query_id", "query"), "query_id").withColumn(
            "logit", models.cross_encoder_column(scorer, F.col("query"), content)).withColumnRenamed(
            "similarity", "score").withColumn("original_rank", rank).withColumn("doc_id", F.col("id"))
        ranked = (vs.rerank_pure if pure else vs.rerank)(scored, limit=rerank_limit)
        ranked = ranked.select("query_id", "id", F.col("rerank_rank").alias("first_rank"),
                               F.col("combined_score").alias("similarity"), "via", *fields)
        cand = ranked.unionByName(cand.filter(F.col("via") == "text").select(*ranked.columns))
    with_terms = durable(similarity.with_terms(cand).select("query_id", "id", "first_rank", "similarity", "via", "terms"))
    lead = similarity.cluster_leaders_in_lists(with_terms, ["query_id"], "first_rank")
    out = lead.join(with_terms.select("query_id", "id", "similarity", "via"), ["query_id", "id"])
    # without a reranker the product sorts by similarity here, which is the first-stage order unless compat is on
    final = [F.col("first_rank")] if scorer is not None or not compat else [
        F.round("similarity", 9).desc_nulls_last(), F.col("first_rank")]
    return top_per_group(out, "query_id", final, max_results, "rank").drop("first_rank")


def retrieval_log_rows(results: DataFrame, queries: DataFrame, ts) -> DataFrame:
    """One log row per query: what was served."""
    served = results.groupBy("query_id").agg(F.count("*").alias("served"))
    return queries.select("query_id", "project").join(served, "query_id", "left").select(
        F.col("query_id").alias("request_id"), "project", F.lit("search").alias("kind"),
        F.coalesce("served", F.lit(0)).alias("served"), F.lit(0).alias("verified"), F.lit(0).alias("deleted"), ts.alias("ts"))


def filter_search(obs: DataFrame, summaries: DataFrame, project: str, kind: str = "", limit: int = 20,
                  exclude_superseded: bool = False, full: bool = False, **obs_filters) -> DataFrame:
    """Structured search without a query text: observations first, then summaries, cut at the limit."""
    limit = 20 if limit <= 0 else min(limit, 100)
    parts = []
    if kind in ("", "observations"):
        rows = obs.filter(filters.search_predicate(**obs_filters))
        rows = (filters.obs_active if exclude_superseded else filters.obs_visible)(rows, project, limit)
        parts.append(feed.observation_results(rows.withColumn("score", F.coalesce("importance_score", F.lit(1.0))), full))
    if kind in ("", "sessions"):
        rows = filters.summaries_recent(summaries, project, limit).withColumn("score", F.lit(0.0))
        parts.append(feed.summary_results(rows, full))
    out = feed.results_union(*parts)
    return out.orderBy("kind_no", F.col("score").desc(), F.col("created_at_epoch").desc(), F.col("id").desc()).limit(limit)


def unified_search(queries: DataFrame, vectors: DataFrame, obs: DataFrame, summaries: DataFrame, prompts: DataFrame,
                   embedder: models.Embedder | None = None, kind: str = "", limit: int = 20, order_by: str = "date_desc",
                   exclude_superseded: bool = False, full: bool = False) -> DataFrame:
    """Semantic search over observations, sessions and prompts for (query_id, project, query).

    Result rows come in the order observation, session, prompt, each by ``order_by``, cut at the limit per query.
    """
    limit = 20 if limit <= 0 else min(limit, 100)
    doc_type = {"observations": vocab.DOC_OBSERVATION, "sessions": vocab.DOC_SUMMARY, "prompts": vocab.DOC_PROMPT}.get(kind)
    hits = vs.vector_search(queries, vectors, limit * 2, doc_type, embedder)
    ids = durable(vs.ids_dedup(hits, vectors))
    parts = []
    for t, name, rows, render in (
            (vocab.DOC_OBSERVATION, "observations", obs, feed.observation_results),
            (vocab.DOC_SUMMARY, "sessions", summaries, feed.summary_results),
            (vocab.DOC_PROMPT, "prompts", prompts, feed.prompt_results)):
        if kind not in ("", name):
            continue
        wanted = ids.filter(F.col("doc_type") == t).select("query_id", F.col("row_id").alias("id"), (-F.col("first_rank")).alias("score"))
        wanted = broadcast_if_small(wanted, SMALL_IDS)  # so that the rows are not shuffled to meet a few ids
        found = rows.join(wanted, "id")
        if t == vocab.DOC_OBSERVATION and exclude_superseded:
            found = found.filter(filters.not_superseded())
        if "importance_score" not in found.columns:
            found = found.withColumn("importance_score", F.lit(1.0))
        order = W.partitionBy("query_id").orderBy(*order_columns(order_by))
        slot = durable(found.select("query_id", "id", F.row_number().over(order).alias("_n")).filter(F.col("_n") <= limit))
        parts.append(render(found, full).join(broadcast_if_small(slot, SMALL_IDS), ["query_id", "id"]))
    out = feed.results_union(*parts)
    return top_per_group(out, "query_id", [F.col("kind_no"), F.col("_n")], limit, "rank").drop("_n", "score")


def boosted(queries: DataFrame, shortcut: str) -> DataFrame:
    """Queries with the words a shortcut (decisions, changes, how_it_works) adds to a non-empty text."""
    words = vocab.BOOST_WORDS[shortcut]
    return queries.withColumn("query", F.when(F.col("query") != "", F.concat("query", F.lit(words))).otherwise(F.col("query")))


def shortcut_search(shortcut: str, queries: DataFrame, vectors: DataFrame, obs: DataFrame, summaries: DataFrame,
                    prompts: DataFrame, **kw) -> DataFrame:
    return unified_search(boosted(queries, shortcut), vectors, obs, summaries, prompts, kind="observations", **kw)


def hybrid_list(rows: DataFrame, queries: DataFrame, vectors: DataFrame, doc_type: str, limit: int = 100,
                embedder: models.Embedder | None = None, compat: bool = False) -> DataFrame:
    """(query_id, id, rank, via): newest semantic hits per query, or the project's recent rows when there are none.

    Queries with an empty text go straight to the recent rows. The nearest 2*limit are taken among the vectors that the
    query's project can see, and over all projects for a query that names none; with ``compat`` always over all projects,
    before the project filter, as the product does.
    """
    asked = queries.filter(F.col("query") != "")
    if compat:
        hits = vs.vector_search(asked, vectors, limit * 2, doc_type, embedder, by_project=False)
    else:
        hits = vs.vector_search(asked.filter(F.col("project") != ""), vectors, limit * 2, doc_type, embedder, by_project=True)
        anywhere = asked.filter(F.col("project") == "")
        if not anywhere.isEmpty():
            hits = hits.unionByName(vs.vector_search(anywhere, vectors, limit * 2, doc_type, embedder, by_project=False))
    ids = vs.ids_dedup(hits, vectors, queries).select("query_id", F.col("row_id").alias("id"))
    keys = rows.select("id", "project", "created_at_epoch", *(["importance_score"] if "importance_score" in rows.columns else []))
    semantic = durable(top_per_group(broadcast_if_small(durable(ids), SMALL_IDS).join(keys.select("id", "created_at_epoch"), "id"), "query_id", order_columns("date_desc"), limit, "rank")
                       .select("query_id", "id", "rank"))
    rest = queries.join(semantic.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "project")
    order = order_columns("importance" if "importance_score" in keys.columns else "date_desc")
    recent = top_per_group(keys, "project", order, limit, "rank").select("project", "id", "rank")
    fallback = rest.filter(F.col("project") != "").join(recent, "project").select("query_id", "id", "rank")
    # at most ``limit`` ids in one array, best first, for the queries that name no project
    sort_key = F.struct((-F.coalesce("importance_score", F.lit(1.0))).alias("i") if "importance_score" in keys.columns else F.lit(0).alias("i"),
                        (-F.col("created_at_epoch")).alias("t"), (-F.col("id")).alias("n"))
    newest = keys.orderBy(*order).limit(limit).agg(F.array_sort(F.collect_list(sort_key)).alias("a")).scalar()
    every = rest.filter(F.col("project") == "").select("query_id", F.posexplode(newest).alias("pos", "x")).select(
        "query_id", (-F.col("x.n")).alias("id"), (F.col("pos") + 1).alias("rank"))
    return (semantic.withColumn("via", F.lit("vector")).unionByName(fallback.withColumn("via", F.lit("recent")))
            .unionByName(every.withColumn("via", F.lit("recent"))))
