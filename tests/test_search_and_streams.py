import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memspark.operators import feed, fulltext, graph, models, ordering as od, vector_search as vs
from memspark.plans import retrieval as rt
from memspark.sources import tables as tb
from memspark.streaming import jobs


def test_knn_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vs, "VECTOR_BLOCK", 13)
    monkeypatch.setattr(vs, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(3)
    v = [(f"d{i:03d}", i, "observation", "hot" if i % 3 else "cold", "global" if i % 11 == 0 else "project", rng.normal(size=8).tolist()) for i in range(150)]
    v += [("d900", 900, "observation", "hot", "project", v[1][5]), ("d901", 901, "observation", "hot", "project", [0.0] * 8)]
    q = [(i, "hot" if i % 2 else "cold", rng.normal(size=8).tolist()) for i in range(17)]
    V = spark.createDataFrame(v, "doc_id string, row_id long, doc_type string, project string, scope string, embedding array<float>")
    Q = spark.createDataFrame(q, "query_id long, project string, embedding array<float>")

    def unit(x):
        x = np.asarray(x, dtype="float32").astype("float64")
        n = np.linalg.norm(x)
        return x / n if n else x

    for by_project in (True, False):
        got = {(r.query_id, r["rank"]): r.doc_id for r in vs.knn_join(Q, V, 7, by_project=by_project).collect()}
        want = {}
        for qid, proj, e in q:
            seen = [d for d in v if not by_project or d[3] == proj or d[4] == "global"]
            ranked = sorted(seen, key=lambda d: (-round(0.5 + float(unit(e) @ unit(d[5])) / 2, 9), d[0]))[:7]
            want.update({(qid, k + 1): d[0] for k, d in enumerate(ranked)})
        assert got == want


def test_rerank_order(spark):
    c = spark.createDataFrame([(1, "a", 0.9, -5.0, 1), (1, "b", 0.1, 5.0, 2)], "query_id long, doc_id string, score double, logit double, original_rank int")
    r = {x.doc_id: (x.rerank_rank, x.rank_improvement) for x in vs.rerank(c).collect()}
    assert r == {"b": (1, 1), "a": (2, -1)}


QUERIES = [(1, "p", "how does token refresh work?"), (2, "p", "zzzqqq"), (3, "q", "database migration")]


def sample_obs(obs_of):
    rows = [dict(id=1, title="Token refresh", narrative="the token refresh flow renews the session token", importance_score=2.0),
            dict(id=2, title="Token refresh again", narrative="the token refresh flow renews the session token", importance_score=1.0),
            dict(id=3, title="Migration", narrative="database migration adds a column", project="q"),
            dict(id=4, title="Shared", narrative="database backup rules", scope="global", project="z"),
            dict(id=5, title="Hidden", narrative="token refresh elsewhere", project="other"),
            dict(id=6, title="Odd", narrative="has xzzzqqqx inside", file_mtimes={"f": 1})]
    return obs_of(rows)


def test_fts_and_like(spark, obs_of):
    q = spark.createDataFrame(QUERIES, "query_id long, project string, query string")
    o = sample_obs(obs_of)
    fts = {(r.query_id, r.id) for r in fulltext.search_fts(o, q).collect()}
    assert fts == {(1, 1), (1, 2), (3, 3), (3, 4)}
    both = {(r.query_id, r.id) for r in fulltext.search_text_with_fallback(o, q).collect()}
    assert both == fts | {(2, 6)}


def test_two_stage_search(spark, obs_of):
    q = spark.createDataFrame(QUERIES, "query_id long, project string, query string")
    o = sample_obs(obs_of)
    vec = vs.rebuild_vectors(vs.observation_docs(o), None, full=True)
    out = rt.two_stage_search(o, vec, q, threshold=0.6).collect()
    by_query = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append((r.id, r.via))
    assert by_query[1][0] == (2, "vector") and 1 not in [i for i, _ in by_query[1]] and 5 not in [i for i, _ in by_query[1]]
    assert by_query[3][0] == (3, "vector")
    fallback = rt.two_stage_search(o, vec, q, threshold=5.0)
    assert {(r.query_id, r.id, r.via) for r in fallback.collect()} == {(1, 1, "text"), (2, 6, "text"), (3, 3, "text"), (3, 4, "text")}
    stale = spark.createDataFrame([("f", 9)], "path string, mtime long")
    assert 2 not in {r.query_id for r in rt.two_stage_search(o, vec, q, mtimes=stale, threshold=5.0).collect()}


def test_hybrid_list_and_unified(spark, obs_of):
    o = sample_obs(obs_of)
    q = spark.createDataFrame([(1, "q", "database migration"), (2, "p", ""), (3, "", "")], "query_id long, project string, query string")
    vec = vs.rebuild_vectors(vs.observation_docs(o), None, full=True)
    got = {}
    for r in rt.hybrid_list(o, q, vec, "observation", limit=3).collect():
        got.setdefault((r.query_id, r.via), []).append(r.id)
    assert 3 in got[(1, "vector")] and set(got[(2, "recent")]) <= {1, 2, 6} and len(got[(3, "recent")]) == 3


def test_context_documents(spark, obs_of):
    o = obs_of([dict(id=1, title="A", narrative="one two three", facts=["f1"], importance_score=3.0, type="bugfix"),
                dict(id=2, title="A", narrative="one two three", facts=["f1"], importance_score=2.0),
                dict(id=3, title="B", subtitle="sub", narrative="four five six", importance_score=1.0)])
    inj = rt.context_inject(o)
    assert {(r.id, r["rank"], r.duplicates_removed, r.stale_excluded) for r in inj.collect()} == {(1, 1, 1, 0), (3, 2, 1, 0)}
    doc = rt.context_documents(o, inj, full_count=1).first().document
    assert doc.startswith("<memory-context>\n# Project Memory (2 observations)\n")
    assert "## 1. [BUGFIX] A\none two three\nKey facts:\n- f1\n\n- [CHANGE] B: sub\n</memory-context>\n" in doc


def test_embedder_registry_and_rebuild(spark):
    docs = spark.createDataFrame([("a", "some words"), ("b", "")], "doc_id string, content string")
    rows = {r.doc_id: np.array(r.embedding) for r in models.embed_docs(docs).collect()}
    assert np.linalg.norm(rows["a"]) == pytest.approx(1.0, abs=1e-6) and not rows["b"].any()
    assert models.list_embedders()[0][1] == "hashed-64" and models.get_embedder().dimensions == 64


def test_graph_depth(spark):
    e = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 9, 1), (5, 2, 1)], "id long, source_id long, target_id long")
    c = spark.createDataFrame([(1,)], "id long")
    assert {(r.edge_id, r.hop) for r in graph.relation_graph(e, c, 1).collect()} == {(1, 1), (4, 1), (5, 1)}
    assert {(r.edge_id, r.hop) for r in graph.relation_graph(e, c, 2).collect()} == {(1, 1), (4, 1), (5, 1), (2, 2)}


def test_positions_with_one_hot_key(spark):
    d = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("k"), (F.col("id") * 7919 % 5003).alias("t"))
    got = {r.id: r.row_no for r in od.number_in_group(d, "k", ["t", "id"]).collect()}
    pdf = d.toPandas().sort_values(["k", "t", "id"])
    pdf["n"] = pdf.groupby("k").cumcount() + 1
    assert got == dict(zip(pdf.id, pdf.n))


def test_keep_latest(spark):
    d = spark.createDataFrame([(i, "a" if i < 7 else "b", i) for i in range(9)], "id long, project string, created_at_epoch long")
    assert sorted(r.id for r in od.keep_latest(d, 3, "project").collect()) == [0, 1, 2, 3]
    assert sorted(r.id for r in od.keep_latest(d, 5).collect()) == [0, 1, 2, 3] and od.keep_latest(d, 50).count() == 0


def test_transcripts_from_files(spark, tmp_path):
    lines = ['{"type":"user","message":{"role":"user","content":"first"}}', "not json", "",
             '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool_use","name":"x"},{"type":"text","text":"b"}]}}',
             '{"type":"user","message":{"role":"user","content":"[last] one"}}', '{"type":"user","message":{"role":"user","content":""}}', '{"type":"system","message":{"content":"no"}}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    (r,) = tb.last_messages(tb.read_transcript_lines(spark, str(tmp_path))).collect()
    assert (r.last_user, r.last_assistant) == ("[last] one", "a\nb")


def test_table_writes(spark, tmp_path, obs_of):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, k string")
    old = spark.createDataFrame([(9, "b")], "id long, k string")
    assert [(r.id, r.k) for r in tb.insert_ignore(old, new, ["k"]).collect()] == [(1, "a")]
    assert sorted((r.id, r.k) for r in tb.append(old, new.filter("k = 'a'"), ["id"]).collect()) == [(9, "b"), (10, "a"), (11, "a")]
    w = spark.createDataFrame([("c", 0.1, 1)], "concept string, weight double, at long")
    ch = spark.createDataFrame([("c", 0.3, 5), ("c", 0.2, 4), ("d", 1.0, 1)], "concept string, weight double, at long")
    assert {(r.concept, r.weight) for r in tb.upsert(w, ch, ["concept"], "at").collect()} == {("c", 0.3), ("d", 1.0)}
    assert feed.newest_items(feed.feed_union(obs_of([dict(id=1)]), spark.createDataFrame([(5, 9)], "id long, created_at_epoch long"),
                                             spark.createDataFrame([(6, 4)], "id long, created_at_epoch long")), 2).count() == 2


def feed_files(spark, path, batches, ddl):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(path))


def test_prompt_stream_over_batches(spark, tmp_path):
    ddl = "id long, session_id string, prompt_text string, created_at_epoch long"
    src = tmp_path / "in"

    def run():
        s = spark.readStream.schema(ddl).parquet(str(src))
        jobs.run_prompt_dedup(s, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()

    feed_files(spark, src, [[(1, "s", "x", 0), (2, "s", "x", 4000)]], ddl)
    run()
    feed_files(spark, src, [[(3, "s", "x", 9000), (4, "s", "x", 10000), (5, "s", "y", 9000)]], ddl)
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4, 5]


def test_pattern_stream_promotes_once_and_forgets(spark, tmp_path, obs_of):
    week = 7 * 86400000
    cols = ["id", "project", "concepts", "title", "narrative", "created_at_epoch"]
    src = tmp_path / "in"
    schema = obs_of([dict(id=1)]).select(*cols).schema
    panic, leak = "Nil pointer panic", "Memory leak found"
    batches = [[(1, 0, panic), (10, 0, leak)], [(2, 1000, panic)], [(3, 2000, panic)], [(4, 3 * week, panic), (11, 3 * week, leak)]]
    for rows in batches:
        obs_of([dict(id=i, title=title, created_at_epoch=t) for i, t, title in rows]).select(*cols).coalesce(1).write.mode("append").parquet(str(src))
        jobs.run_patterns(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.batch, r.frequency) for r in written.collect()) == [(1, 2), (2, 3), (3, 4)]
    assert [(r.name, r.frequency, r.first_observation_id) for r in jobs.latest_patterns(written).collect()] == [(panic, 4, 1)]
    last = spark.read.parquet(str(tmp_path / "state")).filter("batch = 3").collect()
    # the pattern goes on; the candidate unseen for a week starts anew
    assert sorted((r.frequency, r.promoted, r.first_id) for r in last) == [(1, False, 11), (4, True, 1)]


def test_registry_is_consistent():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 130


def test_verifier_and_extractor(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    v = models.run_verifier(d, lambda pdf: pd.Series(["invalid now", "UNCERTAIN"])[: len(pdf)] if len(pdf) == 2 else pdf["id"].map({1: "invalid now", 2: "UNCERTAIN"}))
    assert {r.id: r.keep for r in v.collect()} == {1: False, 2: True}


def test_cross_encoder_scores_every_document(spark, tmp_path):
    import __spark_entry__ as e
    spark.createDataFrame([(3, "alpha beta"), (8, "gamma")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, "gamma alpha") for i in range(10, 15)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.query_id, r.logit) for r in e.queries()["cross_encoder_documents"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(10, 15)) and {q for q, _ in got.values()} == {3, 8} and max(z for _, z in got.values()) > -2.0


def test_memory_stream_cascades_and_finds_patterns(spark, tmp_path, obs_of):
    cols = [c.split()[0] for c in jobs.STORE.split(", ")]
    src, root = str(tmp_path / "in"), str(tmp_path / "root")
    schema = obs_of([dict(id=1)]).select(*cols).schema
    first = [dict(id=1, title="Nil pointer panic", narrative="parser broke while reading empty yaml documents", files_modified=["a"], created_at_epoch=1000),
             dict(id=2, title="Cache", narrative="Actually, that was wrong about eviction thresholds", files_modified=["a"], created_at_epoch=2000)]
    second = [dict(id=3, title="Nil pointer panic", narrative="websocket handler crashed during shutdown handshake sequence", files_modified=["a"], created_at_epoch=3000)]
    for rows in (first, second):
        obs_of(rows).select(*cols).coalesce(1).write.mode("append").parquet(src)
        jobs.run_memory(spark.readStream.schema(schema).parquet(src), root, str(tmp_path / "cp"), keep=2).awaitTermination()
        t = {k: df.collect() for k, df in jobs.latest_memory(spark, root).items()}
        if rows is first:
            assert [(r.newer_obs_id, r.older_obs_id, r.detected_at_epoch) for r in t["conflicts"]] == [(2, 1, 2000)]
            assert {r.row_id for r in t["vectors"]} == {1, 2} and (2, 1) in {(r.source_id, r.target_id) for r in t["relations"]}
    assert sorted(r.id for r in t["observations"]) == [2, 3] and {r.row_id for r in t["vectors"]} == {2, 3}
    assert {(r.source_id, r.target_id) for r in t["relations"]} == {(3, 2)}
    assert not [r for r in t["conflicts"] if 1 in (r.newer_obs_id, r.older_obs_id)]
    assert [(r.name, r.frequency, r.first_observation_id) for r in t["patterns"]] == [("Nil pointer panic", 2, 1)]


def test_vocabulary_ties_go_by_term(spark):
    """Three terms have the cosine 1 / sqrt(2) with the query; vectors of floats would put the first one last."""
    terms = ["alpha beta beta gamma gamma gamma delta delta", "gamma delta", "gamma omega"]
    words = "alpha beta gamma delta omega".split()
    assert len({int(np.argmax(v)) for v in models.HASHED.embed(pd.Series(words))}) == len(words)
    vocabulary = spark.createDataFrame([(t, 1.0) for t in terms], "term string, weight double")
    queries = spark.createDataFrame([(1, "p", "gamma")], "query_id long, project string, query string")
    got = vs.expand_vocab(queries, vocabulary, min_similarity=0.3).collect()
    assert sorted(r["source"] for r in got) == [f"vocabulary:{t}" for t in terms[:2]]
