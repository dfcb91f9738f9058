"""Keyword search with counts taken in place, and by one automaton, against plain Python."""

import math
import random
import re
from collections import Counter

from memspark.operators import fulltext
from memspark.operators.fulltext import B, K1, MIN_IDF

WORDS = ["common"] * 30 + ["often"] * 12 + [f"word{i}" for i in range(25)] + [f"rare{i}" for i in range(60)]


def many_obs(obs_of, n=600, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = rnd.choices(WORDS, k=rnd.randint(1, 25))
        rows.append(dict(id=i, title=" ".join(words[:3]), narrative=" ".join(words[3:]), project=rnd.choice(["p", "p", "p", "q", "r"]),
                         scope=rnd.choice(["project", "project", "global"]), importance_score=rnd.choice([1.0, 2.0]),
                         created_at_epoch=rnd.randint(0, 50)))
    return rows


QUERIES = [(1, "p", "common rare1 rare2"), (2, "q", "common"), (3, "p", "common often word3 word4 rare7"), (4, "none", "often common"),
           (5, "r", "rare5"), (6, "p", "absent nothing"), (7, "p", "???")]


def body(r):
    return "\n".join([r["title"], r.get("subtitle") or "", r["narrative"]]).lower()


def test_best_matches_equal_plain_scores(spark, obs_of):
    rows = many_obs(obs_of)
    docs = {r.id: r for r in obs_of(rows).collect()}
    texts = {i: "\n".join(x for x in (r.title, r.subtitle, r.narrative) if x is not None).lower() for i, r in docs.items()}
    toks = {i: re.findall("[a-z0-9_]+", t) for i, t in texts.items()}
    avg, n = sum(map(len, toks.values())) / len(toks), len(toks)
    df = Counter(t for x in toks.values() for t in set(x))
    q = spark.createDataFrame(QUERIES, "query_id long, project string, query string")
    for limit in (1, 10):
        want = {}
        for qid, project, text in QUERIES:
            scores = {}
            for i, words in toks.items():
                if docs[i].project != project and docs[i].scope != "global":
                    continue
                count = Counter(words)
                for t in set(re.findall("[a-z0-9]{4,}", text)):
                    if count[t]:
                        idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                        idf = idf if idf > 0 else MIN_IDF
                        scores[i] = scores.get(i, 0) + idf * count[t] * (K1 + 1) / (count[t] + K1 * (1 - B + B * len(words) / avg))
            best = sorted(scores, key=lambda i: (-round(scores[i], 9), -docs[i].importance_score, i))[:limit]
            want.update({(qid, k + 1): i for k, i in enumerate(best)})
        got = {(r.query_id, r.rank): r.id for r in fulltext.search_fts(obs_of(rows), q, limit).collect()}
        assert got == want


def test_substrings_equal_a_plain_scan(spark, obs_of):
    rows = many_obs(obs_of, 200) + [dict(id=900, title="x_uncommonly", narrative="", project="q", importance_score=9.0)]
    docs = obs_of(rows).collect()
    q = spark.createDataFrame(QUERIES, "query_id long, project string, query string")
    want = {}
    for qid, project, text in QUERIES:
        words = re.findall("[a-z0-9]{4,}", text)
        seen = [r for r in docs if (r.project == project or r.scope == "global")
                and any(w in "\n".join(x for x in (r.title, r.subtitle, r.narrative) if x).lower() for w in words)]
        seen.sort(key=lambda r: (-r.importance_score, -r.created_at_epoch, -r.id))
        want.update({(qid, k + 1): r.id for k, r in enumerate(seen[:10])})
    got = {(r.query_id, r.rank): r.id for r in fulltext.search_like(obs_of(rows), q).collect()}
    assert got == want and want[(2, 1)] == 900


def test_substrings_over_several_automata(spark, obs_of, monkeypatch):
    q = spark.createDataFrame(QUERIES, "query_id long, project string, query string")
    rows = many_obs(obs_of, 100)
    once = sorted(fulltext.search_like(obs_of(rows), q).collect())
    monkeypatch.setattr(fulltext, "AUTOMATON_CHARACTERS", 10)
    assert sorted(fulltext.search_like(obs_of(rows), q).collect()) == once


def test_no_gram_or_body_is_shuffled(spark, obs_of):
    q = spark.createDataFrame(QUERIES, "query_id long, project string, query string")
    plan = fulltext.search_like(obs_of(many_obs(obs_of, 20)), q)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange" in line]
    assert shuffled and "CartesianProduct" not in plan and "NestedLoop" not in plan
    udf_at = plan.index("ArrowEvalPython")
    assert "Exchange" not in plan[udf_at:]  # nothing below the automaton moves


def test_terms_in_several_parts_count_documents_once(spark, obs_of, monkeypatch):
    q = spark.createDataFrame(QUERIES, "query_id long, project string, query string")
    rows = many_obs(obs_of, 100)
    once = [(r.query_id, r.id, round(r.score, 9), r["rank"]) for r in fulltext.search_fts(obs_of(rows), q).collect()]
    monkeypatch.setattr(fulltext, "KEYWORD_CHARACTERS", 10)
    several = [(r.query_id, r.id, round(r.score, 9), r["rank"]) for r in fulltext.search_fts(obs_of(rows), q).collect()]
    assert sorted(several) == sorted(once)


def test_empty_inputs(spark, obs_of):
    none = spark.createDataFrame([], "query_id long, project string, query string")
    q = spark.createDataFrame(QUERIES, "query_id long, project string, query string")
    some = obs_of(many_obs(obs_of, 5))
    for search in (fulltext.search_fts, fulltext.search_like):
        assert search(some, none).collect() == []
        assert search(some.limit(0), q).collect() == []


def test_pattern_search_scores_classes(spark):
    """Thirty equal queries over patterns of six kinds are three scores, and every query still gets its own rows."""
    rows = [(i, f"shared kind{i % 6} {i}", "about shared things", None, "active" if i % 7 else "merged") for i in range(300)]
    pats = spark.createDataFrame(rows, "id long, name string, description string, recommendation string, status string")
    asked = [(q, "", "shared kind3 kind4") for q in range(30)]
    queries = spark.createDataFrame(asked, "query_id long, project string, query string")
    terms = fulltext.query_keywords(queries)
    counted = fulltext.counted_tokens(pats, fulltext.PATTERN_FIELDS, terms, ["status"])
    assert fulltext.class_scores(counted, terms)[2].count() == 3  # kind3, kind4, and all others are alike
    plain = fulltext.bm25_scores(pats, fulltext.PATTERN_FIELDS, terms, scoped=False, carried=("status",)).collect()
    got = fulltext.search_patterns_fts(pats, queries).collect()
    for q in (0, 29):
        best = sorted((-round(r["score"], 9), r["id"]) for r in plain if r["query_id"] == q and r["status"] == "active")[:10]
        mine = sorted((r["rank"], -round(r["score"], 9), r["id"]) for r in got if r["query_id"] == q)
        assert [x[1:] for x in mine] == best and [x[0] for x in mine] == list(range(1, 11))
    assert len(got) == 300


def test_a_keyword_leaves_a_task_only_for_rows_that_may_rank(spark, obs_of, monkeypatch):
    """A thousand rows hold the word; a task lets go of few of them, whatever the order, and of no row that ties with the last."""
    rnd = random.Random(7)
    rows = [dict(id=i, title="common", narrative=f"text {i % 9}", project=rnd.choice(["p", "q", None]), scope=["project", "global", None][i % 3],
                 importance_score=rnd.choice([None, 0.5, 2.0, float("nan")] if i % 2 else [1.0]), created_at_epoch=rnd.choice([None, 1, 2, i])) for i in range(1000)]
    rnd.shuffle(rows)
    monkeypatch.setattr(fulltext, "PAIRS_AT_ONCE", 50)
    obs = obs_of(rows).coalesce(1)
    q = spark.createDataFrame([(1, "p", "common text"), (2, "zz", "common")], "query_id long, project string, query string")

    def rank(r):
        s = 1.0 if r["importance_score"] is None else r["importance_score"]
        return (s != s, s if s == s else 0.0, r["created_at_epoch"] is not None, r["created_at_epoch"] or 0, r["id"])

    for cells in (4_000_000, 8, 3):
        monkeypatch.setattr(fulltext, "LIST_CELLS", cells)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
        got = {(r.query_id, r["rank"]): r.id for r in fulltext.search_like(obs, q).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for query, project in ((1, "p"), (2, "zz")):
            seen = sorted((r for r in rows if r["project"] == project or r["scope"] == "global"), key=rank, reverse=True)[:10]
            assert [got[(query, k + 1)] for k in range(10)] == [r["id"] for r in seen]
    monkeypatch.setattr(fulltext, "LIST_CELLS", 4_000_000)
    from pyspark.sql import functions as F
    score, n = F.coalesce("importance_score", F.lit(1.0)), F.col("created_at_epoch")
    held = fulltext.keywords_within(F.col("title"), ["common"], F.col("project"), F.col("scope") == "global", score, n, 10)
    assert 30 <= obs.filter(F.size(held) > 0).count() < 400


def test_scores_in_place_equal_scores_by_joins_and_are_not_shuffled(spark, obs_of, monkeypatch):
    rows = many_obs(obs_of, 200)
    for r in rows[::9]:
        r["project"] = None
    for r in rows[::11]:
        r["scope"] = None
    for r in rows[50:120]:
        r["title"], r["narrative"] = rows[0]["title"], rows[0]["narrative"]  # equal texts of several projects
    obs = obs_of(rows)
    terms = fulltext.query_keywords(spark.createDataFrame([*QUERIES, (8, None, "often rare9")], "query_id long, project string, query string"))

    def scores(scoped):
        df = fulltext.bm25_scores(obs, fulltext.OBSERVATION_FIELDS, terms, scoped, carried=("importance_score",))
        return df, sorted((r.query_id, r.id, round(r.score, 9), r.importance_score) for r in df.collect())

    none = {r["id"] for r in rows if r["project"] is None}
    monkeypatch.setattr(fulltext, "SCORES_AT_ONCE", 40)
    for scoped in (True, False):
        monkeypatch.setattr(fulltext, "SMALL_KEYWORDS", 200_000)
        found, mine = scores(scoped)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(fulltext, "SMALL_KEYWORDS", 0)
        joined = scores(scoped)[1]
        if scoped:  # the joins leave out global rows without a project for a query without one, which it sees in the SQL
            assert [x for x in mine if x[0] == 8 and x[1] in none]
            mine = [x for x in mine if x[0] != 8 or x[1] not in none]
        assert mine == joined and len(mine) > 100
