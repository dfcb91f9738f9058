"""Candidate pairs: one list of global rows for all projects."""

import random

from memspark.operators import pairs as pr


def arrival(rows, n):
    """Pairs by walking through the rows in the order of their arrival."""
    out, seen = set(), []
    for r in sorted(rows, key=lambda x: (x["created_at_epoch"], x["id"])):
        visible = [o for o in seen if o["scope"] == "global" or o["project"] == r["project"]]
        visible.sort(key=lambda o: (o["importance_score"], o["created_at_epoch"], o["id"]), reverse=True)
        if r["project"] is not None:
            out |= {(r["id"], o["id"]) for o in visible[:n]}
        seen.append(r)
    return out


def rows_of(n, projects, score, seed):
    r = random.Random(seed)
    return [dict(id=i + 1, project=r.choice([f"p{j}" for j in range(projects)] + ["global"]), scope=r.choice(["global", "project", "project"]),
                 created_at_epoch=i // 3, importance_score=score(i, r)) for i in range(n)]


def test_like_arrival_when_scores_rise(spark, obs_of, monkeypatch):
    monkeypatch.setattr(pr, "RANGES", 3)
    for projects, score in ((12, lambda i, r: i / 100), (3, lambda i, r: r.choice([0.5, 1.0, 1.5])), (2, lambda i, r: -i / 100)):
        rows = rows_of(160, projects, score, projects)
        obs = obs_of(rows)
        got = [(x["n_id"], x["o_id"]) for x in pr.candidate_pairs(obs, obs, ["id"], ["id"], max_candidates=4).collect()]
        assert len(got) == len(set(got)) and set(got) == arrival(rows, 4)


def test_spans_grow_with_rows_not_with_projects(spark, obs_of, monkeypatch):
    monkeypatch.setattr(pr, "RANGES", 2)
    rows = [dict(id=i + 1, project=f"p{i % 40}", scope="global", created_at_epoch=i, importance_score=i / 10) for i in range(200)]
    obs = obs_of(rows)
    bounds = pr._time_ranges(obs.select("created_at_epoch", "id"))
    parts = len(bounds) + 1
    wanted = spark.createDataFrame([(v, r) for v in [pr.GLOBAL, *[f"p{j}" for j in range(40)]] for r in range(parts)], "viewer string, range int")
    spans = pr.best_so_far(obs, 5, wanted, bounds)
    held = spans.filter("o_id IS NOT NULL")
    assert held.count() <= 2 * 200 + 5 * (parts + 200 // 10 + 1) and held.select("viewer").distinct().count() == 1


def test_no_product_in_the_plan(spark, obs_of):
    obs = obs_of(rows_of(30, 3, lambda i, r: 1.0, 1))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pr.candidate_pairs(obs, obs, ["id"], ["id"])._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
