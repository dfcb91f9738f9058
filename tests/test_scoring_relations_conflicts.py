import pytest
from pyspark.sql import functions as F

from memspark.operators import conflicts as cf, pairs as pr, patterns as pt, relations as rl, scoring as sc
from memspark.operators.pairs import candidate_pairs

NOW = 1736942400000  # 2025-01-15T12:00Z
DAY = 86400000


@pytest.mark.parametrize("row,score", [
    (dict(type="bugfix", created_at_epoch=NOW), 1.3), (dict(type="discovery", created_at_epoch=NOW - 7 * DAY), 0.55),
    (dict(type="feature", created_at_epoch=NOW - 14 * DAY), 0.30), (dict(type="change", created_at_epoch=NOW, user_feedback=1), 1.2),
    (dict(type="change", created_at_epoch=NOW, user_feedback=-1), 0.6), (dict(type="change", created_at_epoch=NOW + DAY), 0.9),
    (dict(type="change", created_at_epoch=NOW - 900 * DAY, user_feedback=-1), 0.01),
    (dict(type="odd", created_at_epoch=NOW, concepts=["security", "security", "none"]), 1.12),
    (dict(type="refactor", created_at_epoch=NOW, retrieval_count=7), 1.045),
])
def test_scores(obs_of, row, score):
    assert sc.importance_score(obs_of([{"id": 1, **row}]), NOW).first().score == pytest.approx(score, abs=1e-9)


def test_rescore_and_feedback(spark, obs_of):
    o = obs_of([dict(id=1, score_updated_at_epoch=NOW - DAY, created_at_epoch=NOW), dict(id=2, score_updated_at_epoch=NOW, importance_score=5.0)])
    done = {r.id: r.importance_score for r in sc.apply_scores(o, sc.rescore_batch(o, NOW)).collect()}
    assert done == {1: pytest.approx(0.9), 2: 5.0}
    fb = spark.createDataFrame([(1, 1, 1), (1, -1, 2), (2, 7, 1)], "id long, feedback int, at long")
    out = {r.id: (r.user_feedback, r.importance_score) for r in sc.apply_feedback(o, fb, NOW).collect()}
    assert out[1] == (-1, pytest.approx(0.6)) and out[2] == (0, 5.0)


def relation(obs_of, newer, older):
    new, old = obs_of([{"id": 2, **newer}]), obs_of([{"id": 1, "importance_score": 1.0, **older}])
    return rl.detect_relations(rl.relation_pairs(new, old)).collect()


@pytest.mark.parametrize("newer,older,rtype,source,conf", [
    (dict(type="bugfix", files_modified=["a"], sdk_session_id="x"), dict(type="feature", files_modified=["a"]), "fixes", "file_overlap", 0.8),
    (dict(type="change", files_read=["a"], sdk_session_id="x"), dict(type="change", files_modified=["a"]), "relates_to", "file_overlap", 0.6),
    (dict(type="change", files_modified=["a"], sdk_session_id="x"), dict(type="change", files_modified=["a"]), "supersedes", "file_overlap", 0.7),
    (dict(concepts=["security"], sdk_session_id="x"), dict(concepts=["security"]), "relates_to", "concept_overlap", 0.9),
    (dict(type="feature", sdk_session_id="x"), dict(type="decision"), "depends_on", "type_progression", 0.6),
    (dict(created_at_epoch=60000), dict(created_at_epoch=0), "relates_to", "temporal_proximity", 0.62),
    (dict(narrative="It FIXED the bug", sdk_session_id="x"), {}, "fixes", "narrative_mention", 0.7),
    (dict(narrative="x caused y", created_at_epoch=60000), dict(created_at_epoch=0), "causes", "narrative_mention", 0.7),
])
def test_relations(obs_of, newer, older, rtype, source, conf):
    (r,) = relation(obs_of, newer, older)
    assert (r.source_id, r.target_id, r.relation_type, r.detection_source) == (2, 1, rtype, source)
    assert r.confidence == pytest.approx(conf)


def test_no_relation(obs_of):
    assert relation(obs_of, dict(sdk_session_id="x"), {}) == []
    assert relation(obs_of, dict(files_modified=["a"]), dict(files_modified=["a"], is_superseded=True)) == []
    assert relation(obs_of, dict(files_modified=["a"]), dict(files_modified=["a"], project="other")) == []
    assert len(relation(obs_of, dict(files_modified=["a"]), dict(files_modified=["a"], project="other", scope="global"))) == 1


def test_candidates_are_the_best_that_were_there(obs_of):
    o = obs_of([dict(id=i, project="p" if i % 2 else "q", scope="global" if i % 5 == 0 else "project", importance_score=float(i % 7)) for i in range(60)])
    rows = {r.id: r for r in o.collect()}
    want = set()
    for n in rows.values():
        vis = [r for r in rows.values() if (r.scope == "global" or r.project == n.project) and r.id < n.id]
        top = sorted(vis, key=lambda r: (-r.importance_score, -r.created_at_epoch, -r.id))[:10]
        want |= {(n.id, r.id) for r in top}
    assert {(r.n_id, r.o_id) for r in candidate_pairs(o, o, ["id"], ["id"], 10).collect()} == want


def test_candidates_when_the_best_rows_are_newer(obs_of):
    o = obs_of([dict(id=i, importance_score=float(i)) for i in range(30)])
    got = {(r.n_id, r.o_id) for r in candidate_pairs(o, o, ["id"], ["id"], 5).collect()}
    assert got == {(n, m) for n in range(30) for m in range(max(0, n - 5), n)}


@pytest.mark.parametrize("newer,older,ctype", [
    (dict(narrative="Actually, that was wrong"), {}, "contradicts"), (dict(title="Correction: x"), {}, "contradicts"),
    (dict(title="added cache", files_modified=["a"]), dict(title="removed cache", files_modified=["a"]), "superseded"),
    (dict(concepts=["api"], files_modified=["a"]), dict(concepts=["api"], files_modified=["a", "b"]), "superseded"),
    (dict(concepts=["api"], files_modified=["a"]), dict(concepts=["api"], files_modified=["b"]), None),
])
def test_conflicts(obs_of, newer, older, ctype):
    pairs = cf.conflict_pairs(obs_of([{"id": 2, **newer}]), obs_of([{"id": 1, **older}]))
    got = cf.detect_conflicts(pairs).collect()
    assert [r.conflict_type for r in got] == ([ctype] if ctype else [])


def test_overlap_option_limits_corrections(obs_of):
    pairs = cf.conflict_pairs(obs_of([dict(id=2, narrative="that was wrong")]), obs_of([dict(id=1)]))
    assert cf.detect_conflicts(pairs).count() == 1 and cf.detect_conflicts(pairs, require_overlap=True).count() == 0


def test_pattern_life_cycle(spark, obs_of):
    o = obs_of([dict(id=i, title="Nil pointer panic", concepts=["gotcha"], project="p") for i in (1, 2)] + [dict(id=3, title="Other words")])
    none = spark.createDataFrame([], "id long, pattern_id long, score double")
    (m,) = pt.pattern_mine(o, none).collect()
    assert (m.name, m.type, m.frequency, m.projects, m.first_observation_id) == ("Nil pointer panic", "bug", 2, ["p"], 1)
    p = spark.createDataFrame([(7, "x", "bug", ["gotcha", "pointer"], 3, ["p"], [1], "active", 0.5, 0, None)],
                              "id long, name string, type string, signature array<string>, frequency long, projects array<string>, observation_ids array<long>, status string, confidence double, last_seen_at_epoch long, merged_into_id long")
    match = {r.id: r.score for r in pt.pattern_match(o, p).collect()}
    assert match == {1: pytest.approx(2 / 3), 2: pytest.approx(2 / 3)}
    seen = spark.createDataFrame([(7, 1, "p", 5), (7, 2, "q", 9), (7, 2, "q", 9)], "pattern_id long, observation_id long, project string, seen_at long")
    r = pt.pattern_occurrence(p, seen).first()
    assert (r.frequency, r.projects, r.last_seen_at_epoch) == (4, ["p", "q"], 9) and r.confidence == pytest.approx(0.3 + 0.16 + 0.1)


def test_cascade_and_staleness(spark, obs_of):
    o = obs_of([dict(id=1, is_superseded=True, file_mtimes={"a": 5}), dict(id=2, file_mtimes={"a": 9, "gone": 1})])
    vec = spark.createDataFrame([("d1", 1, "observation"), ("d2", 1, "user_prompt")], "doc_id string, row_id long, doc_type string")
    rel = spark.createDataFrame([(1, 1, 2), (2, 2, 3)], "id long, source_id long, target_id long")
    con = spark.createDataFrame([(1, 2, 1, 0)], "id long, newer_obs_id long, older_obs_id long, detected_at_epoch long")
    out = cf.purge_superseded(o, vec, rel, con, 10 * DAY)
    assert [[r[0] for r in out[k].collect()] for k in ("observations", "vectors", "relations", "conflicts")] == [[2], ["d2"], [2], []]
    cur = spark.createDataFrame([("a", 7)], "path string, mtime long")
    assert {r.id: r.is_stale for r in cf.mtime_staleness(o, cur).collect()} == {1: True, 2: False}


def test_cells_stay_small_when_scores_are_tied(spark, obs_of):
    o = obs_of([dict(id=i, project="p" if i % 4 else "q", created_at_epoch=i // 50 if i < 2000 else 40) for i in range(4000)])
    n, times = 5, ["created_at_epoch", "id"]
    bounds = pr._time_ranges(o.select(*times))
    where = o.select(F.col("project").alias("viewer"), pr._range_of(bounds, *times).alias("range"))
    assert where.groupBy("range").count().agg(F.max("count")).first()[0] < 400  # half of the rows have one time
    spans = pr.best_so_far(o, n, where.distinct(), bounds).filter("o_id IS NOT NULL")
    assert spans.groupBy("viewer", "range", "cell").count().agg(F.max("count")).first()[0] <= 3 * n
    assert spans.count() < 2 * 4000 + 2 * n * len(bounds) + 2 * n
    pairs = pr.candidate_pairs(o, o, ["id"], ["id"], n)
    assert "collect_list" not in pairs._jdf.queryExecution().toString()
    want = set()
    for part in ([i for i in range(4000) if i % 4], range(0, 4000, 4)):
        want |= {(row, older) for k, row in enumerate(part) for older in part[max(0, k - n):k]}
    assert {(r.n_id, r.o_id) for r in pairs.collect()} == want
