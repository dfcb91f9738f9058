"""Steps that moved or held whole tables: what they shuffle, write and hand to Python, with equal results."""

import pandas as pd
import pytest

from memspark import catalog
from memspark.catalog import streams
from memspark.operators import models, patterns as pt, scoring as sc
from memspark.streaming import jobs

DAY = 24 * 3600 * 1000
NOW = 1_000 * DAY


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_frequent_kind_are_made_last(spark, obs_of, monkeypatch):
    monkeypatch.setattr(pt, "LIST_IDS", 3)
    obs = obs_of([dict(id=i, concepts=["common"], title="") for i in range(1, 41)] + [dict(id=99, concepts=["rare"], title="")])
    rows = [(i, "active", 1, 0.5, ["common"] if i else ["rare"]) for i in range(20)]
    pats = spark.createDataFrame(rows, "id long, status string, frequency long, confidence double, signature array<string>")
    got = pt.signature_join(obs, pats)
    assert sorted((r["id"], r["pattern_id"], r["score"]) for r in got.collect()) == [
        *[(i, p, 1.0) for i in range(1, 41) for p in range(1, 20)], (99, 0, 1.0)]
    plan = optimized(got)
    assert 0 <= plan.find("Generate explode(ids") < plan.index("Join")  # nothing is joined once the pairs are there


def test_a_stream_table_is_written_by_all_its_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch", lambda _: str(tmp_path / "table"))
    stream, sizes = streams.as_stream(spark.range(0, 90, 1, 9).toDF("x")), []
    assert len(list((tmp_path / "table").glob("part-*"))) == 9
    streams.finish(jobs.each_batch(stream, lambda df, i: sizes.append(df.count()), str(tmp_path / "cp")))
    assert sizes == [50, 40]


def test_rescoring_in_place(spark, obs_of):
    obs = obs_of([dict(id=1, score_updated_at_epoch=NOW - DAY, created_at_epoch=NOW - 9 * DAY, concepts=["security"]),
                  dict(id=2, score_updated_at_epoch=NOW, importance_score=5.0), dict(id=3, type="bugfix", importance_score=None),
                  dict(id=4, score_updated_at_epoch=NOW, importance_score=None)])
    want = sc.apply_scores(obs, sc.rescore_batch(obs, NOW))
    got = sc.rescored(obs, NOW)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.schema == obs.schema
    assert "Join" not in optimized(got)


def test_neighbours_meet_without_joining_the_table_with_itself(spark):
    got = catalog.all_queries()["jaccard"](spark, "/root/testdata/sf0.001")
    ids = [r["id"] for r in got.select("id").collect()]
    assert len(ids) == len(set(ids)) and {254, 255, 256, 511} <= set(ids)  # also across the blocks' edges
    assert optimized(got).count("Join ") == 1  # of events and documents


@pytest.mark.parametrize("texts", [["x" * 3_000_000] * 5 + [None, "", "y"]])
def test_models_get_few_bytes_at_a_time(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)

    def held(rows: pd.Series) -> pd.Series:
        return rows.where(rows.isna(), str(int(rows.fillna("").str.len().sum())))

    got = {r["id"]: r["response"] for r in models.run_extractor(df, held).collect()}
    assert len(got) == len(texts) and got[5] is None and max(int(x) for x in got.values() if x) <= 8_000_000
    blank = {r["id"]: r["embedding"] for r in models.embed_docs(df, "text").select("id", "embedding").collect()}
    assert len(blank) == len(texts) and not any(blank[5]) and not any(blank[6]) and any(blank[7])
