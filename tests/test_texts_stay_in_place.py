"""Wide rows are not shuffled to meet a few ids, and not stored longer than they are read."""

import os

from pyspark.sql import functions as F

from memspark.catalog import streams
from memspark.catalog.tables_and_filters import io_context_doc
from memspark.operators import patterns as pt
from memspark.plans import retrieval as rt
from memspark.session import checkpoint_root


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listed_ids_go_to_the_texts(spark, obs_of):
    obs = obs_of([dict(id=i, project=f"p{i % 2}", title=f"t{i}", narrative="n", subtitle="s") for i in range(20)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listed = obs.select(F.col("project").alias("viewer"), "id", F.col("id").cast("int").alias("rank"))
        docs = rt.context_documents(obs, listed, 5)
        assert "SortMergeJoin" not in _plan(docs) and "BroadcastHashJoin" in _plan(docs)
        assert {r.viewer: r.observations for r in docs.collect()} == {"p0": 10, "p1": 10}
        doc = _plan(io_context_doc(spark, "/root/testdata/sf0.001"))
        assert "BroadcastHashJoin" in doc  # the ranked ids; the derived table's own join is by sorting
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_patterns_are_mined_from_slim_rows(spark, obs_of):
    obs = obs_of([dict(id=i, concepts=["x", f"c{i % 3}"], title="t", narrative="an error" if i % 2 else "plain") for i in range(12)])
    matched = obs.filter("id = 0").select("id")
    mined = pt.pattern_mine(obs, matched)
    plan = _plan(mined)
    assert plan.index("LeftAnti") < plan.index("ArrowEvalPython")
    assert sorted(r.frequency for r in mined.collect()) == [3, 4, 4]


def test_a_part_of_a_stream_goes_when_it_is_read(spark):
    df = spark.range(40).select("id", F.when(F.col("id") != 7, F.col("id")).alias("at"), F.lit("text").alias("text"))
    seen, cp = [], streams.scratch(spark)
    root = checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()

    def start(stream):
        return streams.jobs.each_batch(stream, lambda b, i: seen.append(sorted(r.id for r in b.collect())), cp)

    streams.run_in_order(df, "at", 4, start)
    assert len(seen) == 4 and sorted(sum(seen, [])) == list(range(40)) and 7 in seen[0]
    left = [f for d in set(os.listdir(root)) - before - {os.path.basename(cp)} if d.startswith("run-")
            for _, _, fs in os.walk(f"{root}/{d}") for f in fs if f.startswith("part-")]
    assert not left
