"""Shape of the physical plans that must hold at scale."""

import re

import pytest

from memspark.operators import ordering as od, relations as rl, vector_search as vs
from memspark.operators.filters import obs_visible
from memspark.sources import tables as tb, views as v

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    tb.write_table(v.obs(spark, SF), root, "observations", "overwrite")
    return tb.read_table(spark, root, "observations")


def test_project_filter_prunes_partitions_and_columns(stored):
    p = plan(stored.filter("project = 'p3' AND type = 'bugfix'").select("id", "title"))
    assert re.search(r"PartitionFilters: \[[^\]]*project", p) and "PushedFilters: [IsNotNull(type), EqualTo(type,bugfix)]" in p
    assert "narrative" not in p.split("ReadSchema")[1]


def test_top_k_takes_ordered(stored):
    assert "TakeOrderedAndProject" in plan(obs_visible(stored, "p3", 10))


def test_no_nested_loops(spark, stored):
    vec, q = v.vectors(spark, SF), v.query_vectors(spark, SF)
    for df in (od.visible_top(stored, 20), rl.detect_relations(rl.relation_pairs(stored, stored)), vs.knn_join(q, vec, 5),
               vs.knn_join(q, vec, 5, by_project=False), rl.temporal_pairs(stored), od.keep_latest(stored, 100, "project")):
        p = plan(df)
        assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_group_limit_before_shuffle(stored):
    p = plan(od.top_per_group(stored.select("id", "project", "importance_score", "created_at_epoch"), "project", od.order_columns(), 50))
    assert p.count("WindowGroupLimit") == 2
