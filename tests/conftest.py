import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("memspark-tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


OBS_DDL = ("id long, sdk_session_id string, project string, scope string, type string, title string, subtitle string, "
           "facts array<string>, narrative string, concepts array<string>, files_read array<string>, files_modified array<string>, "
           "file_mtimes map<string,bigint>, created_at_epoch long, importance_score double, user_feedback int, "
           "retrieval_count long, score_updated_at_epoch long, is_superseded boolean")


def make_obs(spark, rows):
    """Observations from dicts; missing fields get plain defaults."""
    base = dict(sdk_session_id="s", project="p", scope="project", type="change", title="", subtitle=None, facts=[], narrative="",
                concepts=[], files_read=[], files_modified=[], file_mtimes=None, created_at_epoch=0, importance_score=None,
                user_feedback=0, retrieval_count=0, score_updated_at_epoch=None, is_superseded=False)
    names = [c.split()[0] for c in OBS_DDL.split(", ")]
    full = [{**base, "created_at_epoch": r["id"], **r} for r in rows]
    return spark.createDataFrame([tuple(f[n] for n in names) for f in full], OBS_DDL)


@pytest.fixture(scope="session")
def obs_of(spark):
    return lambda rows: make_obs(spark, rows)
