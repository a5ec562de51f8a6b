"""Every registered query gives the same rows as its SQL, by a plan that scales."""

import re

import pytest
from compare import compare, connect

from __spark_entry__ import entry
from pathlode.plans.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    frames = []

    def query(*args):
        frames.append(QUERIES[name](*args))
        return frames[0]

    assert compare(spark, db, FOLDER, query, ORACLE[name]) is None
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian|Window|Python", plan)


def test_entry(spark):
    rows = entry(spark).collect()
    assert 0 < len(rows) <= 20
    assert rows == sorted(rows, key=lambda r: (-r["size"], r["path"]))
    assert rows[0]["total_count"] >= len(rows)


def test_tables_that_are_folders(spark, db, tmp_path):
    """Queries read a table's part files as they read its one file."""
    for name in ("events", "customer"):
        table = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        table.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("changes_source", "stream_apply", "refresh_keeps_changes"):
        query = QUERIES[name]
        assert compare(spark, db, str(tmp_path), query, ORACLE[name]) is None
