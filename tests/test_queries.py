"""Every ledger query against its SQL on DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from quillspark.plans.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if pd.isna(x):
        return ""
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    return str(x)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["replay_root_match", "apply_diff"])
def test_changes_are_folded_once(spark, name):
    """Both states are stored; what follows does not read the change feed again."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_accesses_are_dealt_before_they_are_told_apart(spark, monkeypatch):
    """One shuffle, of lines; its number of parts follows theirs, so no task's table of accesses grows with the input."""
    from quillspark.plans import relations

    monkeypatch.setattr(relations, "LINES_A_TASK", 200, raising=False)
    got = QUERIES["access_sets"](spark, DATA)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange") :]
    assert got.rdd.getNumPartitions() == spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 200
