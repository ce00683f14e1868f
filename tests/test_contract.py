"""Every query against its SQL twin at the smallest scale."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from paperlake.plans import queries as own

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_query_has_a_twin():
    assert set(own.queries()) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER)
    want = duck.sql(contract.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = ordered(duck.sql(f"select {quoted} from want").fetchall())
    assert ordered(tuple(r) for r in got.select(*columns).collect()) == expected
    assert len(expected) > 0


def test_plans_have_no_cross_joins_or_python(spark):
    for name in ("library_one_tenant", "collection_papers", "set_status", "replay_library", "related_papers"):
        plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython", plan), name
