"""Every registered query against its SQL, and the shape of all plans."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from checks.compare import canonical, connect
from checks.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_the_flagship_query_gives_rows(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    for refused in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert refused not in plan
    got = canonical(pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns))
    want = canonical(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)
