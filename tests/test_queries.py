"""Every registered query equals its SQL, and runs as the plan it should."""

import re

import pytest
from compare import DATA, duck, duck_rows, spark_rows

import __spark_entry__ as contract
from fieldlens.plans.catalogue import QUERIES as CATALOGUE
from fieldlens.plans.oracles import ORACLES

FOLDER = DATA / "sf0.01"
NAMES = sorted(CATALOGUE)


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def test_each_query_has_sql():
    assert set(CATALOGUE) == set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name, capsys):
    frame = contract.queries()[name](spark, str(FOLDER))
    frame.explain()
    plan = capsys.readouterr().out
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas", plan)
    columns, got = spark_rows(frame)
    expected_columns, expected = duck_rows(connection, contract.oracle_sql()[name])
    assert columns == expected_columns
    assert len(got) == len(expected) > 0
    assert got == expected


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[:3] == ["casename", "date", "Reservoir"]
    assert frame.count() > 0
