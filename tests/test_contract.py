"""Every registered query against its SQL, over the same files."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from earthworks import registry
from tests.compare import database, differences
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_query_has_sql():
    assert set(registry.JOBS) <= set(contract.queries()) & set(contract.oracle_sql())


def test_entry_gives_rows(spark):
    assert contract.entry(spark).count() > 0


# A window with no key may only see a row per part that the rows were dealt to.
WHOLE_TABLE_WINDOWS = {"cash_running_all", "cash_since_all", "append_rows", "attendance_batch", "post_receptions_rows"}


@pytest.mark.parametrize("name", list(registry.JOBS))
def test_equal_in_both_engines(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    rows, diff = differences(df, con, name)
    assert not diff
    assert rows > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert unwanted not in plan
    keyless = re.search(r"Window \[.*?\], \[[^\[\]]* ASC", plan) and re.search(r"windowspecdefinition\(\w+#\d+L? ASC", plan)
    assert not keyless or name in WHOLE_TABLE_WINDOWS
