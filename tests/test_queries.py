"""Every registered query against its SQL counterpart, and the shape of its plan."""

import re

import pytest

from __spark_entry__ import entry
from plaudit.catalog.oracle import ORACLES
from plaudit.catalog.queries import QUERIES
from compare import difference, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert not [name for name in QUERIES if "pipeline" in name or re.match(r"op\d*_", name)]


def test_entry(spark):
    assert entry(spark).count() == 5


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, SMALL)
    problem = difference(frame, connection, ORACLES[name])
    assert problem is None, problem
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan
    # A window in one task is fine over the counts of spans, which are few, and over nothing else.
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if re.search(r"\bWindow \[", line) and "SinglePartition" in "".join(lines[at:at + 6]):
            assert "span_rows" in line, line
