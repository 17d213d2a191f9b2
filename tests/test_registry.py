"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import difference
from conftest import ROOT
from ridetide.plans.catalog import QUERIES
from ridetide.plans.oracle import ORACLE


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir) is None


BATCH = [name for name in QUERIES if not name.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_plans_hold_at_scale(spark, sf_dir, name):
    """No cross join, no Python per row, and a single task only ever gets combined rows."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan
    lines = plan.splitlines()
    for line, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in line:
            assert "partial_" in below or "TakeOrderedAndProject" in below


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("library", ["ahocorasick", "xxhash", "zstandard"])
def test_entry_without_a_library_of_the_training_data_queries(library):
    """The other queries are there, and a warning says what is missing."""
    code = (
        f"import sys, warnings; sys.modules[{library!r}] = None\n"
        "with warnings.catch_warnings(record=True) as said:\n"
        "    warnings.simplefilter('always')\n"
        "    import __spark_entry__ as entry\n"
        "assert entry.queries().keys() == entry.QUERIES.keys() and entry.oracle_sql()\n"
        f"assert any({library!r} in str(w.message) for w in said) or not entry.LLM_QUERIES\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
