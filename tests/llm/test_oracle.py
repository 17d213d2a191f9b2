"""Queries that SQL can express, against it, on whole small tables."""

from __future__ import annotations

import pytest
from compare import difference

import __spark_entry__ as entry
from ridetide.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir) is None


def test_one_query_for_each_operator():
    names = [name for name in entry.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 11))
    assert set(ORACLE) <= set(entry.oracle_sql()) and "pipeline" in entry.queries()
