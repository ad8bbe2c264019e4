"""Every registered core query with SQL gives the rows of that SQL."""

import importlib

import pytest
from oracle import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [importlib.import_module(f"tessera.catalog.{name}") for name in entry.CORE]
CASES = [(name, query, m.SQL.get(name)) for m in CORE for name, query in m.QUERIES.items()]


@pytest.mark.parametrize("name, query, sql", CASES, ids=[c[0] for c in CASES])
def test_query(spark, name, query, sql):
    if sql is None:
        assert query(spark, SF).collect()
    else:
        _, difference = compare(spark, SF, query, sql)
        assert not difference, difference


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {q for q in entry.queries() if q.endswith("_found")} >= {"p1_found", "p3_found", "p6_found"}
