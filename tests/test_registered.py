"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from pipewright.plans import demo, network_queries, oracle, queries, rule_queries, tampered

SF = "/root/testdata/sf0.001"
QUERIES = queries.QUERIES | rule_queries.QUERIES | network_queries.QUERIES | tampered.QUERIES | demo.QUERIES
SQL = oracle.ORACLE_SQL | rule_queries.ORACLE_SQL | network_queries.ORACLE_SQL | tampered.ORACLE_SQL | demo.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    left = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    right = Counter(tuple(map(plain, r)) for r in want.fetchall())
    assert left == right


def test_every_query_is_registered_once():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["plan_demo", "verify_variants", "route_detour", "dp_assign", "export_variant"])
def test_search_queries_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if name == "verify_variants":
        assert all(r["codes"] == "" for r in rows)
