"""Every registered query runs at the smallest scale and agrees with its SQL on names."""

import os

import duckdb
import pytest

import __spark_entry__
from loomscribe import registry

SF = "/root/testdata/sf0.001"
#: Queries that take long at any size, and those whose rows repeat what another query here shows.
SLOW = {"resumed_run", "stream_ingest", "run_full", "run_refresh", "incremental_ingest", "cluster_pages", "cluster_sort", "edge_count", "dependency_graph", "merged_plan", "refresh_merge"}
NAMES = sorted(set(registry.SQL) - SLOW)


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for table in os.listdir(SF):
        found.execute(f"create view {table.removesuffix('.parquet')} as select * from '{SF}/{table}'")
    return found


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, cur.fetchall()))


def test_sql_names_are_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
