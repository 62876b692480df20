"""The registry, and a sample of its queries against their SQL at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "edges_load", "initial_shortcuts", "extend_paths_once", "best_arc_per_pair", "cell_convergence_flags",
    "cell_closure", "cell_closure_delta", "cell_closure_grouped", "closure_first_hop", "bounded_cost_pipeline",
    "cost_percentiles", "summary_report", "final_info", "run_ledger", "connected_components", "pagerank_5",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def test_every_network_query_has_sql():
    assert entry.QUERIES.keys() == entry.ORACLE.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    problem, rows, _, _ = compare(spark, con, FOLDER, name)
    assert problem is None and rows


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["incoming_edge", "outgoing_edge", "via_edge", "cost", "inside", "cell"]
