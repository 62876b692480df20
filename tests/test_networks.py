"""The derived networks hold every row of their tables."""

import re

import pytest
from pyspark.sql import functions as F

from workloads.networks import Networks
from workloads.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def networks(spark):
    return Networks(spark, FOLDER)


def test_every_order_line_is_a_line(networks):
    lines = networks.order_lines
    assert lines.count() == networks.tables.lineitem.count() == lines.select("line").distinct().count()


def test_orders_are_cycles(networks):
    arcs = networks.consecutive.collect()
    lines = {}
    for r in networks.order_lines.collect():
        lines.setdefault(r.l_orderkey, []).append(r.line)
    for order, own in lines.items():
        n, own = len(own), sorted(own)
        got = sorted((r.line, r.next_line) for r in arcs if r.l_orderkey == order) if order % 50 == 0 else None
        if got is not None:
            want = [(own[i], own[i + g]) for g in (1, 2) for i in range(n - g)] + ([(own[-1], own[0])] if n > 1 else [])
            assert got == sorted(want)


@pytest.mark.parametrize("name", ["best_arc_per_pair", "best_path_window", "changed_rows", "min_cost_per_pair"])
def test_paths_of_placed_groups_are_extended_where_they_lie(spark, tmp_path, name):
    """The lines of an order lie together once they are numbered: nothing but the line items is shuffled."""
    spark.createDataFrame(
        [(1, n, n, 1, 1.0 * n, 1.0, "N") for n in range(1, 4)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert shuffles and all(re.search(r"hashpartitioning\(l_orderkey#\d+L, ", line) for line in shuffles), shuffles


@pytest.mark.parametrize("name", ["best_path_joinback", "changed_rows", "best_arc_per_pair", "cell_convergence_flags"])
def test_lines_are_numbered_once(spark, name):
    """Queries that read the line arcs several times read them from storage, and rank the paths where they lie."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "row_number" not in plan
    assert "incoming_edge#" in plan and not re.search(r"Exchange hashpartitioning\(incoming_edge", plan)


def test_dealt_lines_are_the_lines_in_whole_orders(spark, networks, monkeypatch):
    """As many partitions as the lines ask for, each order in one of them; each column is shuffled once."""
    from workloads import networks as module

    monkeypatch.setattr(module, "LINES_AT_ONCE", 1000)
    dealt, lines = networks.dealt_lines, networks.lines
    assert dealt.rdd.getNumPartitions() == networks.tables.lineitem.count() // 1000 + 1
    assert dealt.exceptAll(lines).isEmpty() and lines.exceptAll(dealt).isEmpty()
    placed = dealt.select("l_orderkey", F.spark_partition_id().alias("part")).distinct()
    assert placed.count() == placed.select("l_orderkey").distinct().count()


def test_closed_lines_are_not_written_twice(spark, monkeypatch):
    from workloads import queries as module

    def written(*_, **__):
        raise AssertionError("the closed lines were stored a second time")

    monkeypatch.setattr(module, "_stored", {})
    monkeypatch.setattr(module.store, "write_shortcuts", written)
    assert module.closed_lines(Networks(spark, FOLDER)).count()


def test_reports_read_the_published_table_from_the_run(spark, tmp_path):
    """The shortcuts of a run are stored once: no report writes them again."""
    from workloads import queries

    spark.range(60).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(240).selectExpr("id % 60 AS l_suppkey", "CAST(id % 7 + 1 AS DOUBLE) AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    stats = QUERIES["cell_stats"](spark, str(tmp_path))
    read = {name.split("/")[-2].split("-")[0] for name in stats.inputFiles()}
    assert read == {"shortcuts"}
    want = QUERIES["hierarchical_shortcuts"](spark, str(tmp_path))
    got = queries.final_suppliers(Networks(spark, str(tmp_path))).select(want.columns)
    assert got.count() == sum(r.shortcut_count for r in stats.collect()) > 500
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
