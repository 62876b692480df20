"""Stored tables with replaced partitions, and runs that go on where they were stopped."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roadloom.durable import fresh_path
from roadloom.keyed import Layers, write_in_buckets
from roadloom.plans import hierarchy
from roadloom.plans.hierarchy import Options, three_passes
from roadloom.sources.store import VersionedTable
from tests.test_hierarchy import SMALL, frames, random_network


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("part-*.parquet")}


def test_replacing_partitions_leaves_other_files_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(k, i) for k in ("a", "b", None, "d") for i in range(5)]
    table = VersionedTable(spark, path, ["k"]).create(spark.createDataFrame(rows, "k string, v int"))
    before = files(path)
    new = [("b", 100), (None, 200), ("e", 300)]
    table.replace(spark.createDataFrame(new, "k string, v int"))
    assert before < files(path)
    written = spark.read.parquet(f"{path}/{table.layers()[-1]['rows']}")
    assert sorted(map(tuple, written.collect()), key=repr) == sorted(new, key=repr)
    want = [r for r in rows if r[0] in ("a", "d")] + new
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(want, key=repr)
    table.replace(spark.createDataFrame([("b", 7), ("a", 8)], "k string, v int"))
    want = [r for r in want if r[0] not in ("a", "b")] + [("b", 7), ("a", 8)]
    other = VersionedTable(spark, path, ["k"])
    assert sorted(map(tuple, other.read().collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, other.compact().read().collect()), key=repr) == sorted(want, key=repr)
    assert len(other.layers()) == 1
    assert table.replace(spark.createDataFrame([], "k string, v int")).read().count() == len(want)


def test_a_failed_replacement_changes_nothing(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"]).create(spark.createDataFrame([(1, 2)], "k int, v int"))
    monkeypatch.setattr(VersionedTable, "_publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.replace(spark.createDataFrame([(1, 3)], "k int, v int"))
    assert [tuple(r) for r in table.read().collect()] == [(1, 2)]


def test_a_run_goes_on_after_each_step(spark, monkeypatch):
    """The driver is lost after every single step; the last run that starts ends with the same table and ledger."""
    edges, shortcuts = frames(spark, *random_network(31, nodes=10, edges=30))
    plain = three_passes(shortcuts, edges, Options(**SMALL))
    folder = fresh_path(spark, "run")
    record = hierarchy.Run._record

    class Lost(Exception):
        pass

    def lost(self):
        record(self)
        if self.ledger:
            raise Lost

    monkeypatch.setattr(hierarchy.Run, "_record", lost)
    starts, run = 0, None
    while run is None:
        starts += 1
        try:
            run = three_passes(shortcuts, edges, Options(**SMALL, folder=folder))
        except Lost:
            assert starts < 30
    assert starts == len(plain.ledger) + 1
    assert [tuple(row) for row in run.ledger] == [tuple(row) for row in plain.ledger]
    assert sorted(map(tuple, run.final().collect()), key=repr) == sorted(map(tuple, plain.final().collect()), key=repr)
    with pytest.raises(ValueError, match="went on with"):
        hierarchy.Run.start(shortcuts, edges, Options(**SMALL, folder=folder)).upward()


def test_state_in_buckets_is_not_shuffled(spark):
    """Comparing candidates with a table in key buckets, and merging its layers, moves the candidates only."""
    keys = ["a", "b"]
    lowest = lambda df: df.groupBy(*keys).agg(F.min("c").alias("c"))
    rows = spark.range(20_000).selectExpr("id % 100 AS a", "id % 77 AS b", "CAST(id AS DOUBLE) AS c")
    table = Layers(spark, "state", keys, lowest)
    first, _ = write_in_buckets(lowest(rows), fresh_path(spark, "state"), keys)
    table.put(first, 1_000_000)
    table.add(lowest(rows.where("c > 19000")), F.expr("count(*)"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = table.without_matched(lowest(rows.where("c < 300")), "c")
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert "Exchange" not in table.merged()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert met.count() == 0
    for i in range(12):
        table.add(spark.createDataFrame([(0, i, -1.0 - i)], "a long, b long, c double"), F.expr("count(*)"))
        table.compact(F.expr("count(*)"), 3)
    assert len(table.layers) <= 4
    found = {(r.a, r.b): r.c for r in table.merged().collect()}
    assert len(found) == lowest(rows).count() and all(found[0, i] == -1.0 - i for i in range(12))
