"""Closing what is closed already: the same rows as without that knowledge, for less work."""

import random

import pytest
from pyspark.sql import functions as F

from roadloom.operators import closure as closing
from roadloom.operators.closure import Closed, closure
from roadloom.operators.skew import GRID_COLUMN, GRID_ROW, grid_of, meeting_join, onto_grid
from roadloom.plans.hierarchy import Options, Run, three_passes
from tests.test_hierarchy import SMALL, frames, random_network

SCHEMA = "incoming_edge long, outgoing_edge long, via_edge long, cost double, current_cell long"
MARKS = [Closed("was_in", "was_step")]


def random_arcs(seed, cells=4, nodes=10, arcs=26):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes), b, float(rng.randint(0, 12)), c)
            for c in range(cells) for b in rng.choices(range(nodes), k=arcs)]


def all_rows(df):
    return sorted(map(tuple, df.select(*SCHEMA.replace(" long", "").replace(" double", "").split(", ")).collect()))


def marked(before, closed, new):
    """A closed table with marks, and new rows without them; of one pair the cheaper row stays."""
    arcs = before.groupBy("incoming_edge", "outgoing_edge", "current_cell").agg(F.min("cost").alias("was"))
    known = closed.join(arcs, ["incoming_edge", "outgoing_edge", "current_cell"], "left")
    known = known.select(
        *closed.columns, F.col("current_cell").alias("was_in"),
        F.when(F.col("was") == F.col("cost"), F.col("current_cell")).alias("was_step"))
    keys = ["incoming_edge", "outgoing_edge", "current_cell"]
    added = new.groupBy(*keys).agg(F.min("cost").alias("new_cost")).withColumn("new_via", F.col("outgoing_edge"))
    both = known.join(added, keys, "full")
    better = F.col("cost").isNull() | (F.col("new_cost") < F.col("cost"))
    return both.select(
        *keys, F.when(better, F.col("new_via")).otherwise(F.col("via_edge")).alias("via_edge"),
        F.when(better, F.col("new_cost")).otherwise(F.col("cost")).alias("cost"),
        *[F.when(~better, F.col(m)).alias(m) for m in ("was_in", "was_step")])


@pytest.mark.parametrize("how", [
    dict(method="stepwise"), dict(method="grouped", grouped_rows=20), dict(method="stepwise", growth=0, most_layers=0, hot_rows=2)], ids=str)
def test_new_rows_in_a_closed_table(spark, how):
    before = spark.createDataFrame([r for r in random_arcs(1) if r[0] != r[1]], SCHEMA)
    new = spark.createDataFrame([r for r in random_arcs(2, arcs=5) if r[0] != r[1]], SCHEMA)
    table = marked(before, closure(before), new)
    plain = closure(table.drop("was_in", "was_step"), method="stepwise")
    assert all_rows(closure(table, closed_before=MARKS, **how)) == all_rows(plain)
    # Nothing new: only the hops over what was found last can change.
    again = marked(before, closure(before), new.limit(0))
    assert all_rows(closure(again, closed_before=MARKS, **how)) == all_rows(closure(again.drop("was_in", "was_step")))


@pytest.mark.parametrize("seed, options", [
    (22, dict(distributed_resolutions=(-1, 0, 1, 2))), (23, dict(grouped_rows=15)),
])
def test_passes_with_and_without_what_is_known(spark, monkeypatch, seed, options):
    edges, shortcuts = frames(spark, *random_network(seed, nodes=14, edges=44))
    seeded = three_passes(shortcuts, edges, Options(**SMALL, **options))
    with_knowledge = sorted(map(tuple, seeded.shortcuts().collect()), key=repr)
    monkeypatch.setattr(Run, "_known_closings", lambda self, res: [])
    plain = three_passes(shortcuts, edges, Options(**SMALL, **options))
    assert with_knowledge == sorted(map(tuple, plain.shortcuts().collect()), key=repr)
    assert [tuple(r) for r in seeded.ledger_table().collect()] == [tuple(r) for r in plain.ledger_table().collect()]


def counted(monkeypatch):
    """The rows of every chain that a closure joins from now on."""
    made = []
    original = closing._Relaxation.chain

    def chain(self, left, right, *extra, **how):
        made.append(original(self, left, right, *extra, **how).count())
        return original(self, left, right, *extra, **how)

    monkeypatch.setattr(closing._Relaxation, "chain", chain)
    return made


def test_candidates_are_bounded_by_changes(spark, monkeypatch):
    nodes = 24
    ring = [(i, (i + 1) % nodes, (i + 1) % nodes, 2.0, 0) for i in range(nodes)]
    closed = closure(closure(spark.createDataFrame(ring, SCHEMA))).cache()
    assert closed.count() == nodes * (nodes - 1)
    settled = closed.withColumns({"was_in": F.col("current_cell"), "was_step": F.col("current_cell")})
    made = counted(monkeypatch)
    assert all_rows(closure(settled, closed_before=MARKS)) == all_rows(closed)
    assert sum(made) == 0
    # One pair gets cheaper: a few rows change, and each meets at most all rows that touch its ends.
    shorter = (F.col("incoming_edge") == 0) & (F.col("outgoing_edge") == 12)
    changed = settled.withColumn("cost", F.when(shorter, 1.0).otherwise(F.col("cost"))).withColumns(
        {m: F.when(~shorter, F.col(m)) for m in ("was_in", "was_step")})
    made.clear()
    result = closure(changed, closed_before=MARKS)
    improved = result.join(closed.withColumnRenamed("cost", "was").drop("via_edge"), ["incoming_edge", "outgoing_edge", "current_cell"]).where("cost < was").count()
    assert 0 < improved < closed.count() / 2
    # Costs and hops, each changed row on both sides.
    assert sum(made) <= improved * 2 * nodes * 2
    made.clear()
    assert all_rows(closure(changed.drop("was_in", "was_step"))) == all_rows(result)
    assert sum(made) > nodes * nodes * nodes


def test_a_node_with_a_third_of_all_rows_in_and_out(spark):
    """Such a node is split on both sides; no slot gets many more pairs than asked for."""
    left = spark.range(3000).selectExpr("id AS a", "IF(id % 3 = 0, 0, id % 500) AS k")
    right = spark.range(2400).selectExpr("IF(id % 3 = 0, 0, id % 400) AS k", "id AS b")
    plain = left.join(right, "k")
    side = 100
    split = meeting_join(left, right, ["k"], ["a"], ["b"], side)
    assert sorted(map(tuple, split.select("k", "a", "b").collect())) == sorted(map(tuple, plain.select("k", "a", "b").collect()))
    hubs = grid_of(left, right, ["k"], side)
    assert [r.k for r in hubs.collect()] == [0]
    on_left, on_right = onto_grid(left, right, hubs, ["k"], ["a"], ["b"])
    slots = on_left.join(on_right, ["k", GRID_ROW, GRID_COLUMN]).groupBy("k", GRID_ROW, GRID_COLUMN).count()
    largest = slots.agg(F.max("count")).first()[0]
    assert largest <= 2 * side * side < plain.groupBy("k").count().agg(F.max("count")).first()[0] / 20
    # A side with few rows is copied, the other one is split for it.
    few = right.where("b < 30")
    hubs = grid_of(left, few, ["k"], side).collect()
    assert [(r.k, r._grid_rows, r._grid_columns) for r in hubs] == [(0, 2, 1)]


@pytest.mark.parametrize("rule, method", [("last", "stepwise"), ("first", "stepwise"), ("middle", "doubling")])
def test_hop_rules_at_a_hub(spark, rule, method):
    rows = [(0, b, b, 1.0, 0) for b in range(1, 40)] + [(a, 0, 0, 1.0, 0) for a in range(1, 40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    split = closure(frame, method=method, hop_rule=rule, hot_rows=5)
    assert all_rows(split) == all_rows(closure(frame, method=method, hop_rule=rule))
