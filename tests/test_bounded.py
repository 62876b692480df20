"""The bounded-cost loop: only regions that changed are closed again."""

import random

from pyspark.sql import functions as F

from roadloom.durable import durable
from roadloom.operators.closure import closure
from roadloom.operators.merge import merge_partitions
from roadloom.operators.paths import HOPPED, below_cost
from roadloom.plans import bounded

REGION = HOPPED.within("region")


def regions(spark, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(7), rng.randrange(7), float(rng.randint(1, 14)), 0, f"r{r}") for r in range(12) for _ in range(14)]
    rows = [(a, b, c, b, r) for a, b, c, _, r in rows if a != b]
    rows += [(1, 2, 50.0, 2, "dear"), (1, 2, 3.0, 2, None)]
    return spark.createDataFrame(rows, "src long, dst long, cost double, next_node long, region string")


def plain(paths, ceiling, rounds, **how):
    table = paths.select(*REGION.all)
    for _ in range(rounds):
        closed = durable(closure(below_cost(table, ceiling), REGION, **how).select(*REGION.all))
        table = durable(merge_partitions(table, closed, REGION.groups))
    return table


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_rows_as_closing_every_region_each_time(spark):
    paths = regions(spark).where("region is not null")
    for how in (dict(hop_rule="first"), dict()):
        got = bounded.bounded_cost_pipeline(paths, REGION, 10, **how)
        assert rows_of(got) == rows_of(plain(paths, 10, 3, **how)), how


def test_settled_regions_are_not_closed_again(spark, monkeypatch):
    closed = []
    original = bounded.region_closure

    def watched(paths, columns, **how):
        closed.append({r.region for r in paths.select("region").distinct().collect()})
        return original(paths, columns, **how)

    monkeypatch.setattr(bounded, "region_closure", watched)
    paths = regions(spark).where("region is not null")
    bounded.bounded_cost_pipeline(paths, REGION, 10, hop_rule="first")
    assert len(closed) == 1 and len(closed[0]) == 12 and "dear" not in closed[0]


def test_only_changed_regions_are_unsettled(spark):
    paths = durable(closure(regions(spark), REGION).select(*REGION.all))
    left = durable(bounded.region_digests(paths, REGION))
    assert bounded.unsettled(paths.repartition(5, "src"), left, REGION).where("region is not null").count() == 0
    other = paths.withColumn("cost", F.when((F.col("region") == "r3") & (F.col("src") == 1), F.col("cost") + 1).otherwise(F.col("cost")))
    assert {r.region for r in bounded.unsettled(other, left, REGION).where("region is not null").collect()} == {"r3"}
