"""Checks of inputs and of estimates: cell layout, file lines, sketches, landmark bounds."""

import random

import pytest
from pyspark.sql import functions as F

from roadloom import schemas
from roadloom.operators import graph, quality, reports, sketches
from roadloom.sources.network import read_checked
from tests.test_cells import make_cell

GOOD = make_cell(3, [2, 5])
FAULTS = [
    (GOOD, None), (0, None), (None, "missing"), (GOOD | (-(1 << 63)), "top bit"), (GOOD & ~(15 << 59), "mode"), (GOOD | (2 << 59), "mode"),
    (GOOD | (1 << 56), "reserved bits"), (GOOD | (4 << 56), "reserved bits"), (make_cell(122, [1]), "base cell"), (make_cell(121, [1]), None),
    (make_cell(3, [7, 1]), "digit"), (make_cell(3, [1, 7]), "digit"), (GOOD & ~1, "finer digit"), (GOOD & ~(7 << 36), "finer digit"),
    (make_cell(4, [1]), "deleted subsequence"), (make_cell(4, [0, 0, 1, 5]), "deleted subsequence"), (make_cell(4, [0, 2, 1]), None),
    (make_cell(4, [0, 0]), None), (make_cell(4, []), None), (make_cell(5, [1]), None), (make_cell(117, [0, 1]), "deleted subsequence"),
    (make_cell(117, [0] * 14 + [1]), "deleted subsequence"), (make_cell(117, [6] + [1] * 14), None),
]


def test_cell_faults(spark):
    cells = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(FAULTS)], "id long, c long")
    got = {r.id: r.fault for r in cells.select("id", quality.cell_fault("c").alias("fault")).collect()}
    assert [got[i] for i in range(len(FAULTS))] == [fault for _, fault in FAULTS]
    counted = quality.fault_counts(cells, ["c"]).collect()
    names = [fault for _, fault in FAULTS if fault]
    assert {(r.column_name, r.reason): r.rows for r in counted} == {("c", n): names.count(n) for n in names}


def test_checked_files(spark, tmp_path):
    text = hex(GOOD)[2:]
    lines = {
        "a.csv": ["id,lca_res,incoming_cell,outgoing_cell,length,maxspeed", f"1,2,{text},{GOOD},5,50", f' 2 ,"2", {text.upper()} ,,5.5,', "", "id,lca_res,incoming_cell,outgoing_cell,length,maxspeed",
                  f"3,2,{text},{GOOD},5", f"x,2,{text},{GOOD},5,50", f",2,{text},{GOOD},5,50", f"4,2,{text}z,{GOOD},5,50", f"5,2,{text},{GOOD - 1},5,50", f"6,2,{text},{GOOD},5,fast,7"],
        "b.csv": ["id,lca_res,incoming_cell,outgoing_cell,length,maxspeed", f"7,1.5,{text},{GOOD},5,50", f"8,1,0,0,,"],
    }
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    accepted, rejected = read_checked(spark, str(tmp_path))
    assert accepted.schema.simpleString() == "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schemas.EDGES) + ">"
    assert {r.id: (r.incoming_cell, r.outgoing_cell, r.lca_res, r.length, r.maxspeed) for r in accepted.collect()} == {
        1: (GOOD, GOOD, 2, 5.0, 50.0), 2: (GOOD, None, 2, 5.5, None), 8: (0, 0, 1, None, None)}
    a, b = lines["a.csv"], lines["b.csv"]
    assert {(r.line, r.column_name, r.reason) for r in rejected.collect()} == {
        (a[0], None, "header"), (a[5], None, "fields"), (a[6], "id", "number"), (a[7], "id", "missing"), (a[8], "incoming_cell", "cell"),
        (a[9], "outgoing_cell", "layout"), (a[10], None, "fields"), (b[1], "lca_res", "number")}
    assert rejected.count() == 8


@pytest.fixture(scope="module")
def shortcuts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30_000):
        base = rng.choice([1, 1, 1, 2, 9])
        cell = make_cell(base, [rng.randrange(3), rng.randrange(4)][: rng.randrange(3)])
        rows.append((rng.randrange(900), rng.randrange(5000), rng.randrange(40), float(rng.choice([1, 1, 1, rng.randrange(10_000)])), cell))
    rows += [(None, 1, 1, None, None)] * 3
    return spark.createDataFrame(rows, "incoming_edge long, outgoing_edge long, via_edge long, cost double, cell long").cache()


def test_sketches_keep_their_bounds_when_merged(shortcuts):
    from roadloom.functions.cells import ancestor

    stored = sketches.cell_sketches(shortcuts)
    for res in (1, 0, -1):
        merged = sketches.merged_up(stored, res)
        ranks = sketches.rank_check(shortcuts, sketches.quantiles(merged), ancestor("cell", res)).collect()
        cells = shortcuts.select(ancestor("cell", res).alias("c")).where("c is not null").distinct().count()
        assert len(ranks) == cells * len(reports.PERCENTILES) and all(r.within_bound for r in ranks)
        counts = sketches.distinct_check(shortcuts, sketches.distinct_counts(merged), ancestor("cell", res)).collect()
        assert all(r.within_bound for r in counts) and {r.role for r in counts} == set(sketches.EDGES)
    whole = sketches.merged_all(stored)
    assert whole.first().rows == shortcuts.count()
    none = F.lit(None).cast("long")
    wrong = sketches.quantiles(whole).withColumn("estimate", F.col("estimate") + 3000)
    checked = sketches.rank_check(shortcuts, wrong, none).collect()
    # The highest percentile has no room above it.
    assert len(checked) == 7 and not any(r.within_bound for r in checked if r.share < 0.99)
    off = sketches.distinct_counts(whole).withColumn("estimate", (F.col("estimate") * 2).cast("long"))
    assert not any(r.within_bound for r in sketches.distinct_check(shortcuts, off, none).collect())


def test_distinct_edges(shortcuts):
    row = reports.distinct_edges(shortcuts).first()
    assert tuple(row) == tuple(shortcuts.select(*[F.count_distinct(c) for c in sketches.EDGES]).first())
    assert "Expand" not in reports.distinct_edges(shortcuts)._jdf.queryExecution().executedPlan().toString()


def test_landmark_bounds_never_exceed_the_distance(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    vertices = spark.createDataFrame([(i,) for i in range(42)], "id long")
    frame = spark.createDataFrame(edges, "src long, dst long")
    maps = graph.distance_maps(graph.landmark_distances(vertices, frame, [3, 11, 20]))
    true = {(r.id, r.landmark): r.distance for r in graph.landmark_distances(vertices, frame, list(range(0, 40, 4))).collect()}
    pairs = [(i, t) for i in range(42) for t in range(0, 40, 4)]
    found = graph.distance_bounds(spark.createDataFrame(pairs, "id long, target long"), maps).collect()
    assert len(found) == len(pairs)
    for r in found:
        distance = true.get((r.id, r.target))
        if distance is not None:
            assert r.reachable and 0 <= r.bound <= distance
        assert (r.bound is None) == (not r.reachable)
    assert any(r.bound and r.bound > 1 for r in found) and any(not r.reachable for r in found)


def test_costs_are_counted_where_they_are(shortcuts):
    """Most costs of a large table differ: no row is moved by its cost, and the ranks are those of counted costs."""
    from roadloom.functions.cells import ancestor

    # Sketches draw lots.
    found = sketches.quantiles(sketches.merged_up(sketches.cell_sketches(shortcuts), 0)).localCheckpoint()
    ranks = sketches.rank_check(shortcuts, found, ancestor("cell", 0))
    assert "_cost" not in "".join(line for line in ranks._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    counted = sketches.rank_check(shortcuts, found, ancestor("cell", 0), few_costs=True).select(ranks.columns)
    assert sorted(map(repr, ranks.collect())) == sorted(map(repr, counted.collect()))


def test_edge_sets_stand_for_the_rows(shortcuts):
    """Coarser levels are told from the sets of the cells, which are read once."""
    from roadloom.functions.cells import ancestor

    sets = sketches.edge_sets(shortcuts).cache()
    assert sets.count() == sum(shortcuts.where(f"{role} IS NOT NULL").select("cell", role).distinct().count() for role in sketches.EDGES)
    for res in (1, -1):
        estimates = sketches.distinct_counts(sketches.merged_up(sketches.cell_sketches(shortcuts), res)).localCheckpoint()
        plain = sketches.distinct_check(shortcuts, estimates, ancestor("cell", res))
        assert sorted(map(repr, sketches.distinct_check(sets, estimates, ancestor("cell", res)).collect())) == sorted(map(repr, plain.collect()))
