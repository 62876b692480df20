import random
from math import inf

import pytest
from pyspark.sql import functions as F

from roadloom.durable import fresh_path
from roadloom.operators import celled
from roadloom.operators.merge import merge_partitions, merge_shortcuts
from roadloom.plans.hierarchy import Options, Run, cell_methods, resolution_step, single_resolution, three_passes
from roadloom.sources.network import initial_shortcuts
from tests.reference_model import shortest
from tests.test_cells import make_cell

EDGE_SCHEMA = "id long, incoming_cell long, outgoing_cell long, lca_res int, cost double"
SMALL = dict(downward=(3, 2, 1, 0), upward=(0, 1, 2, 3))


def random_network(seed, nodes=12, edges=34):
    """Edges between nodes of a three-level hierarchy, and the arcs that follow each other."""
    rng = random.Random(seed)
    place = {n: (rng.randrange(2), rng.randrange(2), rng.randrange(2)) for n in range(nodes)}
    rows = []
    for i in range(edges):
        u, v = rng.randrange(nodes), rng.randrange(nodes)
        shared = -1
        for a, b in zip(place[u], place[v]):
            if a != b:
                break
            shared += 1
        cost = rng.choice([inf, None] + [float(rng.randint(1, 20)) for _ in range(12)])
        rows.append((i, u, v, shared, cost))
    arcs = [(a[0], b[0]) for a in rows for b in rows if a[2] == b[1] and a[0] != b[0]]
    return place, rows, arcs


def model(place, rows, arcs, levels):
    """The passes by their rules, on dictionaries."""
    edge = {i: (place[u], place[v], shared) for i, u, v, shared, _ in rows}
    cost = {i: c for i, *_, c in rows}
    table = {(a, b): cost[a] for a, b in arcs}

    def position(pair):
        start, end = edge[pair[0]][0], edge[pair[1]][1]
        level = -1
        for a, b in zip(start, end):
            if a != b:
                break
            level += 1
        return max(edge[pair[0]][2], edge[pair[1]][2]), start[: level + 1], level

    for res in levels:
        cells = {}
        for pair, value in table.items():
            lca, via, via_res = position(pair)
            if (lca <= 0) if res < 0 else (lca <= res <= via_res):
                cells.setdefault(via[: res + 1], []).append((*pair, value))
        for members in cells.values():
            table |= shortest(members)
    return table


def frames(spark, place, rows, arcs):
    cells = {n: make_cell(base, [x, y]) for n, (base, x, y) in place.items()}
    edges = spark.createDataFrame([(i, cells[u], cells[v], s, c) for i, u, v, s, c in rows], EDGE_SCHEMA)
    arcs = spark.createDataFrame(arcs, "incoming_edge long, outgoing_edge long")
    return edges, initial_shortcuts(arcs, edges)


def costs(df):
    rows = df.collect()
    found = {(r.incoming_edge, r.outgoing_edge): r.cost for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed, options", [
    (1, Options(**SMALL)),
    (2, Options(**SMALL, distributed_resolutions=(-1, 0, 1, 2))),
    (3, Options(**SMALL, grouped_resolutions=(0, 1, 2), grouped_rows=12)),
])
def test_three_passes_match_the_rules(spark, seed, options):
    network = random_network(seed)
    edges, shortcuts = frames(spark, *network)
    run = three_passes(shortcuts, edges, options)
    got = costs(run.shortcuts())
    assert got == model(*network, [2, 1, 0, -1, 0, 1, 2])
    exact = shortest([(a, b, network[1][a][4]) for a, b in network[2]])
    assert all(value is None or value >= exact.get(pair, 0) for pair, value in got.items())
    ledger = run.ledger_table().collect()
    assert [r.resolution for r in ledger] == [3, 2, 1, 0, -1, 0, 1, 2, 3]
    assert ledger[0].rows_in == 0 and ledger[-1].table_rows == len(got)
    for row in run.final().where("cost < 1e300 AND via_edge NOT IN (incoming_edge, outgoing_edge)").collect():
        left, right = got[row.incoming_edge, row.via_edge], got[row.via_edge, row.outgoing_edge]
        assert left is None or right is None or left + right <= row.cost


def test_single_steps_and_snapshots(spark):
    network = random_network(4)
    edges, shortcuts = frames(spark, *network)
    assert costs(resolution_step(shortcuts, edges, 1)) == model(*network, [1])
    step = costs(single_resolution(shortcuts, edges, 1))
    assert step.items() <= model(*network, [1]).items()
    path = fresh_path(spark, "snapshots")
    Run.start(shortcuts, edges, Options(**SMALL, snapshots=path)).downward()
    stored = spark.read.parquet(path)
    assert {r.resolution for r in stored.select("resolution").distinct().collect()} <= {0, 1, 2}
    assert {r.pass_name for r in stored.select("pass_name").distinct().collect()} == {"down"}


def test_unknown_edges_stay_once(spark):
    edges = spark.createDataFrame([(1, make_cell(0, [1]), make_cell(1, [1]), -1, 2.0)], EDGE_SCHEMA)
    shortcuts = spark.createDataFrame(
        [(8, 1, 1, 5.0), (1, 9, 9, 2.0), (8, 9, 9, 50.0)],
        "incoming_edge long, outgoing_edge long, via_edge long, cost double")
    got = costs(three_passes(shortcuts, edges, Options(**SMALL)).shortcuts())
    assert got == {(8, 1): 5.0, (1, 9): 2.0, (8, 9): 7.0}


def test_final_info(spark):
    edges = spark.createDataFrame([
        (1, make_cell(0, [1, 2]), make_cell(0, [1, 3]), 1, 1.0),
        (2, make_cell(0, [1, 3]), make_cell(0, [4, 0]), 0, 1.0),
        (3, make_cell(0, [4, 0]), make_cell(7, [0, 0]), -1, 1.0),
    ], EDGE_SCHEMA)
    shortcuts = spark.createDataFrame(
        [(1, 2, 2, 1.0), (2, 1, 1, 1.0), (1, 1, 1, 0.0), (2, 3, 3, 1.0), (1, 77, 77, 1.0)],
        "incoming_edge long, outgoing_edge long, via_edge long, cost double")
    got = {(r.incoming_edge, r.outgoing_edge): (r.inside, r.cell)
           for r in celled.add_final_info(shortcuts, edges).collect()}
    assert got == {
        (1, 2): (1, make_cell(0, [])), (2, 1): (-1, make_cell(0, [1])), (1, 1): (0, make_cell(0, [1])),
        (2, 3): (1, 0), (1, 77): (None, None),
    }
    placed = celled.add_info(shortcuts, edges)
    methods = cell_methods(placed, (1,), grouped_rows=2).collect()
    assert {(r.current_cell, r.rows, r.method) for r in methods} == {(make_cell(0, [1]), 2, "grouped")}
    assert cell_methods(placed, (1,), grouped_rows=1).first().method == "distributed"


def test_merges(spark):
    schema = "incoming_edge long, outgoing_edge long, via_edge long, cost double"
    main = spark.createDataFrame([(1, 2, 2, 5.0), (2, 3, 3, 1.0)], schema)
    new = spark.createDataFrame([(1, 2, 9, 7.0), (1, 3, 2, 6.0)], schema)
    assert costs(merge_shortcuts(main, new)) == {(1, 2): 7.0, (2, 3): 1.0, (1, 3): 6.0}
    parts = "region string, value int"
    main = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], parts)
    new = spark.createDataFrame([("a", 9), ("c", 4)], parts)
    assert sorted(merge_partitions(main, new, ["region"]).collect()) == [("a", 9), ("b", 3), ("c", 4)]


def test_the_upward_steps_leave_the_global_rows_where_they_are(spark):
    """Only the pairs of a level are read and written again; what is left of older parts stays in its files."""
    network = random_network(6)
    edges, shortcuts = frames(spark, *network)
    run = Run.start(shortcuts, edges, Options(**SMALL)).downward().global_step()
    across = run.table.where("lca_res <= 0 AND via_res < 0")
    files = {r.name for r in across.select(F.input_file_name().alias("name")).distinct().collect()}
    assert files and across.count() > 20
    run.upward()
    after = run.table.where("lca_res <= 0 AND via_res < 0")
    assert {r.name for r in after.select(F.input_file_name().alias("name")).distinct().collect()} == files
    assert costs(run.shortcuts()) == model(*network, [2, 1, 0, -1, 0, 1, 2])


def test_closed_rows_are_written_once(spark, monkeypatch):
    """Rows of infinite cost, which a path may replace, do not make a closing store its result."""
    from roadloom.operators import closure as module

    edges, shortcuts = frames(spark, *random_network(2))
    names, durable = [], module.durable
    monkeypatch.setattr(module, "durable", lambda df, name="table": names.append(name) or durable(df, name))
    options = Options(**SMALL, distributed_resolutions=(-1, 0, 1, 2))
    got = costs(three_passes(shortcuts, edges, options).shortcuts())
    assert got == model(*random_network(2), [2, 1, 0, -1, 0, 1, 2])
    assert "beside" in names and "closed" not in names
