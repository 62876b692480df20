import random

import pytest

from roadloom.operators.closure import NotConverged, closure
from roadloom.operators.paths import CELLED, HOPPED, SHORTCUT
from tests.reference_model import shortest

# Two river systems with text ids: a braided one whose side arm is the shorter way, and a loop.
RIVERS = [
    ("spring", "fork", 3.0, "fork", "north"), ("fork", "mill", 8.0, "mill", "north"), ("fork", "arm", 2.0, "arm", "north"),
    ("arm", "mill", 1.0, "mill", "north"), ("mill", "sea", 4.0, "sea", "north"),
    ("lake", "weir", 1.0, "weir", "south"), ("weir", "lake", 2.0, "lake", "south"),
]


def river_costs():
    return {pair: cost for system in ("north", "south")
            for pair, cost in shortest([(a, b, c) for a, b, c, _, s in RIVERS if s == system]).items()}


WAYS = [
    dict(method="stepwise"), dict(method="doubling"), dict(method="grouped"),
    dict(method="doubling", hop_rule="middle"), dict(method="stepwise", hop_rule="first"),
    dict(method="stepwise", growth=1), dict(method="stepwise", growth=1, hot_rows=2),
    dict(method="stepwise", growth=2, hot_rows=2), dict(method="stepwise", growth=1, most_layers=0, hot_rows=3), dict(method="doubling", hot_rows=2), dict(method="grouped", grouped_rows=30),
]


def celled(spark, rows):
    return spark.createDataFrame(
        rows, "incoming_edge long, outgoing_edge long, via_edge long, cost double, current_cell long"
    )


def random_cells(seed, cells=6, nodes=9, arcs=22):
    rng = random.Random(seed)
    rows = []
    for cell in range(cells):
        for _ in range(arcs):
            a, b = rng.randrange(nodes), rng.randrange(nodes)
            cost = rng.choice([None, float("inf")] + [float(rng.randint(0, 9)) for _ in range(12)])
            rows.append((a, b, b, cost, cell))
    return rows


def rivers(spark):
    return spark.createDataFrame(RIVERS, "src string, dst string, cost double, next_node string, river string")


@pytest.mark.parametrize("method", ["stepwise", "doubling", "grouped"])
def test_text_ids_in_two_groups(spark, method):
    closed = closure(rivers(spark), HOPPED.within("river"), method=method).collect()
    assert {(r.src, r.dst): r.cost for r in closed} == river_costs()
    assert {r.river for r in closed if r.src in ("lake", "weir")} == {"south"}
    assert river_costs()["spring", "sea"] == 10.0


def test_first_hop_is_kept(spark):
    closed = closure(rivers(spark), HOPPED.within("river"), hop_rule="first").collect()
    hops = {(r.src, r.dst): r.next_node for r in closed}
    assert hops["spring", "sea"] == "fork" and hops["fork", "sea"] == "arm" and hops["lake", "weir"] == "weir"


def test_a_grid(spark):
    """Right and up, each step dearer with the row: the cheapest way goes right first."""
    side, at = 5, lambda x, y: 10 * y + x
    arcs = [(at(x, y), at(x + 1, y), at(x + 1, y), 1.0 + y, 1) for x in range(side - 1) for y in range(side)]
    arcs += [(at(x, y), at(x, y + 1), at(x, y + 1), 1.0, 1) for x in range(side) for y in range(side - 1)]
    closed = closure(celled(spark, arcs)).collect()
    assert {(r.incoming_edge, r.outgoing_edge): r.cost for r in closed} == {
        (at(x, y), at(u, v)): (u - x) * (1.0 + y) + (v - y)
        for x in range(side) for y in range(side) for u in range(x, side) for v in range(y, side) if (x, y) != (u, v)
    }


@pytest.mark.parametrize("way", WAYS, ids=str)
def test_random_cells_match_dijkstra(spark, way):
    rows = random_cells(7)
    closed = closure(celled(spark, rows), **way).collect()
    assert len({(r.current_cell, r.incoming_edge, r.outgoing_edge) for r in closed}) == len(closed)
    got = {(r.current_cell, r.incoming_edge, r.outgoing_edge): r.cost for r in closed}
    want = {}
    for cell in {row[4] for row in rows}:
        arcs = [(a, b, cost) for a, b, _, cost, c in rows if c == cell and a != b]
        want |= {(cell, a, b): cost for (a, b), cost in shortest(arcs).items()}
    assert got == want
    for r in closed:
        if r.via_edge not in (r.outgoing_edge, r.incoming_edge) and way.get("hop_rule") != "first":
            left = got[r.current_cell, r.incoming_edge, r.via_edge]
            assert left + got[r.current_cell, r.via_edge, r.outgoing_edge] == r.cost


def test_grouped_and_stepwise_agree_on_hops(spark):
    rows = [(a, b, via, None if cost is None else cost + 1, cell) for a, b, via, cost, cell in random_cells(3)]
    frame = celled(spark, rows)
    stepwise = closure(frame, method="stepwise")
    grouped = closure(frame, method="grouped").select(stepwise.columns)
    assert sorted(stepwise.collect()) == sorted(grouped.collect())


@pytest.mark.parametrize("how", [
    dict(method="stepwise"), dict(method="grouped"), dict(method="stepwise", growth=0, most_layers=0)], ids=str)
def test_unusable_rows_are_kept_until_replaced(spark, how):
    inf = float("inf")
    rows = [(1, 2, 2, 1.0, 0), (2, 3, 3, 1.0, 0), (1, 3, 3, inf, 0), (3, 4, 4, None, 0), (4, 5, 5, inf, 0)]
    kept = closure(celled(spark, rows), keep_unusable=True, **how).collect()
    assert {(r.incoming_edge, r.outgoing_edge): r.cost for r in kept} == {
        (1, 2): 1.0, (2, 3): 1.0, (1, 3): 2.0, (3, 4): None, (4, 5): inf
    }
    dropped = closure(celled(spark, rows), **how).collect()
    assert {(r.incoming_edge, r.outgoing_edge) for r in dropped} == {(1, 2), (2, 3), (1, 3)}


@pytest.mark.parametrize("method", ["stepwise", "grouped"])
def test_facts_about_the_ends_are_inherited(spark, method):
    big = 622203769692192767
    rows = [(1, 2, 2, 1.0, 0, big, None), (2, 3, 3, 1.0, 0, None, big + 2)]
    frame = spark.createDataFrame(
        rows, "incoming_edge long, outgoing_edge long, via_edge long, cost double, current_cell long, "
        "source_cell long, target_cell long")
    closed = closure(frame, method=method, about_source=["source_cell"], about_target=["target_cell"])
    found = {(r.incoming_edge, r.outgoing_edge): (r.source_cell, r.target_cell) for r in closed.collect()}
    assert found == {(1, 2): (big, None), (2, 3): (None, big + 2), (1, 3): (big, big + 2)}


def test_round_limit(spark):
    line = celled(spark, [(i, i + 1, i + 1, 1.0, 0) for i in range(12)])
    with pytest.raises(NotConverged):
        closure(line, max_rounds=3)
    with pytest.raises(NotConverged):
        closure(line, growth=1, most_layers=0, max_rounds=3)
    assert closure(line, growth=1, max_rounds=3, allow_partial=True).agg({"cost": "max"}).first()[0] == 4.0
    assert closure(line, max_rounds=0, allow_partial=True).count() == 12
    assert closure(line, method="doubling", hop_rule="middle", max_rounds=2, allow_partial=True).agg(
        {"cost": "max"}).first()[0] == 4.0


def test_closing_twice_changes_no_cost(spark):
    frame = celled(spark, random_cells(11))
    once = closure(frame)
    costs = lambda df: sorted(df.drop("via_edge").collect())
    assert costs(closure(once)) == costs(once)


def test_empty_input(spark):
    for way in WAYS:
        assert closure(celled(spark, []), **way).count() == 0


def test_one_hub_with_a_third_of_the_arcs(spark):
    rows = [(0, b, b, 1.0, 0) for b in range(1, 60)] + [(a, 0, 0, 1.0, 0) for a in range(1, 60)]
    closed = closure(celled(spark, rows), hot_rows=7)
    assert closed.count() == 60 * 59
    assert closed.where("cost = 2").count() == 59 * 58


def test_no_group_columns(spark):
    rows = [(1, 2, 2, 1.0, 0), (2, 3, 3, 1.0, 1)]
    closed = closure(celled(spark, rows).drop("current_cell"), SHORTCUT)
    assert closed.where("incoming_edge = 1 and outgoing_edge = 3").first().cost == 2.0
    assert closure(celled(spark, rows), CELLED).count() == 2


IN_TASKS = [dict(method=method, hop_rule=rule) for method in ("stepwise", "doubling") for rule in ("last", "first", "middle")]


@pytest.mark.parametrize("way", IN_TASKS, ids=str)
def test_rounds_in_tasks_give_the_rows_of_the_joins(spark, way):
    """Small groups are closed where they lie, larger ones and unusable rows as before: no row differs."""
    rows = [(a, b, via, None if cost is None else cost + 1, cell) for a, b, via, cost, cell in random_cells(5)]
    rows += [(i, i + 1, i + 1, 1.0, 99) for i in range(30)] + [(29, 0, None, 2.0, 99), (1, 2, 2, 1.0, None), (2, 3, 3, 1.0, None)]
    frame = celled(spark, rows)
    want = closure(frame, keep_unusable=True, in_task_from=None, **way)
    for most in (1_000, 25):
        got = closure(frame, keep_unusable=True, in_task_from=0, grouped_rows=most, **way).select(want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("way", [dict(method="stepwise"), dict(method="doubling", hop_rule="middle")], ids=str)
def test_rounds_of_small_groups_do_not_shuffle(spark, way, monkeypatch):
    """A table of many small groups is closed without a join, however its method is named."""
    from roadloom.operators import closure as module

    def joined(*_, **__):
        raise AssertionError("a small group was closed by joins")

    monkeypatch.setattr(module, "meeting_join", joined)
    frame = spark.range(module.IN_TASK_FROM).selectExpr(
        "id AS incoming_edge", "id div 4 * 4 + (id + 1) % 4 AS outgoing_edge", "id AS via_edge", "1.0D AS cost", "id div 4 AS current_cell")
    assert closure(frame, **way).count() == 3 * module.IN_TASK_FROM


@pytest.mark.parametrize("slice_pairs", [10**9, 40])
def test_a_group_beyond_one_task_is_dealt_out_by_source(spark, slice_pairs, monkeypatch):
    """Large groups are closed without a join of paths, with the rows of the joins; ties, unread ends and null hops included."""
    from roadloom.operators import closure as module

    rows = [(a, b, via, None if cost is None else cost + 1, cell) for a, b, via, cost, cell in random_cells(8)]
    rows += [(i, i + 1, i + 1, 1.0, 99) for i in range(30)] + [(29, 0, None, 2.0, 99), (1, 2, 2, 1.0, None), (None, 3, 3, 1.0, 99)]
    frame = celled(spark, rows)
    want = closure(frame, keep_unusable=True, in_task_from=None)
    monkeypatch.setattr(module, "SLICE_PAIRS", slice_pairs)
    monkeypatch.setattr(module, "BUCKET_PAIRS", 200)
    monkeypatch.setattr(module, "meeting_join", None)
    for way in (dict(method="grouped", grouped_rows=5), dict(method="grouped", grouped_rows=0), dict(in_task_from=0, grouped_rows=5)):
        got = closure(frame, keep_unusable=True, **way).select(want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_groups_too_large_to_be_copied_go_through_the_joins(spark):
    frame = celled(spark, random_cells(9) + [(i, i + 1, i + 1, 1.0, 99) for i in range(30)])
    want = closure(frame, in_task_from=None)
    got = closure(frame, method="grouped", grouped_rows=2, sliced_rows=20).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_small_groups_are_closed_by_more_tasks_than_their_bytes_ask_for(spark, monkeypatch):
    """Their rounds take long for few bytes: a partition holds about one call's rows, whatever is put together elsewhere."""
    from roadloom.operators import closure as module

    monkeypatch.setattr(module, "BUCKET_ARCS", 10)
    frame = spark.range(200).selectExpr(
        "id AS incoming_edge", "id div 4 * 4 + (id + 1) % 4 AS outgoing_edge", "id AS via_edge", "1.0D AS cost", "id div 4 AS current_cell")
    closed = closure(frame, method="grouped")
    assert closed.rdd.getNumPartitions() == 21 and closed.count() == 600


PLACED_WAYS = [dict(), dict(method="doubling", hop_rule="middle"), dict(method="grouped", grouped_rows=20), dict(hop_rule="first")]


@pytest.mark.parametrize("way", PLACED_WAYS, ids=str)
def test_placed_groups_have_the_rows_of_the_joins(spark, way, monkeypatch):
    """Many calls in a partition, groups across batches, large groups and rows without a group included."""
    from roadloom.operators import closure as module

    rows = random_cells(8) + [(i, i + 1, i + 1, 1.0, 99) for i in range(30)] + [(1, 2, 2, 1.0, None), (1, 2, 1, 1.0, None), (None, 3, 3, 1.0, 99)]
    frame = celled(spark, rows)
    want = closure(frame, in_task_from=None, **({**way, "method": "stepwise"} if way.get("method") == "grouped" else way))
    monkeypatch.setattr(module, "BUCKET_ARCS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = closure(frame.repartition(2, "current_cell"), placed=True, **way).select(want.columns).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect()))


def test_placed_groups_are_stored_once_and_not_shuffled(spark, monkeypatch):
    """Rows that lie by their groups are closed there; what is stored on the way is the result itself."""
    from roadloom.durable import stored_at
    from roadloom.operators import closure as module

    plans, write = [], module.write_and_read
    monkeypatch.setattr(module, "write_and_read", lambda df, path, **told: plans.append(df) or write(df, path, **told))
    arcs = spark.range(400).selectExpr(
        "id AS incoming_edge", "id div 4 * 4 + (id + 1) % 4 AS outgoing_edge", "id AS via_edge", "1.0D AS cost", "id div 4 AS current_cell")
    closed = closure(arcs.repartition(3, "current_cell"), placed=True)
    assert closed.count() == 1200 and len(plans) == 1 and stored_at(closed) and stored_at(closed.select("cost")) is None
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_with_an_unread_id_are_not_held_against_the_closed_ones(spark):
    """No closed row can replace them; rows with whole keys are still replaced."""
    rows = [(1, 2, 2, 1.0, 0), (2, 3, 3, 1.0, 0), (None, 2, 2, 5.0, 0), (None, 2, 2, 4.0, 0), (1, 2, 2, 9.0, None)]
    closed = closure(celled(spark, rows), method="grouped", keep_unusable=True)
    assert "Join" not in closed._jdf.queryExecution().executedPlan().toString()
    whole = {(1, 2, 2, 1.0, 0), (2, 3, 3, 1.0, 0), (1, 3, 2, 2.0, 0)}
    beside = {(None, 2, 2, 4.0, 0), (1, 2, 2, 9.0, None)}
    names = ["incoming_edge", "outgoing_edge", "via_edge", "cost", "current_cell"]
    assert {tuple(r[n] for n in names) for r in closed.collect()} == whole | beside
    unusable = [(1, 3, 3, None, 0), (3, 1, 1, None, 0)]
    closed = closure(celled(spark, rows + unusable), method="grouped", keep_unusable=True)
    assert {tuple(r[n] for n in names) for r in closed.collect()} == whole | beside | {(3, 1, 1, None, 0)}


def test_groups_beyond_the_cells_of_one_call_are_spread(spark, monkeypatch):
    """A call has a cell per possible pair, so it takes no larger group than that allows."""
    from roadloom.operators import closure as module

    frame = celled(spark, random_cells(3))
    want = sorted(map(repr, closure(frame, method="grouped", grouped_rows=10**9).collect()))
    monkeypatch.setattr(module, "MOST_GROUPED_ROWS", 5)
    assert sorted(map(repr, closure(frame, method="grouped", grouped_rows=10**9).collect())) == want


def test_any_number_of_pairs_is_dealt_out_by_source(spark, monkeypatch):
    """A group whose rows fit a task never goes through the joins, however many pairs it makes."""
    from roadloom.operators import closure as module

    frame = celled(spark, random_cells(9) + [(i, i + 1, i + 1, 1.0, 99) for i in range(30)])
    want = closure(frame, in_task_from=None)
    monkeypatch.setattr(module, "SLICED_PAIRS", 10, raising=False)
    monkeypatch.setattr(module, "FEW_SLICES", 3, raising=False)
    monkeypatch.setattr(module, "SLICE_PAIRS", 10)
    monkeypatch.setattr(module, "meeting_join", None)
    got = closure(frame, method="grouped", grouped_rows=2).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("cells, chains, returned", [(10**7, 10**6, 10**6), (60, 40, 30), (1, 1, 1)])
def test_blocks_of_sources_make_the_rows_of_one_call(monkeypatch, cells, chains, returned):
    """Ties, cycles of no cost, several arcs of a pair and nodes without arcs in or out, in blocks of any size."""
    import numpy as np
    import pyarrow as pa

    from roadloom.operators import closure as module

    monkeypatch.setattr(module, "SOURCE_CELLS", cells)
    monkeypatch.setattr(module, "SWEEP_CHAINS", chains)
    monkeypatch.setattr(module, "RETURNED_ROWS", returned)
    names = ["incoming_edge", "outgoing_edge", "via_edge", "cost", "current_cell"]
    solver = module._Solver(CELLED, (), (), (), ())
    rows_of = lambda table: sorted(zip(*(table[name].to_pylist() for name in names)))
    for seed in range(8):
        rng = random.Random(seed)
        nodes, least = rng.randint(3, 30), rng.choice([0, 1])
        rows = [(rng.randrange(nodes) * 3, rng.randrange(nodes) * 3, rng.randrange(99), float(rng.randint(least, 6)), 7) for _ in range(90)]
        table = pa.table(dict(zip(names, zip(*[r for r in rows if r[0] != r[1]]))))
        blocks = list(solver._solve_sources(table.append_column("_own", pa.array(np.ones(len(table), bool))), names))
        assert rows_of(pa.concat_tables(blocks)) == rows_of(solver._solve(table, names))


def test_a_long_ring_is_swept_a_few_times(monkeypatch):
    """The order follows the arcs, not the numbers of the nodes: a path of hundreds of arcs takes no round for each of them."""
    import numpy as np
    import pyarrow as pa

    from roadloom.operators import closure as module

    n = 1200
    name = np.random.default_rng(3).permutation(n)
    start = np.repeat(np.arange(n), 2)
    end = (start + np.tile([5, 11], n)) % n
    table = pa.table({
        "incoming_edge": name[start], "outgoing_edge": name[end], "via_edge": name[end], "cost": np.ones(2 * n), "current_cell": np.zeros(2 * n, np.int64)})
    sweeps = module._Sweeps(module._Numbered(table, CELLED), 50)
    looked_at, chains = [], sweeps._chains
    monkeypatch.setattr(sweeps, "_chains", lambda best, batch: looked_at.append(batch) or chains(best, batch))
    best = sweeps.closed(np.arange(50))
    assert np.isfinite(best[:n]).sum() == 50 * (n - 1) and best[:n][np.isfinite(best[:n])].max() > 100
    assert len(looked_at) < 6 * len(sweeps.batches)
