"""Small groups solved in tasks give the very rows of the joins: odd ids, types, limits."""

import pytest

from roadloom.operators.closure import NotConverged, closure
from roadloom.operators.paths import CELLED
from roadloom.plans.hierarchy import Options, three_passes
from roadloom.sources.network import with_cost

BIG, INF = 1 << 60, float("inf")
# Neighbouring ids and cells that one float64 stands for.
CELLS = (622203769692192767, 622203769692192768)


def chain(shift, cell, n=5):
    return [(shift + i, shift + i + 1, shift + i + 1, float(i % 3 + 1), cell) for i in range(n)]


CASES = {
    "large ids and an unparsable one": ("long", "double", chain(BIG, 7) + [(None, BIG, BIG, 1.0, 7), (BIG, None, None, 1.0, 7)]),
    "sibling cells and no cell": ("long", "double", [
        (1, 2, 2, 1.0, CELLS[0]), (2, 3, 3, 1.0, CELLS[1]), (1, 2, 2, 1.0, None), (2, 3, 3, 1.0, None), (1, 2, 9, 4.0, None), (4, 5, 5, INF, None)]),
    "int ids": ("int", "double", chain(1, 1) + chain(100, 2)),
    "float costs": ("long", "float", [(a, b, v, 0.1 * c, g) for a, b, v, c, g in chain(1, 1)]),
    "text ids": ("string", "double", [(f"n{a}", f"n{b}", f"n{v}", c, g) for a, b, v, c, g in chain(1, 1)] + [(None, "n1", None, 1.0, 1)]),
    "self arcs, no hop, no cost": ("long", "double", chain(1, 1) + [(2, 2, 2, 1.0, 1), (1, 3, None, 0.5, 1), (3, 4, 0, None, 1), (8, 9, 9, INF, 1), (8, 9, 7, None, 1)]),
    "a cycle": ("long", "double", [(i, (i + 1) % 9, (i + 1) % 9, 1.0, 3) for i in range(9)]),
    "nothing usable": ("long", "double", [(1, 1, 1, 1.0, 1), (2, 3, 3, None, 1)]),
}


def frame(spark, ids, cost, rows):
    return spark.createDataFrame(rows, f"incoming_edge {ids}, outgoing_edge {ids}, via_edge {ids}, cost {cost}, current_cell long")


def rows_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("keep", [True, False])
@pytest.mark.parametrize("case", CASES)
def test_grouped_equals_joins(spark, case, keep):
    paths = frame(spark, *CASES[case])
    want = closure(paths, CELLED, keep_unusable=keep)
    for grouped_rows in (5, 1000):
        got = closure(paths, CELLED, method="grouped", keep_unusable=keep, grouped_rows=grouped_rows)
        assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in want.schema}
        assert rows_of(got, want.columns) == rows_of(want, want.columns)


def test_round_limits_hold_for_small_groups(spark):
    line = frame(spark, "long", "double", chain(1, 1, 12))
    for rounds in (1, 2, 3):
        want = closure(line, CELLED, max_rounds=rounds, allow_partial=True)
        for grouped_rows in (5, 1000):
            got = closure(line, CELLED, method="grouped", grouped_rows=grouped_rows, max_rounds=rounds, allow_partial=True)
            assert rows_of(got, want.columns) == rows_of(want, want.columns)
    with pytest.raises(NotConverged):
        closure(line, CELLED, method="grouped", max_rounds=1)


@pytest.mark.parametrize("ids", ["long", "int"])
def test_the_default_job_keeps_every_pair(spark, ids):
    shift = BIG if ids == "long" else 0
    cell = (1 << 59) | (15 << 52)
    edges = with_cost(spark.createDataFrame(
        [(shift + i, cell, cell, 15, 1.0, 1.0) for i in range(6)], f"id {ids}, incoming_cell long, outgoing_cell long, lca_res int, length double, maxspeed double"))
    arcs = [(shift + i, shift + i + 1, shift + i + 1, 1.0) for i in range(5)] + [(None, shift, shift, None)]
    shortcuts = spark.createDataFrame(arcs, f"incoming_edge {ids}, outgoing_edge {ids}, via_edge {ids}, cost double")
    found = {}
    for grouped_rows in (0, 5, 1000):
        options = Options(downward=(15, 14, 0), upward=(0, 15), grouped_rows=grouped_rows)
        found[grouped_rows] = rows_of(three_passes(shortcuts, edges, options).shortcuts(), ["incoming_edge", "outgoing_edge", "via_edge", "cost"])
    assert len(found[0]) == 16 and found[0] == found[5] == found[1000]
