import math

import numpy as np
import pytest

from roadloom import schemas
from roadloom.durable import fresh_path, path_exists, scratch, durable
from roadloom.operators import paths, quality, reports, sampling
from roadloom.operators.paths import CELLED, SHORTCUT
from roadloom.sources import network, store
from tests.test_cells import make_cell

CELL_ROWS = "incoming_edge long, outgoing_edge long, via_edge long, cost double, current_cell long"


@pytest.fixture(scope="module")
def shortcuts(spark):
    rows = [(i % 17, i % 23 + 100, i % 5 + (100 if i % 3 else 0), float((i * i) % 61), i % 4) for i in range(400)]
    return spark.createDataFrame(rows, CELL_ROWS)


def test_edge_file_in_any_column_order_and_both_cell_forms(spark):
    cell, other = make_cell(2, [1, 1]), make_cell(2, [1, 3])
    path = fresh_path(spark, "csv")
    rows = [("60.5", f"{cell:x}", "1", "2", "50", str(other)), ("oops", "0", "2", "-1", None, f"{cell:x}")]
    raw = spark.createDataFrame(
        rows, "length string, incoming_cell string, id string, lca_res string, maxspeed string, outgoing_cell string")
    store.write_csv(raw, path)
    full = network.read_edge_file(spark, path)
    assert full.schema == schemas.EDGES
    assert sorted(full.collect()) == [(1, cell, other, 2, 60.5, 50.0), (2, 0, cell, -1, None, None)]
    assert network.read_edges(spark, path).columns == ["id", "incoming_cell", "outgoing_cell", "lca_res"]


def test_initial_shortcuts_in_both_variants(spark):
    edges = network.with_cost(spark.createDataFrame(
        [(1, 10.0, 5.0), (2, 10.0, 0.0)], "id long, length double, maxspeed double"))
    arcs = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "incoming_edge long, outgoing_edge long")
    first = network.initial_shortcuts(arcs, edges)
    assert sorted(first.collect()) == [(1, 2, 2, 2.0), (2, 1, 1, math.inf), (3, 1, 1, None)]
    second = network.initial_shortcuts(arcs, edges, "outgoing_edge", "next_edge")
    assert second.columns[2] == "next_edge"
    assert sorted(second.collect()) == [(1, 2, 2, math.inf), (2, 1, 1, 2.0), (3, 1, 1, 2.0)]
    renewed = network.update_costs(edges, spark.createDataFrame(
        [(1, 9.0, 3.0)], "id long, length double, maxspeed double"))
    assert {r.id: r.cost for r in renewed.collect()} == {1: 3.0, 2: None}


def test_cheapest_forms_agree(shortcuts):
    best = paths.cheapest(shortcuts, CELLED)
    ranked = paths.cheapest_by_rank(shortcuts, CELLED).select(best.columns)
    assert sorted(best.collect()) == sorted(ranked.collect())
    ties = paths.cheapest_with_ties(shortcuts, CELLED).select(best.columns)
    assert best.subtract(ties).isEmpty()
    assert best.drop("via_edge").subtract(paths.lowest_costs(shortcuts, CELLED).select(
        *CELLED.keys, "cost").select(best.drop("via_edge").columns)).isEmpty()


def test_unknown_costs_lose(spark):
    frame = spark.createDataFrame([(1, 2, 3, None, 0), (1, 2, 5, math.inf, 0), (1, 3, 3, None, 0)], CELL_ROWS)
    for best in (paths.cheapest(frame, CELLED), paths.cheapest_by_rank(frame, CELLED)):
        assert {(r.outgoing_edge, r.via_edge, r.cost) for r in best.collect()} == {(2, 5, math.inf), (3, 3, None)}


def test_change_detection(spark):
    old = spark.createDataFrame([(1, 2, 2, 1.0, 0), (1, 3, 3, 4.0, 1)], CELL_ROWS)
    new = spark.createDataFrame([(1, 2, 9, 1.0, 0), (1, 3, 3, 3.0, 1), (2, 3, 3, 4.0, 1)], CELL_ROWS)
    assert paths.has_converged(old, old, CELLED) and not paths.has_converged(new, old, CELLED)
    flags = {(r.incoming_edge, r.outgoing_edge): r.is_converged for r in paths.flag_converged(new, old, CELLED).collect()}
    assert flags == {(1, 2): True, (1, 3): False, (2, 3): False}
    assert paths.all_converged(paths.flag_converged(old, old, CELLED)).first()[0] is True


def test_percentiles_match_numpy(spark, shortcuts):
    values = np.array([r.cost for r in shortcuts.collect()])
    shares = (0.0, 0.1, 0.5, 0.95, 1.0)
    exact = reports.percentiles(shortcuts, "cost", shares).first()
    assert list(exact) == [np.quantile(values, s, method="inverted_cdf") for s in shares]
    between = reports.percentiles(shortcuts, "cost", shares, interpolate=True).first()
    assert list(between) == pytest.approx([np.quantile(values, s) for s in shares])
    assert tuple(reports.approximate_percentiles(shortcuts, "cost", shares).first()) == tuple(exact)
    assert reports.percentiles(shortcuts.limit(0), "cost", (0.5,)).first()[0] is None


def test_reports(spark, shortcuts):
    values = np.array([r.cost for r in shortcuts.collect()])
    stats = reports.cost_stats(shortcuts, exact=True).first()
    assert stats.total_paths == 400 and stats.stddev_cost == pytest.approx(values.std(ddof=1))
    bins = reports.histogram(shortcuts, "cost", 50).orderBy("bin").collect()
    assert [r.rows for r in bins] == list(np.histogram(values, 50)[0])
    assert reports.histogram(shortcuts.limit(0), "cost").count() == 0
    assert sum(r.rows for r in reports.histogram(shortcuts.where("cost = 1"), "cost", 5).collect()) == (values == 1).sum()
    box = reports.box_summary(shortcuts, "cost").first()
    assert (box.q1, box.q3, box.outliers) == (np.quantile(values, 0.25), np.quantile(values, 0.75), 0)
    kinds = {r.path_type: r for r in reports.direct_vs_multihop(shortcuts, "incoming_edge").collect()}
    assert sum(r.paths for r in kinds.values()) == 400
    assert sum(r.share_percent for r in kinds.values()) == pytest.approx(100)
    assert reports.cheapest_paths(shortcuts, 3).count() == 3
    report = {r.figure: r.value for r in reports.summary_report(shortcuts).collect()}
    assert list(report) == list(reports.SUMMARY_LABELS) and report["Total Shortcuts"] == 400


def test_samples_repeat_and_hit_their_size(spark):
    frame = spark.range(20_000)
    once = sampling.sample_fraction(frame, 0.1, 42, ["id"])
    assert 1700 < once.count() < 2300
    again = sampling.sample_fraction(frame.repartition(5), 0.1, 42, ["id"])
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    assert 900 < sampling.sample_to_size(frame, 1000, 1, ["id"]).count() < 1100
    assert sampling.sample_to_size(frame, 50_000, 1, ["id"]).count() == 20_000


def test_shares_are_decided_on_the_digits_as_on_the_numbers(spark):
    frame = spark.range(5_000)
    number = sampling.unit_hash(["id"], 7)
    some = frame.where("id = 17").select(number).first()[0]
    for share in (-1.0, 0.0, 1e-12, some, some + 2**-33, 0.3, 1 - 2**-34, 1.0, 5.0, float("inf")):
        below = frame.where(sampling.below_share(["id"], 7, share))
        assert below.exceptAll(frame.where(number < share)).isEmpty() and below.count() == frame.where(number < share).count()
    assert "conv(" not in sampling.sample_fraction(frame, 0.3, 7, ["id"])._jdf.queryExecution().optimizedPlan().toString()


def test_quality(spark):
    edges = spark.createDataFrame([(1, None), (2, 1.0), (2, 2.0), (3, 3.0)], "id long, length double")
    shares = {r.column_name: (r.missing_percent, r.within_limit)
              for r in quality.missing_share(edges, ["id", "length"]).collect()}
    assert shares == {"id": (0.0, True), "length": (25.0, False)}
    assert quality.duplicate_keys(edges, ["id"]).collect() == [(2, 2)]
    arcs = spark.createDataFrame([(1, 2), (1, 9), (8, 3), (8, 9)], "incoming_edge long, outgoing_edge long")
    assert sorted(quality.orphan_arcs(arcs, edges).collect()) == [
        (1, 9, False, True), (8, 3, True, False), (8, 9, True, True)]


def test_stored_tables(spark, shortcuts):
    path = fresh_path(spark, "stored")
    for _ in range(2):
        store.write_shortcuts(shortcuts, path, ("current_cell",))
    back = store.read_shortcuts(spark, path, shortcuts.schema)
    assert back.exceptAll(shortcuts).isEmpty() and back.count() == 400
    with scratch(spark):
        inside = durable(shortcuts, "gone").inputFiles()[0]
        assert path_exists(spark, inside)
    assert not path_exists(spark, inside)


def test_region_helpers(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "x")], "v int, p string, q string")
    assert sorted(r[0] for r in paths.region_list(rows, ["p", "q"]).collect()) == ["a_x", "a_y"]
    assert sorted(r.v for r in paths.one_region(rows, p="a", q="x").collect()) == [1, 3]
    assert SHORTCUT.within("p").keys == ["incoming_edge", "outgoing_edge", "p"]


def test_ties_are_found_in_one_pass(spark):
    """All rows of the lowest cost, each once; the paths are read a single time, and rows without a key or a cost are left out."""
    rows = [(1, 2, 5, 1.0, 0), (1, 2, 6, 1.0, 0), (1, 2, 6, 1.0, 0), (1, 2, 3, 2.0, 0), (1, 2, 3, None, 0), (2, 3, 3, None, 0), (None, 3, 3, 1.0, 0)]
    rows += [(4, 5, 5, math.nan, 0), (4, 6, 6, math.nan, 0), (4, 6, 6, math.inf, 0), (7, 8, 8, 0.0, 0), (7, 8, 9, -0.0, 0)]
    ties = paths.cheapest_with_ties(spark.createDataFrame(rows, CELL_ROWS), CELLED)
    got = {(r.incoming_edge, r.outgoing_edge, r.via_edge) for r in ties.collect()}
    assert got == {(1, 2, 5), (1, 2, 6), (4, 5, 5), (4, 6, 6), (7, 8, 8), (7, 8, 9)} and ties.count() == 6
    assert "Join" not in ties._jdf.queryExecution().executedPlan().toString()


def test_degrees_are_counted_once(spark):
    """The percentile and the mean read the same stored degrees."""
    shortcuts = spark.createDataFrame([(1, 2, 2, 1.0), (1, 3, 2, 1.0), (2, 3, 3, 1.0)], "incoming_edge long, outgoing_edge long, via_edge long, cost double")
    summary = reports.degree_summary(shortcuts)
    assert tuple(summary.first()) == (1.5, 1.5)
    assert "Exchange hashpartitioning" not in summary._jdf.queryExecution().executedPlan().toString()
