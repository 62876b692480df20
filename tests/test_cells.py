import random

from pyspark.sql import functions as F

from roadloom.functions import cells
from roadloom.functions.costs import travel_cost
from roadloom.operators.quality import invalid_cells

INF = float("inf")


def make_cell(base, digits):
    cell = (1 << 59) | (len(digits) << 52) | (base << 45) | ((1 << 45) - 1)
    for level, digit in enumerate(digits, start=1):
        shift = 3 * (15 - level)
        cell = (cell & ~(7 << shift)) | (digit << shift)
    return cell


def test_published_cells(spark):
    rows = [(0x8928308280FFFFF, 0x85283473FFFFFFF, 0x80F3FFFFFFFFFFF)]
    row = spark.createDataFrame(rows, "a long, b long, c long").select(
        cells.resolution("a").alias("res"), cells.ancestor("a", 5).alias("up5"), cells.ancestor("b", 4).alias("up4"),
        cells.common_ancestor("a", "b").alias("both"), cells.common_ancestor("a", "c").alias("apart"),
        cells.to_text("a").alias("text"),
    ).first()
    assert row.res == 9 and row.up5 == 0x85283083FFFFFFF and row.up4 == 0x8428347FFFFFFFF
    assert row.both == 0x822837FFFFFFFFF and row.apart == 0
    assert row.text == "8928308280fffff"


def test_random_cells_follow_the_digits(spark):
    rng = random.Random(5)
    rows, want = [], []
    for _ in range(300):
        a_base = rng.randrange(122)
        b_base = a_base if rng.random() < 0.8 else rng.randrange(122)
        a = [rng.randrange(7) for _ in range(rng.randint(0, 15))]
        keep = rng.randint(0, len(a))
        b = (a[:keep] + [rng.randrange(7) for _ in range(15)])[: rng.randint(0, 15)]
        res = rng.randint(-1, 15)
        shared = 0
        while shared < min(len(a), len(b)) and a[shared] == b[shared]:
            shared += 1
        rows.append((make_cell(a_base, a), make_cell(b_base, b), res))
        up = 0 if res < 0 else make_cell(a_base, a[:res])
        want.append((len(a), up, make_cell(a_base, a[:shared]) if a_base == b_base else 0))
    frame = spark.createDataFrame(rows, "a long, b long, res int").coalesce(1)
    got = frame.select(
        cells.resolution("a"), cells.ancestor("a", "res"), cells.common_ancestor("a", "b")
    ).collect()
    assert [tuple(r) for r in got] == want
    edges = frame.selectExpr("a AS id", "a AS incoming_cell", "b AS outgoing_cell")
    assert invalid_cells(edges).isEmpty()
    assert invalid_cells(edges.withColumn("outgoing_cell", F.lit((1 << 59) | 5))).count() == 300


def test_absent_cells(spark):
    big = make_cell(3, [1])
    frame = spark.createDataFrame([(0, big, None)], "none long, some long, unknown long")
    row = frame.select(
        cells.resolution("none"), cells.ancestor("none", 4), cells.common_ancestor("none", "some"),
        cells.resolution("unknown"), cells.ancestor("unknown", 2), cells.ancestor("unknown", -1),
        cells.common_ancestor("unknown", "none"), cells.to_text("none"),
    ).first()
    assert tuple(row) == (-1, 0, 0, None, None, 0, None, None)


def test_text_forms(spark):
    a, b = make_cell(3, [1, 2, 3]), make_cell(3, [1, 4])
    rows = [(f"{a:x}", f"{b:x}"), (str(a), f" {b:x} "), ("0", f"{b:x}"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").coalesce(1).select(
        cells.from_text("a").alias("a"), cells.text_resolution("a").alias("res"),
        cells.text_ancestor("a", 1).alias("up"), cells.text_common_ancestor("a", "b").alias("both"),
    ).collect()
    shared = f"{make_cell(3, [1]):x}"
    assert [tuple(r) for r in got] == [
        (a, 3, shared, shared), (a, 3, shared, shared), (0, -1, None, None), (None, -1, None, None)
    ]


def test_travel_cost(spark):
    rows = [(100.0, 50.0), (100.0, 0.0), (100.0, -3.0), (None, 5.0), (5.0, None), (0.0, 5.0)]
    frame = spark.createDataFrame(rows, "length double, maxspeed double").coalesce(1)
    got = [tuple(r) for r in frame.select(travel_cost(), travel_cost(seconds_per_unit=60)).collect()]
    assert got == [(2.0, 2.0 / 60), (INF, INF), (INF, INF), (None, None), (None, None), (0.0, 0.0)]
