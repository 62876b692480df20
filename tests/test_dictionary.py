"""Dense numbers of ids, and closures over them."""

import random

from roadloom.operators.closure import closure
from roadloom.operators.dictionary import closure_by_numbers, numbered, to_ids, to_numbers
from roadloom.operators.paths import HOPPED

WORDS = ["", "a", "B", "é", "zebra", "10", "9"] + [f"id {i}" for i in range(300)]


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(2)
    left = [(rng.choice([None, "a", "a", *WORDS]),) for _ in range(2000)]
    right = [(rng.choice(WORDS),) for _ in range(500)] + [(None,)]
    found = numbered(spark.createDataFrame(left, "x string"), spark.createDataFrame(right, "y string")).collect()
    expected = sorted({x for x, in left + right if x is not None}, key=str.encode)
    assert sorted((r.number, r.id) for r in found) == list(enumerate(expected))
    assert numbered(spark.createDataFrame([(None,)], "x string")).count() == 0


def test_there_and_back(spark):
    rows = [("a", None, 1), ("é", "a", 2), (None, None, 3), ("a", "unknown", 4)]
    df = spark.createDataFrame(rows, "x string, y string, number int")
    known = numbered(df.select("x"))
    there = to_numbers(df, known, ["x", "y"])
    assert sorted(map(tuple, there.collect()), key=lambda r: r[2]) == [(0, None, 1), (1, 0, 2), (None, None, 3), (0, None, 4)]
    back = to_ids(there, known, ["x", "y"])
    assert sorted(map(tuple, back.collect()), key=lambda r: r[2]) == [("a", None, 1), ("é", "a", 2), (None, None, 3), ("a", None, 4)]


def test_closure_of_text_equals_closure_of_numbers(spark):
    rng = random.Random(9)
    rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", float(rng.randint(1, 9)), "x", rng.choice(["north", "south"]), 1) for _ in range(90)]
    rows += [(None, "n1", 1.0, "x", "north", 1), ("n1", "n2", 1.0, "n2", None, 1)]
    frame = spark.createDataFrame([(a, b, c, b, g, k) for a, b, c, _, g, k in rows], "src string, dst string, cost double, next_node string, river string, lane int")
    columns = HOPPED.within("river", "lane")
    for how in (dict(), dict(hop_rule="first"), dict(method="grouped")):
        got = closure_by_numbers(frame, columns, **how)
        want = closure(frame.where("src is not null and river is not null"), columns, **how)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
