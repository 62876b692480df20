"""Hard negatives against a plain loop over all pairs."""

import math
import random

import pytest

from roadloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def model(rows):
    usable = {}
    for vec_id, vector, label in rows:
        if None in (vec_id, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = math.fmod(label + 1, 10) if vec_id % 7 == 0 else label
        whole = int(label), [math.floor(256 * x) for x in vector]
        usable[vec_id] = min(usable.get(vec_id, whole), whole)
    out = []
    for anchor, (label, q) in usable.items():
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i, other) for i, (other, v) in usable.items() if i != anchor)
        for ps, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(s, i) for s, i, other in scored if other != label and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(anchor, positive, k, i, -ps, -s) for k, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def rounded(x):
    """A value that 32 bits hold exactly."""
    return round(x * 1024) / 1024


def given(n=1500, seed=3, dims=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(10)]
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 1, 2, 3, 4, 9])
        rows.append((i, [rounded(c + rng.gauss(0, 0.15)) for c in centres[label]], label))
    # Ties, a large group of copies, zeros, unequal lengths, and rows that take no part.
    rows += [(2000 + i, rows[5][1], 1 + i % 2) for i in range(600)]
    rows += [(3000, [0.0] * dims, 1), (3100, [], 2), (3101, [0.5] * (dims + 9), 2), (3200, [0.25] * 3, 1)]
    rows += [(3300, None, 1), (3400, [0.1, None], 1), (3500, [float("nan")] * dims, 1), (3600, [float("inf")] * dims, 2), (None, [0.5] * dims, 2), (3700, [0.5] * dims, None)]
    rows += [rows[3], rows[3], (100, [0.75] * dims, 0), (-100, rows[7][1], 4), (-7, rows[8][1], 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], SCHEMA)


def mined(spark, rows):
    found = hn.report(frame(spark, rows)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, found.collect()))


def test_report_equals_model(spark):
    rows = given()
    assert mined(spark, rows) == model(rows)


def test_small_blocks_and_slices(spark, monkeypatch):
    for name, value in (("BLOCK_CELLS", 200), ("SLICE_ANCHORS", 6), ("SEED_SHARE", 2)):
        monkeypatch.setattr(hn, name, value)
    rows = given(900, 4)
    assert mined(spark, rows) == model(rows)


def test_few_rows(spark):
    rows = given()
    for some in ([], rows[:1], rows[:3], rows[:40] + rows[-14:]):
        assert mined(spark, some) == model(some)


def test_bounds_leave_little_to_read():
    """On clustered rows most candidates go before all their columns are read."""
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(0, 200, (8, 64)).astype(np.int64)
    blocks = [hn.Block(np.arange(400) + 400 * k, np.full(400, 1), np.ascontiguousarray((centres[k] + rng.integers(-9, 9, (400, 64))).T)) for k in range(8)]
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                read.append(len(key))
            return super().__getitem__(key)

    for block in blocks:
        block.columns = block.columns.view(Counted)
    anchors = hn.Anchors(np.array([0]), np.array([1]), centres[:1], np.array([[hn.LOWEST]]), np.array([[np.iinfo(np.int64).max]]), 5, True)
    for block in blocks:
        anchors.scan(block)
    exact = sorted(((int(centres[0] @ b.columns[:, j]), -int(b.ids[j])) for b in blocks for j in range(400)), reverse=True)
    exact = [e for e in exact if e[1] != 0][:5]
    assert [(s, -i) for s, i in zip(anchors.scores[0, 0].tolist(), anchors.found[0, 0].tolist())] == exact
    assert sum(read) < 64 * 8 / 2


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e17], 1), (1, [1e17], 1), (2, [1.0], 2)])
