import random
from collections import Counter, defaultdict, deque

import pytest

from roadloom.operators import graph
from roadloom.operators.skew import spread_join

# Ports and sailings of a made-up coast: a ring of three, a spur, a return trip, and a port no ship calls at.
PORTS = [(f"p{i}", 10 * i) for i in range(8)]
SAILINGS = [("p0", "p1", 4), ("p1", "p2", 6), ("p2", "p0", 5), ("p2", "p3", 9), ("p4", "p5", 2), ("p5", "p4", 2), ("p4", "p6", 7)]


@pytest.fixture(scope="module")
def coast(spark):
    return (spark.createDataFrame(PORTS, "id string, berths int"),
            spark.createDataFrame(SAILINGS, "src string, dst string, hours int"))


def test_landmarks(coast):
    found = graph.landmark_distances(*coast, ["p3", "p5"])
    maps = {r.id: r.distances for r in graph.distance_maps(found).collect()}
    assert maps == {"p0": {"p3": 3}, "p1": {"p3": 2}, "p2": {"p3": 1}, "p3": {"p3": 0}, "p4": {"p5": 1}, "p5": {"p5": 0}}


def test_no_known_landmark(coast):
    assert graph.landmark_distances(*coast, ["nowhere"]).count() == 0


def test_two_step_paths(coast):
    got = sorted((r.a.id, r.b.id, r.c.id, r.e.hours + r.e2.hours) for r in graph.two_step_paths(*coast).collect())
    assert got == sorted((a, b, d, x + y) for a, b, x in SAILINGS for c, d, y in SAILINGS if b == c)


def test_coast_components(coast):
    got = {r.id: r.component for r in graph.connected_components(*coast).collect()}
    assert got == {"p0": "p0", "p1": "p0", "p2": "p0", "p3": "p0", "p4": "p4", "p5": "p4", "p6": "p4", "p7": "p7"}


@pytest.mark.parametrize("hot_rows", [100_000, 3])
def test_pagerank_matches_rounds_by_hand(spark, hot_rows):
    rng = random.Random(2)
    edges = [(rng.randrange(8), rng.randrange(10)) for _ in range(40)]
    ids = range(11)
    degree = Counter(a for a, _ in edges)
    rank = {i: 1.0 for i in ids}
    for _ in range(5):
        received = defaultdict(float)
        for a, b in edges:
            received[b] += rank[a] / degree[a]
        rank = {i: 0.15 + 0.85 * received[i] for i in ids}
    scale = len(rank) / sum(rank.values())
    got = graph.pagerank(spark.createDataFrame([(i,) for i in ids], "id long"),
                         spark.createDataFrame(edges, "src long, dst long"), hot_rows=hot_rows)
    got = {r.id: r.pagerank for r in got.collect()}
    assert got == pytest.approx({i: r * scale for i, r in rank.items()})


@pytest.mark.parametrize("hot_rows", [100_000, 4])
def test_components_and_distances_on_a_random_graph_with_a_hub(spark, hot_rows):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(34)] + [(70, 100 + i) for i in range(20)]
    edges += [(i, i + 1) for i in range(200, 240)]
    near, back = defaultdict(set), defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a), back[b].add(a)
    ids = sorted({*near, 999})

    def reach(start, step):
        seen, queue = {start: 0}, deque([start])
        while queue:
            node = queue.popleft()
            for other in step[node]:
                if other not in seen:
                    seen[other] = seen[node] + 1
                    queue.append(other)
        return seen

    vertices = spark.createDataFrame([(i,) for i in ids], "id long")
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.component for r in graph.connected_components(vertices, frame, hot_rows).collect()}
    assert got == {i: min(reach(i, near)) for i in ids}
    found = graph.landmark_distances(vertices, frame, [110, 205], hot_rows).collect()
    assert {(r.id, r.landmark): r.distance for r in found} == {
        (node, mark): hops for mark in (110, 205) for node, hops in reach(mark, back).items()}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_keeps_the_result(spark, how):
    large = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(60)], "k int, v int")
    small = spark.createDataFrame([(7, "x"), (7, "y"), (1, "z")], "k int, w string")
    plain = large.join(small, ["k"], how)
    spread = spread_join(large, small, ["k"], ["v"], how, hot_rows=5).select(plain.columns)
    assert sorted(spread.collect(), key=str) == sorted(plain.collect(), key=str)
