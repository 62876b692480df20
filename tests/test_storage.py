"""What operators leave in the shared folder: their result only."""

from pathlib import Path

import pytest

from roadloom.durable import shared_folder
from roadloom.operators import graph


def tables(spark):
    folder = Path(shared_folder(spark).removeprefix("file:")) / "roadloom"
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


@pytest.mark.parametrize("work,left", [
    (lambda v, e: graph.connected_components(v, e, 3), "components"),
    (lambda v, e: graph.pagerank(v, e, hot_rows=3), "pagerank"),
    (lambda v, e: graph.landmark_distances(v, e, [1, 7], 3), "landmarks"),
])
def test_only_the_result_stays(spark, work, left):
    vertices = spark.createDataFrame([(i,) for i in range(30)], "id long")
    edges = spark.createDataFrame([(i % 7, i) for i in range(30)] + [(i, i + 1) for i in range(10, 20)], "src long, dst long")
    before = tables(spark)
    result = work(vertices, edges)
    assert result.count()
    added = tables(spark) - before
    assert len(added) == 1 and added.pop().startswith(left)
