"""Whole-graph jobs over vertices ``(id, ...)`` and edges ``(src, dst, ...)``.

Nodes with very many edges are split over several tasks wherever edges are
joined to per-node values; see ``roadloom.operators.skew``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.durable import Rounds, durable, fresh_path, tidy, write_and_read
from roadloom.operators.skew import GRID_SIDE, HOT_ROWS, SLOT, copy_to_slots, deal_out, hot_keys, meeting_join, spread_join


class _EdgesByNode:
    """A stored edge table that is joined to per-node rows again and again."""

    def __init__(self, edges: DataFrame, node: str, other: str, hot_rows: int):
        self.node = node
        self.edges = durable(edges, "edges")
        self.hot = hot_keys(self.edges, [node], hot_rows)
        if self.hot is not None:
            self.hot = durable(self.hot, "hubs")
            self.edges = durable(deal_out(self.edges, self.hot, [node], [other]), "edges")

    def join(self, per_node: DataFrame) -> DataFrame:
        if self.hot is None:
            return self.edges.join(per_node, self.node)
        return self.edges.join(copy_to_slots(per_node, self.hot, [self.node]), [self.node, SLOT]).drop(SLOT)


@tidy("landmarks")
def landmark_distances(
    vertices: DataFrame, edges: DataFrame, landmarks: Sequence, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Hops from every vertex to each landmark it can reach along the edges.

    Breadth first, backwards from the landmarks. Each round adds its newly
    reached rows to the stored result; earlier rows are final.
    """
    spark = edges.sparkSession
    by_target = _EdgesByNode(
        edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "dst", "src", hot_rows
    )
    path = fresh_path(spark, "reached")
    frontier = vertices.where(F.col("id").isin(list(landmarks))).select("id", F.col("id").alias("landmark"))
    stored = T.StructType([*frontier.schema.fields, T.StructField("distance", T.IntegerType())])
    distance, reached = 0, None
    while True:
        written, seen = write_and_read(frontier, f"{path}/distance={distance}", rows=F.count(F.lit(1)))
        if seen["rows"] == 0:
            break
        reached = spark.read.schema(stored).parquet(path)
        step = by_target.join(written.withColumnRenamed("id", "dst")).select(
            F.col("src").alias("id"), "landmark"
        )
        frontier = step.distinct().join(reached, ["id", "landmark"], "left_anti")
        distance += 1
    if reached is None:
        return written.withColumn("distance", F.lit(None).cast("int"))
    return reached


def distance_maps(distances: DataFrame) -> DataFrame:
    """One row per vertex with a map from landmark to distance."""
    entry = F.struct("landmark", "distance")
    return distances.groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("distances"))


def distance_bounds(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """``pairs`` of ``id`` and ``target`` with ``bound``, a lower bound on the hops from one to the other.

    By the triangle inequality the way to a landmark is no longer than the way over the
    target: the bound is the most by which a landmark is farther from the vertex than from
    the target, over the landmarks both reach, and at least 0. A landmark that the target
    reaches and the vertex does not rules the way out: the bound is then NULL, and
    ``reachable`` is false. Maps are of one entry per landmark, joined once for each end.
    """
    joined = pairs.join(maps.withColumnRenamed("distances", "_from"), "id", "left").join(
        maps.select(F.col("id").alias("target"), F.col("distances").alias("_to")), "target", "left"
    )
    beyond = F.expr("coalesce(forall(map_keys(_to), x -> _from IS NOT NULL AND map_contains_key(_from, x)), true)")
    gaps = F.expr("transform(map_keys(_to), x -> _from[x] - _to[x])")
    bound = F.greatest(F.lit(0), F.coalesce(F.array_max(gaps), F.lit(0)))
    return joined.select(
        *pairs.columns, beyond.alias("reachable"), F.when(beyond, bound).cast("int").alias("bound")
    )


@tidy("pagerank")
def pagerank(
    vertices: DataFrame, edges: DataFrame, reset: float = 0.15, rounds: int = 5, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Ranks after a fixed number of rounds, scaled so that they average one.

    Every vertex starts at one and passes its rank on along its edges, parallel
    edges counting each.
    """
    links = durable(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_links")), "links")
    degrees = links.groupBy("src").agg(F.sum("_links").alias("_degree"))
    weighted = spread_join(links, degrees, ["src"], ["dst"], hot_rows=hot_rows).select(
        "src", "dst", (F.col("_links") / F.col("_degree")).alias("_weight")
    )
    by_source = _EdgesByNode(weighted, "src", "dst", hot_rows)
    nodes = durable(vertices.select("id").distinct(), "vertices")
    store = Rounds(edges.sparkSession, "ranks")
    ranks, measured = nodes.withColumn("rank", F.lit(1.0)), None
    for _ in range(rounds):
        received = (
            by_source.join(ranks.withColumnRenamed("id", "src"))
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum(F.col("rank") * F.col("_weight")).alias("_received"))
        )
        rank = F.lit(reset) + F.lit(1.0 - reset) * F.coalesce("_received", F.lit(0.0))
        ranks, measured = store.save(
            nodes.join(received, "id", "left").select("id", rank.alias("rank")),
            ranks=F.sum("rank"), vertices=F.count(F.lit(1)),
        )
    scale = measured["vertices"] / measured["ranks"] if measured and measured["ranks"] else 1.0
    return ranks.select("id", (F.col("rank") * F.lit(scale)).alias("pagerank"))


@tidy("components")
def connected_components(vertices: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The lowest vertex id of each vertex's component, edges taken both ways.

    Alternating star contraction: every node hands its larger neighbours, then
    its smaller ones, to the smallest it knows, until only stars are left.
    """
    spark = edges.sparkSession
    store = Rounds(spark, "stars")
    stars = (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    stars, _ = store.save(stars)
    while True:
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = _to_lowest(both, hot_rows, F.least(F.min("v"), F.col("u"))).where("v > u")
        large = larger.groupBy(F.col("v").alias("u"), F.col("low").alias("v")).agg(
            F.bool_or(F.col("low") != F.col("u")).alias("moved")
        )
        large = durable(large, "large-stars")
        smaller = _to_lowest(large, hot_rows, F.min("v"))
        small = smaller.select(
            F.explode(F.array(
                F.struct("u", F.col("low").alias("v"), (F.col("moved") | (F.col("v") != F.col("low"))).alias("moved")),
                F.struct(F.col("v").alias("u"), F.col("low").alias("v"), F.lit(False).alias("moved")),
            )).alias("edge")
        ).select("edge.*").where("u <> v").groupBy("u", "v").agg(F.bool_or("moved").alias("moved"))
        stars, seen = store.save(small, moved=F.count_if("moved"))
        if seen["moved"] == 0:
            break
    return vertices.select("id").distinct().join(
        stars.select(F.col("u").alias("id"), F.col("v").alias("_low")), "id", "left"
    ).select("id", F.coalesce("_low", "id").alias("component"))


def _to_lowest(links: DataFrame, hot_rows: int, lowest) -> DataFrame:
    """Links ``(u, v)`` with ``low``, the lowest node known to ``u``."""
    lows, seen = write_and_read(
        links.groupBy("u").agg(lowest.alias("low"), F.count(F.lit(1)).alias("_links")),
        fresh_path(links.sparkSession, "lowest"), most=F.max("_links"),
    )
    per_node = lows.drop("_links")
    if (seen["most"] or 0) <= hot_rows:
        return links.join(per_node, "u")
    return spread_join(links, per_node, ["u"], ["v"], hot_rows=hot_rows)


def two_step_paths(vertices: DataFrame, edges: DataFrame, side: int = GRID_SIDE) -> DataFrame:
    """All matches of a -> b -> c: the three vertices and two edges as structs.

    ``a`` and ``c`` may be the same vertex. A ``b`` with many edges on both sides is split on both.
    """
    first = edges.select(F.struct(*edges.columns).alias("e"), F.col("src").alias("_a"), F.col("dst").alias("_b"))
    second = edges.select(F.struct(*edges.columns).alias("e2"), F.col("src").alias("_b"), F.col("dst").alias("_c"))
    matches = meeting_join(first, second, ["_b"], ["_a", "e"], ["_c", "e2"], side)
    for name in ("a", "b", "c"):
        matches = matches.join(
            vertices.select(F.col("id").alias(f"_{name}"), F.struct(*vertices.columns).alias(name)), f"_{name}"
        )
    return matches.select("a", "e", "b", "e2", "c")


def vertices_of(edges: DataFrame) -> DataFrame:
    """The distinct ends of the edges as a vertex table."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
