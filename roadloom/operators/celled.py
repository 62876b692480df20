"""Placing shortcuts in the cell hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.cells import ancestor, common_ancestor, common_ancestor_at_sql, common_resolution

GLOBAL_RESOLUTION = -1

# What the two ends of a shortcut contribute; a composed path inherits them.
ABOUT_SOURCE = ("source_cell", "source_res")
ABOUT_TARGET = ("target_cell", "target_res")
DERIVED = ("lca_res", "via_cell", "via_res")


def with_end_facts(shortcuts: DataFrame, edges: DataFrame) -> DataFrame:
    """Attach start cell, end cell and own resolution of the two edges by left joins.

    Rows with an unknown edge stay, with NULL facts. A shortcut table can hold
    many rows per edge and the edge table one, so the join strategy is left to
    the planner, which splits skewed partitions of the left side.
    """
    sources = edges.selectExpr(
        "id AS incoming_edge", "incoming_cell AS source_cell", "lca_res AS source_res"
    )
    targets = edges.selectExpr(
        "id AS outgoing_edge", "outgoing_cell AS target_cell", "lca_res AS target_res"
    )
    bare = shortcuts.drop(*DERIVED, *ABOUT_SOURCE, *ABOUT_TARGET)
    return bare.join(sources, "incoming_edge", "left").join(targets, "outgoing_edge", "left")


# Coarsest level a pair can be used at: the finer of its two edges' levels.
PAIR_LEVEL = "greatest(source_res, target_res)"


def with_place(shortcuts: DataFrame) -> DataFrame:
    """Add ``lca_res``, ``via_cell`` and ``via_res`` from the end facts."""
    # The level is found once per row, and the cell from it.
    placed = shortcuts.withColumn("lca_res", F.expr(PAIR_LEVEL)).withColumn("via_res", common_resolution("source_cell", "target_cell"))
    return placed.withColumn("via_cell", F.expr(common_ancestor_at_sql("source_cell", "via_res"))).select(
        *[name for name in shortcuts.columns if name not in DERIVED], *DERIVED
    )


def add_info(shortcuts: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortcuts with ``lca_res``, ``via_cell`` and ``via_res``."""
    return with_place(with_end_facts(shortcuts, edges)).drop(*ABOUT_SOURCE, *ABOUT_TARGET)


def takes_part_sql(res: int) -> str:
    condition = "lca_res <= 0" if res == GLOBAL_RESOLUTION else f"lca_res <= {res} AND via_res >= {res}"
    return f"coalesce({condition}, false)"


def kind_takes_part(res: int, lca_res: int | None, via_res: int | None) -> bool:
    """As ``takes_part_sql``, for the values of one kind of rows."""
    if lca_res is None:
        return False
    return lca_res <= 0 if res == GLOBAL_RESOLUTION else via_res is not None and lca_res <= res <= via_res


def takes_part(res: int) -> Column:
    """Condition for a placed shortcut to take part at a resolution; -1 is the global step."""
    return F.expr(takes_part_sql(res))


def at_resolution(placed: DataFrame, res: int) -> DataFrame:
    """The placed shortcuts that take part at a resolution."""
    return placed.where(takes_part(res))


def with_current_cell(placed: DataFrame, res: int) -> DataFrame:
    """Replace the place columns by ``current_cell``, the cell at the resolution."""
    return placed.withColumn("current_cell", ancestor("via_cell", res)).drop(*DERIVED)


def direction() -> Column:
    """0 on the same level, -1 towards finer, +1 towards coarser, NULL if unknown."""
    return F.expr("CAST(sign(source_res - target_res) AS TINYINT)")


def final_from_facts(shortcuts: DataFrame) -> DataFrame:
    """The published shortcut table, from shortcuts that carry the end facts, placed or not."""
    placed = shortcuts if "via_cell" in shortcuts.columns else shortcuts.withColumn("via_cell", common_ancestor("source_cell", "target_cell"))
    return placed.select(
        "incoming_edge",
        "outgoing_edge",
        "via_edge",
        "cost",
        direction().alias("inside"),
        ancestor("via_cell", PAIR_LEVEL).alias("cell"),
    )


def add_final_info(shortcuts: DataFrame, edges: DataFrame) -> DataFrame:
    """The published shortcut table: direction ``inside`` and the ``cell`` it serves."""
    return final_from_facts(with_end_facts(shortcuts, edges))
