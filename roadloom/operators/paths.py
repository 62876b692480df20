"""Single steps on path tables: extend by one join, keep the cheapest, compare."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.skew import GRID_SIDE, meeting_join


@dataclass(frozen=True)
class PathColumns:
    """Names of the columns of a path table.

    ``groups`` are the columns a path may not leave, such as the cell.
    """

    source: str = "incoming_edge"
    target: str = "outgoing_edge"
    hop: str = "via_edge"
    cost: str = "cost"
    groups: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [self.source, self.target, *self.groups]

    @property
    def all(self) -> list[str]:
        return [*self.keys, self.cost, self.hop]

    def within(self, *groups: str) -> "PathColumns":
        return PathColumns(self.source, self.target, self.hop, self.cost, tuple(groups))


SHORTCUT = PathColumns()
CELLED = SHORTCUT.within("current_cell")
HOPPED = PathColumns("src", "dst", "next_node", "cost")

def cost_order_sql(cost: str) -> str:
    """Cost with NULL placed last: NaN sorts after infinity."""
    return f"coalesce({cost}, double('NaN'))"


def cheapest(
    paths: DataFrame, columns: PathColumns, extra: Sequence[str] = (), carried: Sequence[str] = ()
) -> DataFrame:
    """One row per key: lowest cost, then lowest hop.

    Two hash aggregations with map-side combine; ``extra`` columns must depend
    on the key alone. ``carried`` columns come from a row of the lowest cost that
    has them, and are NULL if none does.
    """
    kept = [F.expr(f"min({name}) AS {name}") for name in extra]
    cost, hop = columns.cost, columns.hop
    per_cost = paths.groupBy(*columns.keys, cost).agg(
        F.expr(f"min({hop}) AS {hop}"), *kept, *[F.expr(f"max({name}) AS {name}") for name in carried]
    )
    return per_cost.groupBy(*columns.keys).agg(
        *[F.expr(f"min_by({name}, {cost_order_sql(cost)}) AS {name}") for name in (cost, hop, *carried)], *kept
    )


def cheapest_by_rank(paths: DataFrame, columns: PathColumns) -> DataFrame:
    """The rows ``cheapest`` finds, as a ranking window with all columns kept."""
    best_first = Window.partitionBy(*columns.keys).orderBy(F.expr(cost_order_sql(columns.cost)), columns.hop)
    return (
        paths.withColumn("_rank", F.row_number().over(best_first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def lowest_costs(paths: DataFrame, columns: PathColumns) -> DataFrame:
    """The minimum cost per key."""
    return paths.groupBy(*columns.keys).agg(F.min(columns.cost).alias(columns.cost))


def cheapest_with_ties(paths: DataFrame, columns: PathColumns) -> DataFrame:
    """All distinct rows that reach the minimum cost of their key; rows without a key or a cost reach none.

    The paths are read once, and ranked in place where the rows of a key lie together.
    """
    whole = " AND ".join(f"{name} IS NOT NULL" for name in (*columns.keys, columns.cost))
    best_first = Window.partitionBy(*columns.keys).orderBy(F.expr(cost_order_sql(columns.cost)))
    return paths.where(whole).withColumn("_rank", F.rank().over(best_first)).where(F.col("_rank") == 1).drop("_rank").distinct()


def extend(
    left: DataFrame, right: DataFrame, columns: PathColumns, hop_rule: str = "middle", side: int = GRID_SIDE
) -> DataFrame:
    """Chain each left path with each right path that starts where it ends.

    Costs add. The hop is the meeting point (``middle``) or the left path's own
    hop (``first``). A path never returns to its own start. Nodes where more than
    ``side`` squared pairs meet are split on both sides; where no group has rows enough for
    that, its nodes are not counted.
    """
    most = _most_in_a_group(left, columns)
    if most is not None:
        most *= most if left is right else _most_in_a_group(right, columns)
    hop = {"middle": "_mid", "first": "_left_hop"}[hop_rule]
    left = left.selectExpr(
        columns.source, *columns.groups, f"{columns.target} AS _mid", f"{columns.cost} AS _left_cost", f"{columns.hop} AS _left_hop"
    )
    right = right.selectExpr(columns.target, *columns.groups, f"{columns.source} AS _mid", f"{columns.cost} AS _right_cost")
    pairs = meeting_join(left, right, ["_mid", *columns.groups], [columns.source], [columns.target], side, most)
    return pairs.where(F.col(columns.source) != F.col(columns.target)).selectExpr(
        *columns.keys, f"_left_cost + _right_cost AS {columns.cost}", f"{hop} AS {columns.hop}"
    )


def _most_in_a_group(paths: DataFrame, columns: PathColumns) -> int | None:
    """The rows of the largest group; None without groups."""
    if not columns.groups:
        return None
    return paths.groupBy(*columns.groups).count().agg(F.max("count")).first()[0] or 0


def improve_once(paths: DataFrame, columns: PathColumns, hop_rule: str = "middle") -> DataFrame:
    """One full doubling round: extend every path by every path, keep the cheapest."""
    paths = paths.select(*columns.all)
    return cheapest(paths.unionByName(extend(paths, paths, columns, hop_rule)), columns)


def changed_rows(newer: DataFrame, older: DataFrame, compare: Sequence[str]) -> DataFrame:
    """Rows of ``newer`` whose compared columns do not occur in ``older``."""
    return newer.join(older.select(*compare), list(compare), "left_anti")


def has_converged(newer: DataFrame, older: DataFrame, columns: PathColumns) -> bool:
    """True when no path is new and no cost has changed."""
    return changed_rows(newer, older, [*columns.keys, columns.cost]).isEmpty()


def flag_converged(
    newer: DataFrame, older: DataFrame, columns: PathColumns, compare: Sequence[str] | None = None
) -> DataFrame:
    """``newer`` with ``is_converged``: false for all rows of a group with any change."""
    compared = list(compare or [columns.source, columns.target, columns.cost])
    groups = list(columns.groups)
    active = (
        changed_rows(newer, older, compared)
        .select(*groups)
        .distinct()
        .withColumn("_active", F.lit(True))
    )
    return (
        newer.join(active, groups, "left")
        .withColumn("is_converged", F.col("_active").isNull())
        .drop("_active")
    )


def all_converged(flagged: DataFrame) -> DataFrame:
    """One row telling whether every row is flagged as converged."""
    return flagged.agg(F.bool_and("is_converged").alias("all_converged"))


def path_difference(left: DataFrame, right: DataFrame, columns: PathColumns) -> DataFrame:
    """Distinct paths of ``left`` that ``right`` does not hold."""
    return left.select(*columns.all).subtract(right.select(*columns.all))


def below_cost(paths: DataFrame, ceiling: float, cost: str = "cost") -> DataFrame:
    """Paths cheaper than the ceiling."""
    return paths.where(F.col(cost) < F.lit(float(ceiling)))


def with_region_key(paths: DataFrame, parts: Sequence[str], separator: str = "_") -> DataFrame:
    """Add ``region_key``, the parts joined into one text key."""
    return paths.withColumn("region_key", F.concat_ws(separator, *[F.col(p) for p in parts]))


def region_list(paths: DataFrame, parts: Sequence[str], separator: str = "_") -> DataFrame:
    """The distinct region keys."""
    return with_region_key(paths, parts, separator).select("region_key").distinct()


def one_region(paths: DataFrame, **values) -> DataFrame:
    """The rows of one region, named by the value of each region column."""
    condition = F.lit(True)
    for name, value in values.items():
        condition = condition & (F.col(name) == F.lit(value))
    return paths.where(condition)
