"""The bounded-cost loop: filter by cost, close each region, merge, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.durable import Rounds, durable, fresh_path, scratch, write_and_read
from roadloom.operators.closure import closure
from roadloom.operators.merge import merge_partitions
from roadloom.operators.paths import PathColumns, below_cost


def region_closure(paths: DataFrame, columns: PathColumns, **how) -> DataFrame:
    """All regions of a path table closed in one job, region columns kept."""
    return closure(paths, columns, **how)


def region_digests(paths: DataFrame, columns: PathColumns) -> DataFrame:
    """A digest of each region's rows that does not depend on their order: how many there are and two sums of hashes."""
    row = F.xxhash64(*columns.all)
    return paths.groupBy(*columns.groups).agg(
        F.count(F.lit(1)).alias("_rows"), F.bit_xor(row).alias("_xor"), F.sum(F.pmod(row, F.lit((1 << 31) - 1))).alias("_sum")
    )


def unsettled(paths: DataFrame, left_by_closing: DataFrame, columns: PathColumns) -> DataFrame:
    """Regions whose rows are not as the last closing left them, among those that have rows."""
    digests = region_digests(paths, columns)
    return digests.join(left_by_closing, digests.columns, "left_anti").select(*columns.groups)


def bounded_cost_pipeline(
    paths: DataFrame, columns: PathColumns, ceiling: float, rounds: int = 3, **how
) -> DataFrame:
    """Close the paths below a cost ceiling per region and merge, a few times over.

    A region with any path below the ceiling is replaced by its closure; the
    others stay as they are. A region is settled, and not closed again, as long as closing
    would give what it holds: its rows below the ceiling are those that the last closing
    left, or with the ``last`` hop rule, where closed rows count as steps to further hops,
    those that the last closing took. Without other regions the loop ends.
    """
    spark = paths.sparkSession
    store, digests = Rounds(spark, "regions"), Rounds(spark, "digests")
    table, left = paths.select(*columns.all), None
    if rounds:
        # Closing reads the table several times before its first merge.
        table, _ = store.save(table)
    for _ in range(rounds):
        with scratch(spark):
            below = below_cost(table, ceiling, columns.cost)
            if left is not None:
                changed, seen = write_and_read(unsettled(below, left, columns), fresh_path(spark, "changed"), rows=F.count(F.lit(1)))
                if not seen["rows"]:
                    break
                below = below.join(changed, list(columns.groups), "left_semi")
            closed = durable(region_closure(below, columns, **how).select(*columns.all), "closed")
            taken = how.get("hop_rule", "last") == "last"
            now = region_digests(below if taken else below_cost(closed, ceiling, columns.cost), columns)
            if left is not None:
                now = now.unionByName(left.join(changed, list(columns.groups), "left_anti"))
            left, _ = digests.save(now)
            table, _ = store.save(merge_partitions(table, closed, columns.groups))
    digests.drop_all()
    return table
