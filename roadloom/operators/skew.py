"""Joins that spread hot keys over many tasks.

Joins to rows of which there are few per key: a key with more than ``hot_rows``
rows on the large side gets several slots; its large-side rows are dealt out
over the slots, its small-side rows are copied to each of them.

Joins where both sides may have many rows of a key: the key gets a grid of
slots. Its left rows are dealt out over the grid's rows and copied along them,
its right rows over the columns, so each pair meets in one slot and no slot
makes more than about ``side`` times ``side`` pairs.

No row is lost and no pair is made twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.durable import delete_path, durable, fresh_path, write_and_read

HOT_ROWS = 100_000
#: A slot of a grid has about as many rows of each side: 64 million pairs.
GRID_SIDE = 8_000
_WHOLE_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
SLOT = "_slot"
SLOTS = "_slots"
GRID_ROW, GRID_COLUMN = "_grid_row", "_grid_column"
GRID_ROWS, GRID_COLUMNS = "_grid_rows", "_grid_columns"


def hot_keys(large: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and their slot count; None when there are none.

    At most ``rows / hot_rows`` keys can be hot, so the table stays far smaller
    than the data it is joined to.
    """
    counts = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where(F.col("_rows") > hot_rows).select(
        *keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias(SLOTS)
    )
    return None if hot.isEmpty() else hot


def deal_out(large: DataFrame, hot: DataFrame, keys: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Add the slot of each large-side row, chosen by the hash of ``spread_by``."""
    slots = F.coalesce(F.col(SLOTS), F.lit(1))
    return (
        large.join(hot, list(keys), "left")
        .withColumn(SLOT, F.pmod(F.hash(*spread_by), slots))
        .drop(SLOTS)
    )


def copy_to_slots(small: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeat each small-side row for every slot of its key."""
    slots = F.coalesce(F.col(SLOTS), F.lit(1))
    return (
        small.join(hot, list(keys), "left")
        .withColumn(SLOT, F.explode(F.sequence(F.lit(0), slots - 1)))
        .drop(SLOTS)
    )


def spread_join(
    large: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``large`` joined to ``small`` on ``keys``, with the hot keys of ``large`` split.

    ``how`` may be ``inner``, ``left``, ``left_semi`` or ``left_anti``: with
    these every large-side row decides alone, so splitting keeps the result.
    """
    keys = list(keys)
    hot = hot_keys(large, keys, hot_rows)
    if hot is None:
        return large.join(small, keys, how)
    hot = durable(hot, "hubs")
    return (
        deal_out(large, hot, keys, spread_by)
        .join(copy_to_slots(small, hot, keys), [*keys, SLOT], how)
        .drop(SLOT)
    )


def grid_of(left: DataFrame, right: DataFrame, keys: Sequence[str], side: int = GRID_SIDE) -> DataFrame | None:
    """Keys with more than ``side`` squared pairs and the grid of each, stored; None when there are none.

    One pass counts both sides. A side with few rows is not split, and the other one then
    gets as many slots as the pairs ask for.
    """
    ends = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counts = ends.groupBy(*keys).agg(F.sum("_l").cast("double").alias("_l"), F.sum("_r").cast("double").alias("_r"))
    most = float(side) * side
    slots = F.expr(f"_l * _r / double({most!r})")
    rows = F.when(F.col("_l") <= side, F.lit(1.0)).when(F.col("_r") <= side, slots).otherwise(F.col("_l") / side)
    columns = F.when(F.col("_r") <= side, F.lit(1.0)).when(F.col("_l") <= side, slots).otherwise(F.col("_r") / side)
    hubs = counts.where(F.col("_l") * F.col("_r") > most).select(
        *keys, F.ceil(rows).cast("int").alias(GRID_ROWS), F.ceil(columns).cast("int").alias(GRID_COLUMNS)
    )
    path = fresh_path(left.sparkSession, "hubs")
    stored, seen = write_and_read(hubs, path, hubs=F.count(F.lit(1)))
    if seen["hubs"]:
        return stored
    delete_path(left.sparkSession, path)
    return None


def onto_grid(left: DataFrame, right: DataFrame, hubs: DataFrame, keys: Sequence[str], left_by: Sequence[str], right_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the slots of each row; rows of other keys have one slot."""
    keys = list(keys)
    rows, columns = F.coalesce(GRID_ROWS, F.lit(1)), F.coalesce(GRID_COLUMNS, F.lit(1))
    left = left.join(hubs, keys, "left").withColumns({
        GRID_ROW: F.pmod(F.hash(*left_by), rows), GRID_COLUMN: F.explode(F.sequence(F.lit(0), columns - 1))
    })
    right = right.join(hubs, keys, "left").withColumns({
        GRID_COLUMN: F.pmod(F.hash(*right_by), columns), GRID_ROW: F.explode(F.sequence(F.lit(0), rows - 1))
    })
    return left.drop(GRID_ROWS, GRID_COLUMNS), right.drop(GRID_ROWS, GRID_COLUMNS)


def join_in_place(spark: SparkSession) -> None:
    """Let joins run where both sides already lie together by some of the join's keys.

    Paths that come out of a window or an aggregation of their groups are then extended without
    being shuffled again. Rows that are placed in no such way are spread by all keys as before.
    """
    if spark.conf.get(_WHOLE_KEYS, "true") == "true":
        spark.conf.set(_WHOLE_KEYS, "false")


def meeting_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_by: Sequence[str], right_by: Sequence[str],
    side: int = GRID_SIDE, most_pairs: int | None = None,
) -> DataFrame:
    """All pairs of left and right rows with equal keys; keys with many pairs are split on both sides.

    ``left_by`` and ``right_by`` tell the rows of a key apart. With ``most_pairs``, the most
    that a single key can have, nothing is counted where no key can be too large.
    """
    join_in_place(left.sparkSession)
    hubs = None
    if most_pairs is None or most_pairs > side * side:
        hubs = grid_of(left, right, keys, side)
    if hubs is None:
        return left.join(right, list(keys))
    # Slots of a key are placed apart, also where its rows came together.
    slots = [*keys, GRID_ROW, GRID_COLUMN]
    left, right = (rows.repartition(*slots) for rows in onto_grid(left, right, hubs, keys, left_by, right_by))
    return left.join(right, slots).drop(GRID_ROW, GRID_COLUMN)
