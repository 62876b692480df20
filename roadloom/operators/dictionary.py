"""Dense numbers for ids of any type, so that joins and loops work on longs.

The distinct ids are put into ranges of their order, the ids of each range are counted, and
the sums of the ranges before it tell where its numbers begin: ids are numbered 0, 1, 2 ...
in their order, and no task sees more than one range. An id that occurs many times, or in
several columns, has one number. NULL is no id: it gets no number and stays NULL in both
directions. The lower of two ids has the lower number, so "the lowest hop" means the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.durable import durable
from roadloom.operators.closure import closure
from roadloom.operators.paths import PathColumns

ID, NUMBER = "id", "number"


def numbered(*columns: DataFrame) -> DataFrame:
    """``(id, number)`` for the distinct values of one-column frames, stored."""
    ids = reduce(DataFrame.union, [c.toDF(ID) for c in columns]).where(F.col(ID).isNotNull()).distinct()
    ranged = durable(ids.repartitionByRange(ID).withColumn("_range", F.spark_partition_id()), "ids")
    # One row per range: their number is set by the session, not by the data.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_ids")).select(
        "_range", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_begin")
    )
    inside = Window.partitionBy("_range").orderBy(ID)
    placed = ranged.join(F.broadcast(begins), "_range")
    return durable(placed.select(ID, (F.col("_begin") + F.row_number().over(inside) - 1).alias(NUMBER)), "dictionary")


def to_numbers(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the ids in ``columns`` replaced by their numbers; unknown ids become NULL.

    An id has one row in the dictionary, so the planner may split hot ids of ``df``.
    """
    return _replaced(df, dictionary.select(F.col(ID).alias("_from"), F.col(NUMBER).alias("_to")), columns)


def to_ids(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the numbers in ``columns`` replaced by their ids."""
    return _replaced(df, dictionary.select(F.col(NUMBER).alias("_from"), F.col(ID).alias("_to")), columns)


def _replaced(df: DataFrame, pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    for name in columns:
        joined = df.join(pairs, df[name] == pairs["_from"], "left")
        df = joined.select(*[F.col("_to").alias(name) if c == name else df[c] for c in df.columns])
    return df


def closure_by_numbers(paths: DataFrame, columns: PathColumns, **how) -> DataFrame:
    """``closure`` of a table whose ids, and whose groups if they are text, are costly to compare.

    Ids and each group column are numbered, the loop joins longs only, and its result gets
    the ids back. Rows with a NULL id or group are no part of any path and left out.
    """
    paths = durable(paths.select(*columns.all), "paths")
    ends = (columns.source, columns.target, columns.hop)
    dictionaries = {name: numbered(paths.select(name)) for name in columns.groups}
    nodes = numbered(*[paths.select(name) for name in ends])
    table = to_numbers(paths, nodes, ends)
    for name, dictionary in dictionaries.items():
        table = to_numbers(table, dictionary, [name])
    known = [F.col(name).isNotNull() for name in (columns.source, columns.target, *columns.groups)]
    closed = closure(table.where(reduce(lambda a, b: a & b, known)), columns, **how)
    for name, dictionary in dictionaries.items():
        closed = to_ids(closed, dictionary, [name])
    return to_ids(closed, nodes, ends)
