"""Bringing recomputed paths back into the main table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from roadloom.operators.paths import SHORTCUT, PathColumns


def merge_shortcuts(main: DataFrame, new: DataFrame, columns: PathColumns = SHORTCUT) -> DataFrame:
    """New rows replace main rows of the same pair, whatever their cost; the rest stays."""
    main, new = main.select(*columns.all), new.select(*columns.all)
    remaining = main.join(new.select(*columns.keys).distinct(), columns.keys, "left_anti")
    return remaining.unionByName(new)


def merge_partitions(main: DataFrame, new: DataFrame, partition_columns: Sequence[str]) -> DataFrame:
    """Partitions that occur in ``new`` are replaced as a whole; the others stay."""
    recomputed = new.select(*partition_columns).distinct()
    remaining = main.join(recomputed, list(partition_columns), "left_anti")
    return remaining.unionByName(new.select(*remaining.columns))
