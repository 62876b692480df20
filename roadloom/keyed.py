"""Tables kept in buckets of their key, as layers.

The rows of a layer lie in as many hash buckets of the key as the session shuffles to, so a
join or an aggregation by the key reads them where they are: only what is joined with them
is shuffled. A round of a loop adds a layer with its improvements and rewrites nothing.
Layers that have become many are merged, again without a shuffle: the later ones with each
other, and all of them once the later ones are half as large as the first.

Layers are Parquet files in the shared folder. Spark keeps buckets for named tables only, so
each gets a name for the moment it takes to read it; the files stay as long as the folder does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadloom.durable import fresh_path, write_and_read

MOST_LAYERS = 6
BUCKET_ROWS = 100_000


def write_in_buckets(df: DataFrame, path: str, keys: Sequence[str], **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` stored at ``path`` in buckets of its ``keys``, with observed metrics."""
    spark = df.sparkSession
    observation = Observation()
    if metrics:
        df = df.observe(observation, *[column.alias(name) for name, column in metrics.items()])
    name = f"roadloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
        stored = spark.table(name)
    finally:
        # The files are not the table's: they stay.
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return stored, observation.get if metrics else {}


def _write_plain(df: DataFrame, path: str, keys: Sequence[str], **metrics: Column) -> tuple[DataFrame, dict]:
    return write_and_read(df, path, **metrics)


class Layers:
    """A growing table in buckets of its key; of the rows of a key, ``merge`` makes one.

    With few rows plain files serve as well and take less time to write: layers are laid out
    in buckets once the first one has ``BUCKET_ROWS``, which changes no row.
    """

    def __init__(self, spark: SparkSession, name: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.name, self.keys, self.merge = spark, name, list(keys), merge
        self.layers: list[tuple[DataFrame, int]] = []

    def add(self, df: DataFrame, rows: Column, **metrics: Column) -> tuple[DataFrame, dict]:
        """Store ``df`` as a layer; ``rows`` counts its rows."""
        write = write_in_buckets if self.layers and self.layers[0][1] >= BUCKET_ROWS else _write_plain
        layer, seen = write(df, fresh_path(self.spark, self.name), self.keys, rows=rows, **metrics)
        self.layers.append((layer, seen["rows"]))
        return layer, seen

    def put(self, layer: DataFrame, rows: int) -> None:
        """A layer that is stored already."""
        self.layers.append((layer, rows))

    @property
    def rows(self) -> int:
        """The rows of all layers, at least as many as there are keys."""
        return sum(rows for _, rows in self.layers)

    def all(self) -> DataFrame:
        """The rows of all layers: a key's rows may be several."""
        return reduce(DataFrame.unionByName, [layer for layer, _ in self.layers])

    def without_matched(self, rows: DataFrame, value: str) -> DataFrame:
        """``rows`` without those whose key is in a layer with the same or a lower ``value``.

        Layer after layer is joined where it lies, so ``rows`` are shuffled once, or not at
        all if they come by the same keys.
        """
        for layer, _ in self.layers:
            new, known = rows.alias("new"), layer.select(*self.keys, value).alias("known")
            same = [F.col(f"new.{name}") == F.col(f"known.{name}") for name in self.keys]
            rows = new.join(known, [*same, F.col(f"known.{value}") <= F.col(f"new.{value}")], "left_anti")
        return rows

    def merged(self) -> DataFrame:
        """One row per key."""
        return self.layers[0][0] if len(self.layers) == 1 else self.merge(self.all())

    def compact(self, rows: Column, most: int = MOST_LAYERS) -> None:
        """Merge layers if they are more than ``most``."""
        if len(self.layers) <= max(1, most):
            return
        first, later = self.layers[0], self.layers[1:]
        if 2 * sum(rows for _, rows in later) > first[1]:
            self.add(self.merged(), rows)
            self.layers = self.layers[-1:]
        else:
            self.layers = later
            together = self.merged()
            self.layers = [first]
            self.add(together, rows)
