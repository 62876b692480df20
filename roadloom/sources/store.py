"""Reading and writing shortcut tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from roadloom import schemas
from roadloom.durable import list_names, read_text, write_and_read, write_text


def write_shortcuts(shortcuts: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a Parquet table, optionally in one folder per partition value."""
    writer = shortcuts.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_shortcuts(
    spark: SparkSession, path: str, schema: T.StructType = schemas.FINAL_SHORTCUTS
) -> DataFrame:
    """A stored shortcut table with its declared schema."""
    return spark.read.schema(schema).parquet(path)


def append_snapshot(shortcuts: DataFrame, path: str) -> None:
    """Add one step's rows to a table laid out by pass and resolution; a step that is repeated replaces its own."""
    shortcuts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pass_name", "resolution").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV table with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table this library wrote, columns in the order of the schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


class VersionedTable:
    """A stored table whose partitions are replaced without touching the files of others.

    ``path`` holds data folders and manifests. A manifest lists the layers in order: each has
    a folder of rows and, from the second on, a folder with the keys of the partitions it
    replaces. A replacement writes the new rows and their keys, and as its last act the next
    manifest; readers use the newest one, so a replacement that fails changes nothing. A
    partition's rows are those of the last layer that replaces it. ``compact`` writes all
    rows once as a single layer.

    Replaced keys are matched NULL to NULL.
    """

    def __init__(self, spark: SparkSession, path: str, partition_columns: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(partition_columns)

    def _manifests(self) -> list[str]:
        return sorted(name for name in list_names(self.spark, self.path) if name.startswith("manifest-"))

    def layers(self) -> list[dict]:
        """The folders of the newest version, oldest layer first."""
        found = self._manifests()
        return json.loads(read_text(self.spark, f"{self.path}/{found[-1]}"))["layers"] if found else []

    def _publish(self, layers: list[dict], schema: T.StructType) -> None:
        number = int(self._manifests()[-1].split("-")[1].split(".")[0]) + 1 if self._manifests() else 0
        write_text(self.spark, f"{self.path}/manifest-{number:06d}.json", json.dumps({"layers": layers, "schema": schema.jsonValue()}))

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(read_text(self.spark, f"{self.path}/{self._manifests()[-1]}"))["schema"])

    def create(self, rows: DataFrame) -> "VersionedTable":
        """The first version."""
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        self._publish([{"rows": name, "keys": None}], rows.schema)
        return self

    def replace(self, rows: DataFrame) -> "VersionedTable":
        """Every partition that occurs in ``rows`` now has these rows; only they are written."""
        layers, schema, mark = self.layers(), self._schema(), uuid.uuid4().hex
        stored, _ = write_and_read(rows.select(*schema.names), f"{self.path}/rows-{mark}")
        stored.select(*self.keys).distinct().write.parquet(f"{self.path}/keys-{mark}")
        self._publish([*layers, {"rows": f"rows-{mark}", "keys": f"keys-{mark}"}], schema)
        return self

    def read(self) -> DataFrame:
        layers, schema = self.layers(), self._schema()
        if len(layers) == 1:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{layers[0]['rows']}")
        key_schema = T.StructType([schema[name] for name in self.keys])
        parts = []
        for i, layer in enumerate(layers):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{layer['rows']}")
            later = [f"{self.path}/{x['keys']}" for x in layers[i + 1 :]]
            if later:
                replaced = self.spark.read.schema(key_schema).parquet(*later).distinct().toDF(*[f"_replaced_{name}" for name in self.keys])
                same = [rows[name].eqNullSafe(replaced[f"_replaced_{name}"]) for name in self.keys]
                rows = rows.join(replaced, same, "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def compact(self) -> "VersionedTable":
        """All rows as one layer; older folders stay for readers of older versions."""
        name, schema = f"rows-{uuid.uuid4().hex}", self._schema()
        self.read().write.parquet(f"{self.path}/{name}")
        self._publish([{"rows": name, "keys": None}], schema)
        return self
