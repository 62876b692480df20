"""Tables that outlive executors: how loops cut their lineage.

An iterative job writes its state once per round as Parquet in the shared
folder named by ``spark.checkpoint.dir`` and goes on from the files. A lost
executor then costs one round at most, column pruning works on the state, and
Spark knows its real size. Superseded rounds are deleted once their successor
is complete.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only on local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roadloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_folder: ContextVar[str] = ContextVar("folder", default="roadloom")


def current_folder() -> str:
    """The folder that ``fresh_path`` uses here."""
    return _folder.get()


def fresh_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{folder or _folder.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside the block are deleted when it ends."""
    folder = f"roadloom/scratch-{uuid.uuid4().hex}"
    outer = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(outer)
        delete_path(spark, f"{shared_folder(spark)}/{folder}")


def tidy(name: str):
    """A decorator: what a function stores on its way is deleted, its result is stored and returned.

    The function's first argument is a DataFrame, and so is its result.
    """

    def around(work):
        @wraps(work)
        def run(first: DataFrame, *args, **kwargs) -> DataFrame:
            spark, outside = first.sparkSession, _folder.get()
            with scratch(spark):
                return write_and_read(work(first, *args, **kwargs), fresh_path(spark, name, outside))[0]

        return run

    return around


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, files = _hadoop_path(spark, path)
    return files.exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path, files = _hadoop_path(spark, path)
    files.delete(hadoop_path, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none if there is no such folder."""
    hadoop_path, files = _hadoop_path(spark, path)
    return [status.getPath().getName() for status in files.listStatus(hadoop_path)] if files.exists(hadoop_path) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears under its name once it is whole."""
    hadoop_path, files = _hadoop_path(spark, path)
    unfinished, _ = _hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(unfinished)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not files.rename(unfinished, hadoop_path):
        raise OSError(f"{path} cannot be written")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file that ``write_text`` wrote."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_and_read(df: DataFrame, path: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` to ``path`` and return the stored table with observed metrics.

    The metrics ride along with the write, so counting costs no further job.
    """
    spark = df.sparkSession
    if metrics:
        observation = Observation()
        named = [column.alias(name) for name, column in metrics.items()]
        df.observe(observation, *named).write.parquet(path)
        measured = observation.get
    else:
        df.write.parquet(path)
        measured = {}
    return read_stored(spark, path, df.schema), measured


def read_stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table stored at ``path``, which ``stored_at`` tells of it."""
    stored = spark.read.schema(schema).parquet(path)
    stored._stored_at = path
    return stored


def stored_at(df: DataFrame) -> str | None:
    """The folder of a table that is as it was read from there; None for whatever was made of it."""
    return vars(df).get("_stored_at")


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` stored in the shared folder, with its lineage cut."""
    return write_and_read(df, fresh_path(df.sparkSession, name))[0]


class Rounds:
    """The stored states of one loop; the newest one is kept."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name
        self._in_folder = _folder.get()
        self._newest: str | None = None
        self._superseded: str | None = None

    @property
    def newest_path(self) -> str | None:
        return self._newest

    def save(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        path = fresh_path(self.spark, self.name, self._in_folder)
        stored, measured = write_and_read(df, path, **metrics)
        self.drop_superseded()
        self._superseded, self._newest = self._newest, path
        return stored, measured

    def keep_superseded(self) -> None:
        """Leave the state before the newest in place for good."""
        self._superseded = None

    def drop_superseded(self) -> None:
        """Delete the state before the newest."""
        if self._superseded is not None:
            delete_path(self.spark, self._superseded)
            self._superseded = None

    def drop_all(self) -> None:
        """Delete what is left."""
        self.drop_superseded()
        if self._newest is not None:
            delete_path(self.spark, self._newest)
            self._newest = None
