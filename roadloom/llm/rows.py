"""Passing rows through Python workers in small parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadloom.llm.shipping import ship_package
from roadloom.llm.words import text_slices


def release_memory() -> None:
    """Give what Arrow holds for later back: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()


def parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, so many at a time as have a megabyte of text in column ``text``."""
    for batch in batches:
        for first, count in text_slices(batch.column(text)):
            yield batch.slice(first, count)
    release_memory()


def by_place(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by their place, whatever their names are."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def keep_rows(docs: DataFrame, text: str, wanted: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose texts are ``wanted``, columns as they were."""
    ship_package(docs.sparkSession)
    plain, at = by_place(docs), docs.columns.index(text)

    def run(batches):
        for part in parts(batches, at):
            yield part.filter(pa.array(wanted(part.column(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
