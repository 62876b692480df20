"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket(doc_id: str, buckets: int):
    """CRC-32 of the id written as text, modulo ``buckets``; null ids count as bucket 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(buckets)), F.lit(0)).cast("int")


def among_lowest(hashed, wanted: int, rows: int):
    """Whether a 64-bit hash is so low that some more than ``wanted`` of ``rows`` distinct ones are.

    Tasks then send a fair share of the sample to the driver, not the whole size of it each.
    """
    share = min(1.0, (1.2 * wanted + 100) / max(1, rows))
    return F.lit(True) if share == 1.0 else hashed < F.lit(int(share * 2**64) - 2**63)


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed, max_rows: int) -> DataFrame:
    """``(doc_id, label, text, place)`` of at most ``max_rows`` labelled documents.

    The ids with the lowest hashes are taken, so the sample does not depend on how rows are
    laid out; ``place`` is that hash. Ids that are null or not ``allowed``, and null labels,
    are left out. An id with several labels takes the highest, one with several texts the
    lowest.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed).withColumn("place", F.xxhash64("doc_id"))
    chosen = (
        usable.where(among_lowest(F.col("place"), max_rows, usable.select("doc_id").distinct().count()))
        .groupBy("doc_id", "place").agg(F.max(label).cast("int").alias("label"))
        .orderBy("place").limit(max_rows)
    )
    # At most max_rows narrow rows, so every task can have them.
    return (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label", "place").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
