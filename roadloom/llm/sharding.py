"""Contiguous shards of near equal bytes.

Rows are put in the order of their id by range partitions. Each partition's bytes and
rows are summed, the sums of the partitions before it are its offsets, and so every row
knows how many bytes come before it although no task sees more than one partition. A row
belongs to the shard in which its middle byte falls when all bytes are cut at equal
targets, so a shard misses its target by less than its two outermost rows.

Null ids come first. Rows of one id are ordered by their text's hash and size, then as
they were read; of equal rows it doesn't matter which is which. A null text has no bytes.
If some rows are larger than a shard's target, shards may stay empty. Only the columns
named in ``carry`` go along; the result's own names win over theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.durable import durable

SHARDS = 24
#: Bytes that a row costs besides its text.
ROW_BYTES = 8


def ordered(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Id, size and checksum of each row, stored by ranges of the order; ``part`` is the range's number."""
    own = {"doc_id", "size", "text_crc32"}
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"),
        *(F.col(c) for c in carry if c not in own),
    )
    by_order = rows.repartitionByRange("doc_id", "_hash", "size", "_row")
    return durable(by_order.withColumn("_part", F.spark_partition_id()), "ordered")


def balanced_shards(
    docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """A row per document with its ``shard`` and its ``slot``, its place in the shard."""
    rows = ordered(docs, doc_id, text, carry)
    # One row per partition: their number is set by the session, not by the data.
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy("doc_id", "_hash", "size", "_row")
    placed = rows.join(F.broadcast(offsets), "_part").select(
        "*",
        (F.col("_bytes_before") + F.sum("size").over(inside) - F.col("size")).alias("_start"),
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_place"),
    )
    cut = placed.withColumn(
        "shard", F.expr(f"CAST(((2 * CAST(_start AS DECIMAL(38, 0)) + size) * {shards}) DIV (2 * _total) AS INT)")
    )
    # One row per shard.
    firsts = cut.groupBy("shard").agg(F.min("_place").alias("_first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        *(c for c in ("doc_id", *carry) if c not in ("size", "text_crc32", "shard", "slot")),
        "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """The documents as Parquet under ``path``, one folder per shard, in order inside it."""
    wanted = ("size", "text_crc32", "shard", "slot")
    carry = tuple(c for c in docs.columns if c != doc_id and c not in wanted)
    placed = balanced_shards(docs, shards, doc_id, text, carry)
    # A shard is a contiguous range, so ranges of (shard, slot) write each shard from few tasks.
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assignment(docs: DataFrame) -> DataFrame:
    """The shard of each document under the law of equal bytes."""
    return balanced_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
