"""Chat formatting of logged conversations, of which only the longest snapshots are kept.

Chat logs often hold a conversation again and again, each time with some turns more. A
conversation whose turns are the first turns of a longer one is dropped; of conversations
with equal turns the one with the smallest id stays. Each turn gets a hash of its place,
role and text; the exclusive or of the hashes up to a turn is the rolling hash of that
prefix. A conversation is dropped if its own hash is that of a shorter prefix elsewhere,
which an anti-join tells.

Everything is done with DataFrame functions. Turns are put in order by ranges of
(conversation, turn, role, text), and places and rolling hashes are carried over from
range to range, so that no conversation has to fit into one task.

A conversation's turns are ordered by ``turn``, null first, then role and text; equal rows
count once. A null role or text is a turn like others, different from an empty one, and is
rendered as empty. Rows with a null conversation id belong to no conversation and are left
out. A rendered conversation is one row of at most ``PIECE_TURNS`` turns; a longer one goes
on in further rows numbered by ``piece``, whose texts put together are the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.durable import durable, tidy

PIECE_TURNS = 1024
#: What is put before the role, between role and text, and after the text.
MARKS = ("<|im_start|>", "\n", "<|im_end|>\n")
_HASHES = ("_h1", "_h2")
_TURN = ("turn", "role", "text")


def _earlier():
    """The earlier parts of a conversation: no more than there are partitions."""
    return Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


@tidy("placed-turns")
def placed_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place in the conversation, stored; ``_part`` numbers the ranges of the order."""
    rows = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id", *_TURN).agg(F.count(F.lit(1)).alias("_copies")).drop("_copies")
    ranged = durable(rows.repartitionByRange("conv_id", *_TURN).withColumn("_part", F.spark_partition_id()), "turns")
    here = Window.partitionBy("_part", "conv_id").orderBy(*_TURN)
    sizes = ranged.groupBy("_part", "conv_id").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", "conv_id", F.coalesce(F.sum("_size").over(_earlier()), F.lit(0)).alias("_before"))
    return ranged.join(before, ["_part", "conv_id"]).withColumn("place", F.col("_before") + F.row_number().over(here)).drop("_before")


def rolling_hashes(placed: DataFrame) -> DataFrame:
    """``(conv_id, place)`` with two independent hashes of the turns up to that place, stored."""
    content = [F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit(""))]
    hashed = placed.select(
        "_part", "conv_id", "place", F.xxhash64("place", *content).alias("_h1"), F.xxhash64(F.lit("other"), *reversed(content), "place").alias("_h2")
    )
    whole = hashed.groupBy("_part", "conv_id").agg(*(F.bit_xor(h).alias(h) for h in _HASHES))
    carried = whole.select("_part", "conv_id", *(F.coalesce(F.bit_xor(h).over(_earlier()), F.lit(0)).alias(f"{h}_before") for h in _HASHES))
    so_far = Window.partitionBy("_part", "conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.join(carried, ["_part", "conv_id"]).select(
        "conv_id", "place", *(F.bit_xor(h).over(so_far).bitwiseXOR(F.col(f"{h}_before")).alias(h) for h in _HASHES)
    )
    return durable(rolled, "rolling")


@tidy("maximal")
def maximal_conversations(placed: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_equal)`` of the conversations that stay; ``n_equal`` have the same turns."""
    rolling = rolling_hashes(placed)
    sizes = rolling.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    # The rows at a conversation's end, and the prefixes that end before it.
    ends = rolling.join(sizes.withColumnRenamed("n_turns", "place"), ["conv_id", "place"])
    inner = rolling.join(sizes.withColumnRenamed("n_turns", "_last"), "conv_id").where("place < _last")
    distinct_ends = ends.groupBy("place", *_HASHES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    prefixes = inner.groupBy("place", *_HASHES).agg(F.count(F.lit(1)).alias("_seen")).drop("_seen")
    return distinct_ends.join(prefixes, ["place", *_HASHES], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal")


def render(placed: DataFrame, kept: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """The kept conversations as text: ``(conv_id, piece, n_turns, n_equal, text)``."""
    rows = placed.join(kept, "conv_id")
    begin, middle, end = MARKS
    line = F.concat(F.lit(begin), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end))
    piece = F.expr(f"CAST((place - 1) DIV {piece_turns} AS INT)")
    return rows.groupBy("conv_id", piece.alias("piece"), "n_turns", "n_equal").agg(
        F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("_lines")
    ).select("conv_id", "piece", "n_turns", "n_equal", F.array_join("_lines.line", "").alias("text"))


def formatted(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """The maximal conversations, rendered."""
    placed = placed_turns(turns.select("conv_id", *_TURN))
    return render(placed, maximal_conversations(placed), piece_turns)
