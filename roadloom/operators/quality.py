"""Checks on the input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.cells import (
    BASE_CELL_SHIFT, BITS_PER_DIGIT, FINEST_RESOLUTION, RESOLUTION_MASK, RESOLUTION_SHIFT,
)

# The accepted percentage of missing values, and the index layout
# of a cell (top bit 0, mode 1 in four bits, three reserved bits 0, base cells 0-121,
# digit 7 unused). Twelve base cells are pentagons, which lack the subtree of digit 1.
MAX_MISSING_PERCENT = 5.0
TOP_BIT_SHIFT = 63
MODE_SHIFT, MODE_MASK, CELL_MODE = 59, 15, 1
RESERVED_SHIFT, RESERVED_MASK = 56, 7
BASE_CELL_MASK = 127
BASE_CELLS = 122
UNUSED_DIGIT = 7
PENTAGON_BASE_CELLS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
DELETED_DIGIT = 1


def missing_share(df: DataFrame, columns: Sequence[str], limit: float = MAX_MISSING_PERCENT) -> DataFrame:
    """Percentage of NULLs per required column, and whether it is within the limit."""
    shares = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in columns])
    pairs = [item for c in columns for item in (F.lit(c), F.col(c))]
    return shares.select(
        F.stack(F.lit(len(columns)), *pairs).alias("column_name", "missing_percent")
    ).withColumn("within_limit", F.col("missing_percent") <= F.lit(float(limit)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def orphan_arcs(arcs: DataFrame, edges: DataFrame) -> DataFrame:
    """Arcs with an unknown edge, and at which end."""
    known = edges.select("id").distinct()
    sources = known.select(F.col("id").alias("incoming_edge"), F.lit(True).alias("_source"))
    targets = known.select(F.col("id").alias("outgoing_edge"), F.lit(True).alias("_target"))
    return (
        arcs.select("incoming_edge", "outgoing_edge")
        .join(sources, "incoming_edge", "left")
        .join(targets, "outgoing_edge", "left")
        .where(F.col("_source").isNull() | F.col("_target").isNull())
        .select(
            "incoming_edge",
            "outgoing_edge",
            F.col("_source").isNull().alias("unknown_incoming"),
            F.col("_target").isNull().alias("unknown_outgoing"),
        )
    )


def cell_fault(cell: str) -> Column:
    """Why a cell breaks the index layout; NULL for good cells and for cell 0.

    The parts are looked at in this order, and the first that is broken is named:
    ``missing``, ``top bit``, ``mode``, ``reserved bits``, ``base cell``, ``digit`` (one up to
    the cell's resolution is unused), ``finer digit`` (one beyond it is used), ``deleted
    subsequence`` (in a pentagon, the first digit that is not 0 is 1).
    """
    def bits(shift: int, mask: int) -> str:
        return f"(shiftrightunsigned({cell}, {shift}) & {mask})"

    res = bits(RESOLUTION_SHIFT, RESOLUTION_MASK)
    base = bits(BASE_CELL_SHIFT, BASE_CELL_MASK)
    digits = [bits(BITS_PER_DIGIT * (FINEST_RESOLUTION - level), UNUSED_DIGIT) for level in range(1, FINEST_RESOLUTION + 1)]
    unused = " OR ".join(f"({res} >= {level} AND {digit} = {UNUSED_DIGIT})" for level, digit in enumerate(digits, 1))
    used = " OR ".join(f"({res} < {level} AND {digit} <> {UNUSED_DIGIT})" for level, digit in enumerate(digits, 1))
    # The digits of the cell's own levels, finer ones cleared: the highest bit lies in the first digit that is not 0.
    position = f"({cell} & {(1 << BASE_CELL_SHIFT) - 1}L)"
    own = f"shiftright({position}, {BITS_PER_DIGIT} * ({FINEST_RESOLUTION} - CAST({res} AS INT)))"
    first = f"CAST(floor((length(bin({own})) - 1) / {BITS_PER_DIGIT}) AS INT)"
    deleted = f"{own} > 0 AND shiftright({own}, {BITS_PER_DIGIT} * {first}) = {DELETED_DIGIT}"
    return F.expr(f"""CASE WHEN {cell} IS NULL THEN 'missing' WHEN {cell} = 0 THEN NULL
        WHEN {bits(TOP_BIT_SHIFT, 1)} <> 0 THEN 'top bit' WHEN {bits(MODE_SHIFT, MODE_MASK)} <> {CELL_MODE} THEN 'mode'
        WHEN {bits(RESERVED_SHIFT, RESERVED_MASK)} <> 0 THEN 'reserved bits' WHEN {base} >= {BASE_CELLS} THEN 'base cell'
        WHEN {unused} THEN 'digit' WHEN {used} THEN 'finer digit'
        WHEN {base} IN {PENTAGON_BASE_CELLS} AND {deleted} THEN 'deleted subsequence' END""")


def is_valid_cell(cell: str, pentagons: bool = True) -> Column:
    """True for cells that follow the index layout; cell 0 counts as valid.

    Without ``pentagons``, their deleted subsequences count as valid as well.
    """
    fault = cell_fault(cell)
    return fault.isNull() | (F.lit(not pentagons) & (fault == "deleted subsequence"))


def cell_faults(edges: DataFrame, columns: Sequence[str] = ("incoming_cell", "outgoing_cell")) -> DataFrame:
    """A row per broken cell: the edge, the column, the cell and the reason."""
    faults = [F.struct(F.lit(name).alias("column_name"), F.col(name).alias("cell"), cell_fault(name).alias("reason")) for name in columns]
    return edges.select("id", F.inline(F.array(*faults))).where("reason IS NOT NULL")


def fault_counts(edges: DataFrame, columns: Sequence[str] = ("incoming_cell", "outgoing_cell")) -> DataFrame:
    """How many cells of each column are broken, by reason."""
    return cell_faults(edges, columns).groupBy("column_name", "reason").agg(F.count(F.lit(1)).alias("rows"))


def invalid_cells(edges: DataFrame, columns: Sequence[str] = ("incoming_cell", "outgoing_cell")) -> DataFrame:
    """Edges with a cell that is missing or breaks the index layout; ``cell_faults`` also looks at pentagons."""
    bad = F.lit(False)
    for name in columns:
        bad = bad | ~is_valid_cell(name, pentagons=False)
    return edges.where(bad).select("id", *columns)
