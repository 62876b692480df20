"""Cell arithmetic as native expressions.

A cell is a 64-bit index: bits 52-55 hold the resolution, bits 45-51 the base
cell, then fifteen 3-bit digits follow, coarsest first. Digits finer than the
resolution are all ones. Cell 0 stands for "no cell".

The functions take column names, or any SQL expressions, and return columns;
the ``*_sql`` forms return the expression for use inside another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the public cell index layout.
FINEST_RESOLUTION = 15
RESOLUTION_SHIFT = 52
BASE_CELL_SHIFT = 45
BITS_PER_DIGIT = 3
RESOLUTION_MASK = 15

WITHOUT_RESOLUTION = ~(RESOLUTION_MASK << RESOLUTION_SHIFT)
POSITION_MASK = (1 << RESOLUTION_SHIFT) - 1


def _bits_sql(cell: str) -> str:
    return f"CAST(shiftright({cell}, {RESOLUTION_SHIFT}) & {RESOLUTION_MASK} AS INT)"


def _at_level_sql(cell: str, res: str | int) -> str:
    """A cell moved to a level between 0 and its own: finer digits become ones."""
    if isinstance(res, int):
        finer_ones = (1 << (BASE_CELL_SHIFT - BITS_PER_DIGIT * res)) - 1
        return f"(({cell} & {WITHOUT_RESOLUTION}L) | {(res << RESOLUTION_SHIFT) | finer_ones}L)"
    finer_ones = f"(shiftleft(1L, {BASE_CELL_SHIFT} - {BITS_PER_DIGIT} * CAST({res} AS INT)) - 1L)"
    level = f"shiftleft(CAST({res} AS BIGINT), {RESOLUTION_SHIFT})"
    return f"(({cell} & {WITHOUT_RESOLUTION}L) | {level} | {finer_ones})"


def resolution_sql(cell: str) -> str:
    return f"IF({cell} = 0, -1, {_bits_sql(cell)})"


def ancestor_sql(cell: str, res: str | int) -> str:
    if isinstance(res, int) and res < 0:
        return "0L"
    none = "" if isinstance(res, int) else f"WHEN {res} < 0 THEN 0L "
    return (
        f"CASE {none}WHEN {cell} = 0 OR {_bits_sql(cell)} <= {res} THEN {cell} "
        f"ELSE {_at_level_sql(cell, res)} END"
    )


def _shared_sql(left: str, right: str) -> str:
    # The highest differing bit lies in the first digit that differs, or in the
    # base cell. A one appended below it makes "nothing differs" one bit long.
    differing = f"(shiftleft(({left} ^ {right}) & {POSITION_MASK}L, 1) | 1L)"
    # Without ones that follow a one the logarithm is at most 0.42 above the highest bit's number:
    # with a quarter added it never rounds to another one.
    highest = f"(log2({differing} & ~shiftright({differing}, 1)) + 0.25D)"
    agreeing = f"{FINEST_RESOLUTION - 1} - CAST(floor(({highest} - 1.0D) / {float(BITS_PER_DIGIT)}D) AS INT)"
    return f"least({agreeing}, {_bits_sql(left)}, {_bits_sql(right)})"


def common_resolution_sql(left: str, right: str) -> str:
    return f"CASE WHEN {left} IS NOT NULL AND {right} IS NOT NULL THEN IF({left} = 0 OR {right} = 0, -1, greatest({_shared_sql(left, right)}, -1)) END"


def common_ancestor_at_sql(left: str, res: str) -> str:
    """The common ancestor, given its resolution as ``common_resolution_sql`` tells it."""
    return f"CASE WHEN {res} IS NULL THEN CAST(NULL AS BIGINT) WHEN {res} < 0 THEN 0L ELSE {_at_level_sql(left, res)} END"


def common_ancestor_sql(left: str, right: str) -> str:
    shared = _shared_sql(left, right)
    return (
        f"CASE WHEN {left} IS NULL OR {right} IS NULL THEN CAST(NULL AS BIGINT) "
        f"WHEN {left} = 0 OR {right} = 0 OR {shared} < 0 THEN 0L ELSE {_at_level_sql(left, shared)} END"
    )


def to_text_sql(cell: str) -> str:
    return f"CASE WHEN {cell} <> 0 THEN lower(hex({cell})) END"


def from_text_sql(text: str) -> str:
    return (
        f"CASE WHEN trim({text}) = '0' THEN 0L "
        f"WHEN length(trim({text})) <= 16 THEN IF(trim({text}) RLIKE '^[0-9A-Fa-f]+$', TRY_CAST(conv(trim({text}), 16, 10) AS BIGINT), NULL) "
        f"ELSE TRY_CAST(trim({text}) AS BIGINT) END"
    )


def resolution(cell: str) -> Column:
    """Resolution 0-15 of a cell, -1 for cell 0."""
    return F.expr(resolution_sql(cell))


def ancestor(cell: str, res: str | int) -> Column:
    """The cell that contains ``cell`` at resolution ``res``.

    0 when the cell is 0 or ``res`` is negative; the cell itself when ``res``
    is finer than the cell.
    """
    return F.expr(ancestor_sql(cell, res))


def common_ancestor(left: str, right: str) -> Column:
    """The finest cell that contains both cells, 0 when there is none."""
    return F.expr(common_ancestor_sql(left, right))


def common_resolution(left: str, right: str) -> Column:
    """The resolution of the finest cell that contains both cells, -1 when there is none."""
    return F.expr(common_resolution_sql(left, right))


def to_text(cell: str) -> Column:
    """Lower-case hexadecimal form; NULL for cell 0."""
    return F.expr(to_text_sql(cell))


def from_text(text: str) -> Column:
    """A cell from its hexadecimal or decimal text.

    A hexadecimal cell has at most 16 characters, a decimal one 18 or 19.
    """
    return F.expr(from_text_sql(text))


def text_resolution(text: str) -> Column:
    """Resolution of a cell given as text, -1 for NULL."""
    return F.expr(f"coalesce({resolution_sql(f"({from_text_sql(text)})")}, -1)")


def text_ancestor(text: str, res: str | int) -> Column:
    """Containing cell of a cell given as text; NULL when there is none."""
    return F.expr(to_text_sql(f"({ancestor_sql(f"({from_text_sql(text)})", res)})"))


def text_common_ancestor(left: str, right: str) -> Column:
    """Finest common cell of two cells given as text; NULL when there is none."""
    common = common_ancestor_sql(f"({from_text_sql(left)})", f"({from_text_sql(right)})")
    return F.expr(to_text_sql(f"({common})"))


def base_cells(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct resolution-0 cells that occur in the given columns."""
    return (
        df.selectExpr(f"explode(array({', '.join(columns)})) AS occurring")
        .select(ancestor("occurring", 0).alias("cell"))
        .where("cell <> 0")
        .distinct()
    )
