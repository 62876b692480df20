"""Travel costs of network edges as native expressions over column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = "double('Infinity')"


def travel_cost(length: str = "length", maxspeed: str = "maxspeed", seconds_per_unit: float = 1.0) -> Column:
    """``length / maxspeed``; infinite at non-positive speed, NULL when an input it needs is NULL.

    ``seconds_per_unit`` is 60 for costs in minutes.
    """
    # The divisor is NULL rather than zero, so ANSI division cannot fail.
    seconds = f"CAST({length} AS DOUBLE) / CAST(CASE WHEN {maxspeed} > 0 THEN {maxspeed} END AS DOUBLE)"
    if seconds_per_unit != 1.0:
        seconds = f"{seconds} / double({float(seconds_per_unit)!r})"
    return F.expr(f"CASE WHEN {maxspeed} <= 0 THEN {INFINITE} ELSE {seconds} END")


def usable_sql(cost: str = "cost") -> str:
    return f"coalesce({cost} < {INFINITE}, false)"


def usable(cost: str = "cost") -> Column:
    """True for costs a path can be built from: neither NULL nor infinite."""
    return F.expr(usable_sql(cost))
