"""Repeatable samples, decided row by row from a hash of the row's key."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_DIGITS = 8


def hash_digits(keys: Sequence[str], seed: int) -> Column:
    """Hexadecimal digits that depend on the key columns and the seed only."""
    text = F.concat_ws("|", *[F.col(name).cast("string") for name in keys], F.lit(str(seed)))
    return F.substring(F.md5(text), 1, HASH_DIGITS)


def unit_hash(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the key columns and the seed only."""
    return F.conv(hash_digits(keys, seed), 16, 10).cast("double") / float(16**HASH_DIGITS)


def below_share(keys: Sequence[str], seed: int, share: float) -> Column:
    """``unit_hash(keys, seed) < share``, decided on the digits: as many of them stand in the order of their numbers."""
    first_beyond = ceil(min(share, 1.0) * 16**HASH_DIGITS)
    if first_beyond >= 16**HASH_DIGITS:
        return F.lit(True)
    return hash_digits(keys, seed) < F.lit(f"{max(first_beyond, 0):0{HASH_DIGITS}x}")


def sample_fraction(df: DataFrame, fraction: float, seed: int, keys: Sequence[str]) -> DataFrame:
    """Each row with probability ``fraction``, the same rows on every run and cluster."""
    return df.where(below_share(keys, seed, float(fraction)))


def sample_to_size(df: DataFrame, size: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """About ``size`` rows: the fraction follows from one count."""
    rows = df.count()
    return sample_fraction(df, min(size / rows, 1.0) if rows else 1.0, seed, keys)
