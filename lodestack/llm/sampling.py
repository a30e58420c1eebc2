"""Bounded samples by hash: the same rows whatever the partitions, at any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below(most: int, count: int) -> int | None:
    """The 64-bit number under which ``most`` of ``count`` hashes lie on average; None if all are taken."""
    return None if count <= most else (most << 64) // count - (1 << 63)


def sampled(df: DataFrame, by: Column, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` (all, if it has no more), picked by the hash ``by``."""
    limit = below(most, df.count())
    return df if limit is None else df.where(by < F.lit(limit))
