"""Joins that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """``big`` joined to ``small``, which has a row for each key at most.

    Each row of ``big`` goes to one of ``salts`` parts of its key, by the hash of
    ``spread``; ``small`` is repeated for each part.  Keys must not be null.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: Rows of a few numbers up to which a table is broadcast: some megabytes.
FEW_ROWS = 100_000


def few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it has ``most`` narrow rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes up to which a table is broadcast.
LIGHT_BYTES = 8 << 20


def light(df: DataFrame, most: int = LIGHT_BYTES) -> DataFrame:
    """``df``, of strings and numbers, marked for broadcast if its values have ``most`` bytes at most (16 for each number and row)."""
    sizes = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) if t == "string" else F.lit(16) for c, t in df.dtypes]
    if df.limit(most // 16 + 1).count() > most // 16:
        return df
    total = df.agg(F.sum(sum(sizes, F.lit(16).cast("long"))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= most else df


def without(df: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """``df``, whatever its columns are called, without the rows whose ``id`` is in ``ids`` (one column); null ids stay."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(id).cast("long").alias("_id"))
    out = rows.join(few(ids.toDF("_id")), "_id", "left_anti")
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns))
